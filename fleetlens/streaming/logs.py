"""Container logs: new lines appended to the stored text, of which only the tail is kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.ids import ensure_uuid, uuid5
from fleetlens.functions.text import MAX_LOG_BYTES, log_tail
from fleetlens.sources.tables import Batch, TableStore, streaming_writer

#: Parts that the lines of one container are dealt to before its tail is known.
PARTS = 1024


def _tail(lines: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Lines of each group after which at most ``size`` bytes follow in it, so that what is cut is known to be longer."""
    later = Window.partitionBy(*keys).orderBy(F.desc("seq"), F.desc("ts"), F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    behind = F.coalesce(F.sum(F.octet_length("line")).over(later), F.lit(0))
    return lines.withColumn("_behind", behind).filter(F.col("_behind") <= size).drop("_behind")


def recent_text(lines: DataFrame, size: int = MAX_LOG_BYTES) -> DataFrame:
    """The end of each container's new text, more than ``size`` bytes of it when there are so many.

    ``lines``: container_uuid, seq, ts, text; also pod_uuid, which is handed on. Numbers only order the lines, they may
    have gaps and repeat. One container may have written most of all lines, so they are first dealt to ``PARTS`` parts
    by their content, and each part keeps its own tail. A line of the whole tail has no more bytes behind it in its
    part than in all, so no part drops it, and what the parts keep (at most ``PARTS`` tails) decides the rest exactly.
    """
    also = [c for c in ("pod_uuid",) if c in lines.columns]
    line = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"))
    dealt = lines.select("container_uuid", *also, "seq", "ts", line.alias("line"),
                         F.pmod(F.xxhash64("seq", "ts", "text"), F.lit(PARTS)).alias("part"))
    tail = _tail(_tail(dealt, ["container_uuid", "part"], size), ["container_uuid"], size)
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("seq", "ts", "line"))), lambda x: x["line"])
    return tail.groupBy("container_uuid", *also).agg(F.array_join(pieces, "").alias("text"), F.max("ts").alias("last_update"))


def _appended(size: int) -> Column:
    """Stored text ``logs`` and new text ``_new`` as one, cut to its end."""
    whole = F.concat(F.coalesce("logs", F.lit("")), F.coalesce("_new", F.lit("")))
    return F.when(F.col("_new").isNull(), F.col("logs")).otherwise(log_tail(whole, size)).alias("logs")


def append_logs(stored: DataFrame, lines: DataFrame, size: int = MAX_LOG_BYTES) -> DataFrame:
    """Stored logs (container_uuid, logs, last_update) with new lines appended, cut to the last ``size`` bytes.

    Containers without new lines keep their row; new containers get one.
    """
    fresh = recent_text(lines, size).select("container_uuid", F.col("text").alias("_new"), F.col("last_update").alias("_at"))
    joined = stored.join(fresh, "container_uuid", "full_outer")
    return joined.select("container_uuid", _appended(size), F.greatest("last_update", "_at").alias("last_update"))


def lines_of_containers(lines: DataFrame) -> DataFrame:
    """Lines as they are read (pod_uid, container, ..) under the ids of the stored tables."""
    return lines.select(ensure_uuid(F.col("pod_uid")).alias("pod_uuid"), "container", "ts", "seq", "text").withColumn(
        "container_uuid", uuid5(F.col("pod_uuid"), F.col("container"))).drop("container")


@dataclass
class LogKeeper:
    """``foreachBatch`` function that appends log lines (:func:`~fleetlens.sources.readers.read_logs`) to the stored ``container_log``.

    Only rows of containers that wrote are written anew. Lines of containers that the store does not know as started are
    left out, unless ``all_containers``. A repeated batch finds its number in
    the store. The rows go with their pod: :class:`ChangeApplier` deletes them by ``pod_uuid``.
    """

    store: TableStore
    size: int = MAX_LOG_BYTES
    all_containers: bool = False
    writer: str = ""
    compact: bool = True

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        identity = Batch(batch_id, "logs", self.writer or streaming_writer(batch.sparkSession))
        with self.store.transaction(identity) as t:
            lines = lines_of_containers(batch)
            if not self.all_containers:
                started = [t.snapshot.read(sort).filter("started").select(F.col("uuid").alias("container_uuid"))
                           for sort in ("container", "sidecar_container") if t.snapshot.has(sort)]
                if t.done or not started:
                    return
                lines = lines.join(started[0] if len(started) == 1 else started[0].unionByName(started[1]), "container_uuid", "left_semi")
            fresh = recent_text(lines, self.size).withColumnsRenamed({"text": "_new", "last_update": "_at"})
            stored = t.snapshot.read("container_log")
            if stored is None:
                rows = fresh.select("container_uuid", "pod_uuid", log_tail(F.col("_new"), self.size).alias("logs"),
                                    F.col("_at").alias("last_update"))
            else:
                joined = fresh.join(stored.select("container_uuid", "logs", "last_update"), "container_uuid", "left")
                rows = joined.select("container_uuid", "pod_uuid", _appended(self.size), F.greatest("last_update", "_at").alias("last_update"))
            t.write_upsert("container_log", rows)
        if self.compact:
            self.store.compact(["container_log"])


def started_only(lines: DataFrame, containers: DataFrame) -> DataFrame:
    """Lines of containers that have started."""
    started = containers.filter("started").select(F.col("uuid").alias("container_uuid"))
    return lines.join(started, "container_uuid", "left_semi")
