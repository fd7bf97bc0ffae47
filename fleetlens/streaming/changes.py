"""Change feed -> stored tables, one micro-batch at a time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens import schemas
from fleetlens.functions.ids import ensure_uuid
from fleetlens.operators.links import stale_keys
from fleetlens.operators.merge import dedup_last
from fleetlens.sources.tables import Batch, TableStore, streaming_writer

# Fixed value: upserts of objects that go within this many seconds are left to the delete that follows.
DELETE_SOON_SECONDS = 30


def coalesce_changes(changes: DataFrame) -> DataFrame:
    """Several queued changes of one object act once, as the newest."""
    return dedup_last(changes, ["kind", "uid"], ["seq"])


def without_deletes(changes: DataFrame) -> DataFrame:
    """A feed whose deletions are ignored."""
    return changes.filter(F.col("type") != "DELETED")


def deleted_ids(changes: DataFrame) -> DataFrame:
    """uuids to delete; each once, however often its deletion is reported."""
    return changes.filter(F.col("type") == "DELETED").select(ensure_uuid(F.col("uid")).alias("uuid")).dropDuplicates()


def not_deleting_soon(objects: DataFrame, as_of, seconds: int = DELETE_SOON_SECONDS) -> DataFrame:
    """Objects whose deletion time is unset or further away than the guard."""
    limit = F.lit(as_of).cast("timestamp") + F.expr(f"INTERVAL {int(seconds)} SECONDS")
    going = F.col("meta.deletionTimestamp") <= limit
    return objects.filter(~F.coalesce(going, F.lit(False)))


def objects_of(changes: DataFrame, kind: str) -> DataFrame:
    """Objects of one kind carried by ADDED and UPDATED changes, with the kind's input schema."""
    body = T.StructType([f for f in schemas.kind_schema(kind).fields if f.name != "cluster_uid"])
    alive = changes.filter((F.col("kind") == kind) & (F.col("type") != "DELETED"))
    return alive.select("cluster_uid", F.from_json("object", body).alias("o")).select("cluster_uid", "o.*").filter(
        F.col("meta").isNotNull())


#: (kind, normalised tables, deleted uuids, batch): what a subscriber is called with.
Subscriber = Callable[[str, dict[str, DataFrame], DataFrame, Batch], None]


@dataclass
class ChangeApplier:
    """``foreachBatch`` function that keeps the stored tables in step with a change feed.

    All kinds and tables of a batch become visible together. Each kind's objects are parsed once, for all its tables.

    ``deletes="ignore"`` keeps rows of deleted objects for the kinds in ``keep_kinds`` (events by default).
    ``subscribers`` get (kind, normalised tables, deleted uuids, batch) after the batch was written. A batch that is
    repeated changes no table, but its subscribers are called again, as they may not have been reached; the instant it
    was judged by is kept with it, so they get the same rows. ``writer`` names the feed where it is not run by a
    streaming query of its own.
    """

    store: TableStore
    kinds: list[str] = field(default_factory=lambda: list(schemas.KIND_SCHEMAS))
    as_of: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc)
    keep_kinds: tuple[str, ...] = ("event",)
    children: str = "replace"
    subscribers: list[Subscriber] = field(default_factory=list)
    writer: str = ""
    compact: bool = True

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        identity = Batch(batch_id, "changes", self.writer or streaming_writer(batch.sparkSession))
        # Deletions of kept kinds are left out first, so that the last version before them is stored.
        ignored = F.col("kind").isin(list(self.keep_kinds)) & (F.col("type") == "DELETED")
        latest = coalesce_changes(batch.filter(~ignored)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            present = {(r.kind, r.gone) for r in latest.select(
                "kind", (F.col("type") == "DELETED").alias("gone")).distinct().collect()}
            applied: list[tuple[str, dict[str, DataFrame], DataFrame]] = []
            now = self.as_of()
            with self.store.transaction(identity, {"as_of": now.isoformat()}) as transaction:
                now = dt.datetime.fromisoformat(transaction.note["as_of"])
                for kind in self.kinds:
                    if not {(kind, True), (kind, False)} & present:
                        continue
                    gone, tables = deleted_ids(latest.filter(F.col("kind") == kind)), {}
                    if (kind, True) in present:
                        transaction.cascade_delete(kind, gone)
                    if (kind, False) in present:
                        objects = not_deleting_soon(objects_of(latest, kind), now)
                        tables = transaction.cascade_upsert(kind, objects, now, children=self.children)
                    applied.append((kind, tables, gone))
            for kind, tables, gone in applied if self.subscribers else []:
                for subscriber in self.subscribers:
                    subscriber(kind, tables, gone, identity)
        finally:
            latest.unpersist()
        if self.compact:
            self.store.compact()


def run_changes(stream: DataFrame, applier: ChangeApplier, checkpoint: str, **trigger):
    """Start the feed; give ``availableNow=True`` or ``processingTime="10 seconds"``."""
    return stream.writeStream.foreachBatch(applier).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def reconcile(store: TableStore, kind: str, snapshot: DataFrame) -> DataFrame:
    """Start-up clean-up: delete what the store has and the full list of objects has not; gives the stale rows.

    ``snapshot``: raw objects with meta. Run once before the feed starts.
    """
    stored = store.read(kind)
    namespace = F.coalesce("meta.namespace", F.lit(""))
    current = snapshot.select(
        F.concat_ws("|", ensure_uuid(F.col("cluster_uid")), namespace, "meta.name").alias("key"),
        ensure_uuid(F.col("meta.uid")).alias("uuid"))
    if stored is None:
        return current.limit(0)
    # Only the clusters the snapshot lists are reconciled.
    listed = snapshot.select(ensure_uuid(F.col("cluster_uid")).alias("cluster_uuid")).distinct()
    warmed = stored.join(listed, "cluster_uuid", "left_semi").select(
        F.concat_ws("|", "cluster_uuid", F.coalesce("namespace", F.lit("")), "name").alias("key"), "uuid")
    # Files of a snapshot stay as they are, so the stale keys read the same after the deletion.
    stale = stale_keys(warmed, current)
    store.cascade_delete(kind, stale.select("uuid"))
    return stale


def reconcile_all(store: TableStore, snapshots: dict[str, DataFrame], no_warm_up: tuple[str, ...] = ("event",)) -> dict[str, DataFrame]:
    """:func:`reconcile` for every kind but those in ``no_warm_up``, whose rows outlive the objects; stale rows by kind."""
    return {kind: reconcile(store, kind, objects) for kind, objects in snapshots.items() if kind not in no_warm_up}
