"""Stored tables that change by small files.

A write puts only its own rows, and the ids of what it removes, into new folders. One manifest per write names the folders
of all its tables and is written last, as a single file, so a reader sees all of a write or nothing of it, over all
tables. Nothing is ever overwritten: a write that is cut off leaves folders that no manifest names, writers do not
undo each other, and a repeated micro-batch finds its number in the manifests and changes nothing.

Reading takes the last version per key. The bulk of a table is its *base*, one row per key, laid out by cluster (and by
day for timed tables) for pruning; only keys that later files hold are looked up, so the base is neither shuffled nor
sorted while those files are small. :meth:`TableStore.compact` folds them in when they exceed a share of it by size.

Removals name a column and values (a uuid, a parent's uuid, a composite key). They hide the rows written before them;
what a write adds itself stays. The children of many tables go with one such file, named once per table.

Manifests are ordered by number, those of writers that met by their random ending. Data in a format with MERGE are
served by :func:`merge_into`.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException
from pyspark.util import inheritable_thread_target

from fleetlens import schemas
from fleetlens.operators import merge
from fleetlens.operators.normalize import normalize
from fleetlens.session import dropping_shuffles

#: Tables also laid out by day, with the column that tells it.
TIMED = {"event": "created", "sample": "ts", **{f"prometheus_{scope}_metric": "timestamp" for scope in schemas.METRIC_SCOPES}}
#: Tables that only grow, with what else they are laid out by: every write is laid out, and reading looks no key up.
GROWING = {"sample": ["metric"]}

CLUSTER, _DAY, _COMMIT, _GONE = "cluster_uuid", "_day", "_commit", "_gone"
#: Writes of one transaction that run at a time.
WRITERS = 8


@dataclass(frozen=True)
class Batch:
    """Identity of a micro-batch's write: its number, which of the batch's writes it is, and whose.

    ``writer`` tells feeds into one store apart. A streaming query's own id is the one to take: it stays the same over
    restarts and is another one for another checkpoint (:func:`streaming_writer`).
    """

    id: int
    step: str
    writer: str = ""

    @property
    def feed(self) -> str:
        return f"{self.writer or 'direct'}/{self.step}"


def streaming_writer(spark: SparkSession) -> str:
    """Id of the streaming query that the calling ``foreachBatch`` function runs in, empty outside of one."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def same(left: str, right: str, columns: Iterable[str]) -> Column:
    """Null-safe equality of columns of two aliases."""
    found = F.lit(True)
    for c in columns:
        found = found & F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`"))
    return found


@dataclass(frozen=True)
class Change:
    """What one write did to one table: a folder of rows ("base" or "rows"), of removed values ("gone"), or a "horizon"."""

    id: str
    commit: str
    table: str
    part: str
    path: str = ""
    columns: tuple[str, ...] = ()
    schema: str = ""
    bytes: int = 0
    value: str = ""
    covers: tuple[str, ...] = ()

    def plain(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in self.__dict__.items() if v or k == "bytes"}

    @staticmethod
    def of(plain: dict) -> Change:
        return Change(**{k: tuple(v) if isinstance(v, list) else v for k, v in plain.items()})


@dataclass
class Snapshot:
    """All tables as of one reading of the manifests: several tables read from it fit together."""

    store: TableStore
    commits: list[dict]
    changes: dict[str, list[Change]] = field(default_factory=dict)
    batches: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self) -> None:
        replaced = {name for c in self.commits for name in c.get("replaces", [])}
        self.commits = sorted((c for c in self.commits if c["commit"] not in replaced), key=lambda c: (c["number"], c["commit"]))
        every = [Change.of(x) for c in self.commits for x in c["changes"]]
        covered = {id for x in every for id in x.covers}
        for x in sorted(every, key=lambda x: x.commit):
            if x.id not in covered:
                self.changes.setdefault(x.table, []).append(x)
        for c in self.commits:
            self.batches |= c.get("batches", {})

    @property
    def number(self) -> int:
        return max((c["number"] for c in self.commits), default=0)

    def tables(self) -> list[str]:
        return [t for t, found in self.changes.items() if any(x.schema and x.part != "gone" for x in found)]

    def parts(self, table: str, *names: str) -> list[Change]:
        return [x for x in self.changes.get(table, []) if x.part in names]

    def has(self, table: str) -> bool:
        return bool(self.parts(table, "base", "rows"))

    def done(self, batch: Batch | None) -> dict | None:
        """The note a batch left, if it was the last one of its feed to be written."""
        note = self.batches.get(batch.feed) if batch else None
        return note if note and note["id"] == batch.id else None

    def schema(self, table: str) -> T.StructType:
        """Columns of all files, the last file's type for each."""
        fields: dict[str, T.StructField] = {}
        for x in self.parts(table, "base", "rows"):
            fields |= {f["name"]: T.StructField.fromJson(f) for f in json.loads(x.schema)}
        return T.StructType(list(fields.values()))

    def _files(self, paths: list[str], schema: T.StructType, extra: dict[str, T.DataType], base: str = "") -> DataFrame:
        for name, kind in extra.items():
            schema = schema if name in schema.names else T.StructType([*schema.fields, T.StructField(name, kind)])
        reader = self.store.spark.read.schema(schema)
        return (reader.option("basePath", base) if base else reader).parquet(*paths)

    def read(self, table: str) -> DataFrame | None:
        """Live rows of a table, None if it was never written."""
        if not self.has(table):
            return None
        schema, keys = self.schema(table), schemas.TABLE_KEYS[table]
        if table in GROWING:
            return self._grown(table, schema)
        bases, rows = self.parts(table, "base"), self.parts(table, "rows")
        horizons = self.parts(table, "horizon")
        # Files besides the first base: those of later writes, and bases of writers that met at a table's beginning.
        later = [self._files([x.path], schema, {_DAY: T.DateType()}).withColumn(_COMMIT, F.lit(x.commit)).select(*schema.names, _COMMIT)
                 for x in bases[1:]]
        if rows:
            later.append(self._files([x.path for x in rows], schema, {_COMMIT: T.StringType()}, self.store.folder(table, "rows"))
                         .select(*schema.names, _COMMIT))
        base = latest = None
        for part in later:
            latest = part if latest is None else latest.unionByName(part)
        # A write holds each key once, so the rows of one write are not dealt by key again.
        if latest is not None and len(rows) + len(bases[1:]) > 1:
            latest = merge.dedup_last(latest, keys, [_COMMIT])
        if bases:
            base = self._files([bases[0].path], schema, {_DAY: T.DateType()} if table in TIMED else {})
            for x in horizons:
                limit = F.lit(x.value).cast("timestamp")
                base = base.filter((F.col(_DAY).isNull() | (F.col(_DAY) >= F.to_date(limit)))
                                   & (F.col(TIMED[table]).isNull() | (F.col(TIMED[table]) >= limit)))
            base = base.select(*schema.names)
            if latest is not None:
                base = base.alias("b").join(latest.select(*keys).alias("l"), same("b", "l", keys), "left_anti")
        for x in horizons if latest is not None else []:
            latest = latest.filter(F.col(TIMED[table]).isNull() | (F.col(TIMED[table]) >= F.lit(x.value).cast("timestamp"))
                                   | (F.col(_COMMIT) > x.commit))
        for columns, gone in self._removed(table).items():
            if base is not None:
                base = base.alias("b").join(gone.alias("g"), same("b", "g", columns), "left_anti")
            if latest is not None:
                latest = (latest.alias("l").join(gone.alias("g"), same("l", "g", columns), "left")
                          .filter(F.col(_GONE).isNull() | (F.col(_COMMIT) >= F.col(_GONE))).select("l.*"))
        if latest is None:
            return base
        latest = latest.select(*schema.names)
        return latest if base is None else base.unionByName(latest)

    def _grown(self, table: str, schema: T.StructType, files: list[Change] | None = None) -> DataFrame:
        """All rows of a table that only grows, or those of some of its files; filters on its layout leave out folders."""
        found = None
        for part in ("base", "rows"):
            paths = [x.path for x in (self.parts(table, part) if files is None else files) if x.part == part]
            if paths:
                rows = self._files(paths, schema, {_COMMIT: T.StringType(), _DAY: T.DateType()}, self.store.folder(table, part))
                found = rows if found is None else found.unionByName(rows)
        for x in self.parts(table, "horizon"):
            limit = F.lit(x.value).cast("timestamp")
            found = found.filter((F.col(_COMMIT) > x.commit) | F.col(_DAY).isNull() | (F.col(_DAY) >= F.to_date(limit)))
            found = found.filter((F.col(_COMMIT) > x.commit) | F.col(TIMED[table]).isNull() | (F.col(TIMED[table]) >= limit))
        return found.select(*schema.names, _DAY)

    def _removed(self, table: str) -> dict[tuple[str, ...], DataFrame]:
        """Removed values by column, each with the last write that removed it."""
        grouped: dict[tuple[str, ...], list[Change]] = {}
        for x in self.parts(table, "gone"):
            grouped.setdefault(x.columns, []).append(x)
        out = {}
        for columns, found in grouped.items():
            stored = T.StructType([T.StructField.fromJson(f) for f in json.loads(found[-1].schema)])
            values = self._files([x.path for x in found], stored, {_COMMIT: T.StringType()}, self.store.folder("removed", "gone"))
            out[columns] = values.toDF(*columns, _COMMIT).groupBy(*columns).agg(F.max(_COMMIT).alias(_GONE))
        return out


class Transaction:
    """Changes of any tables that become visible together; use it as ``with store.transaction(batch) as t``.

    ``done`` says that the batch was written before: then nothing is collected and nothing written. ``note`` is kept with the
    batch and given back for a repeated one.
    """

    def __init__(self, store: TableStore, batch: Batch | None = None, note: dict | None = None):
        self.store, self.batch = store, batch
        self.snapshot = store.snapshot()
        self.note = self.snapshot.done(batch)
        self.done = self.note is not None
        self.note = self.note or {**(note or {}), "id": batch.id if batch else -1}
        self.rows: dict[str, list[DataFrame]] = {}
        self.gone: list[tuple[DataFrame, list[tuple[str, tuple[str, ...]]]]] = []
        self.horizons: list[tuple[str, str]] = []
        self.held: list[DataFrame] = []
        self.staged: list[str] = []

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        try:
            if kind is None and not self.done:
                self._commit()
        finally:
            self.release()

    def hold(self, df: DataFrame) -> DataFrame:
        """Keep rows that several writes are derived from until the transaction ends."""
        self.held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self.held[-1]

    def stage(self, df: DataFrame) -> DataFrame:
        """As :meth:`hold`, for wide nested rows: files from which each write reads the fields it needs."""
        path = f"{self.store.root}/staged/{uuid.uuid4().hex}"
        self.staged.append(path)
        df.write.parquet(path)
        return self.store.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        while self.held:
            self.held.pop().unpersist()
        while self.staged:
            self.store._drop(self.staged.pop())

    def write_upsert(self, table: str, rows: DataFrame, order: list[str] | None = None,
                     update_columns: list[str] | None = None) -> None:
        """Insert rows or overwrite those with the same key; ``update_columns`` limits what is overwritten.

        Of rows with the same key the last by ``order`` counts; without it keys are expected to be unique, and the
        greatest row settles what is not.
        """
        keys = schemas.TABLE_KEYS[table]
        new = merge.dedup_last(rows, keys, order or [c for c in rows.columns if c not in keys] or keys)
        if update_columns is not None and set(rows.columns) - set(keys) - set(update_columns) and self.snapshot.has(table):
            old = self.snapshot.read(table)
            touched = old.alias("o").join(new.select(*keys).alias("n"), same("o", "n", keys), "left_semi").select(*new.columns)
            new = merge.merge_columns(touched, new, keys, update_columns)
        self.rows.setdefault(table, []).append(new)

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows to a table that only grows. The layout keeps each folder's rows in few files."""
        if table not in GROWING:
            raise ValueError(f"{table} is not a table that only grows")
        self.rows.setdefault(table, []).append(rows)

    def remove(self, values: DataFrame, places: Iterable[tuple[str, tuple[str, ...]]]) -> None:
        """Remove rows written before by values: (table, columns) name where, the columns of ``values`` in that order."""
        self.gone.append((values.distinct(), list(places)))

    def delete_by_keys(self, table: str, ids: DataFrame, column: str = "uuid") -> None:
        """Delete rows whose ``column`` is among ``ids``."""
        self.remove(ids.select(ids.columns[0]), [(table, (column,))])

    def cascade_delete(self, parent: str, ids: DataFrame, registry=None) -> None:
        """Delete parents and the rows of all their cascading child tables."""
        registry = registry or schemas.RELATIONS
        places = [(parent, ("uuid",)), *((r.child, (r.foreign_key,)) for r in registry.children(parent, cascade_only=True))]
        self.remove(ids.select(ids.columns[0]), places)

    def cascade_upsert(self, kind: str, objects: DataFrame, as_of=None, children: str = "replace",
                       order: list[str] | None = None, **options) -> dict[str, DataFrame]:
        """Write a kind's raw objects to the parent table and all child tables; gives the normalised tables.

        Of several versions of an object the last by ``order`` counts. ``children="merge"`` keeps child rows the new
        version of an object no longer has.
        """
        if order:
            named = objects.withColumn("_uid", F.col("meta.uid"))
            objects = merge.dedup_last(named, ["cluster_uid", "_uid"], order).drop("_uid")
        given = normalize(kind, objects, as_of, **options)
        if self.done:
            return given
        # Staged files go with the transaction; what the caller gets is made from the caller's rows.
        tables = normalize(kind, self.stage(objects), as_of, **options)
        if children != "merge":
            places = [(r.child, (r.foreign_key,)) for r in schemas.RELATIONS.children(kind, cascade_only=True) if r.child in tables]
            self.remove(tables[kind].select("uuid"), places)
        twice = self.store.side_by_side([lambda n=n, rows=rows: self._repeats(n, rows) for n, rows in tables.items()])
        for (name, rows), repeats in zip(tables.items(), twice):
            if repeats:
                self.write_upsert(name, rows)
            else:
                self.rows.setdefault(name, []).append(rows)
        return given

    def _repeats(self, table: str, rows: DataFrame) -> bool:
        """Whether a key may come twice, by its hash: rows whose keys differ are written as they are, not dealt by key."""
        keys = rows.select(F.xxhash64(*schemas.TABLE_KEYS[table]).alias("_key"))
        return not keys.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()

    def retention(self, table: str, as_of, days: int = 1) -> None:
        """Drop rows older than ``days``; rows without an instant stay. Their files go with the next vacuum or compaction."""
        if table not in TIMED:
            raise ValueError(f"{table} is not laid out by day")
        limit = self.store.spark.range(1).select(merge.horizon(as_of, days).cast("string")).first()[0]
        self.horizons.append((table, limit))

    # --- writing ---------------------------------------------------------------------------------------------

    def _commit(self) -> None:
        with dropping_shuffles(self.store.spark):
            self._write()

    def _write(self) -> None:
        number = self.snapshot.number + 1
        name = f"{number:012d}-{uuid.uuid4().hex[:12]}"
        jobs = [lambda t=t, found=found: self._write_rows(name, t, found) for t, found in self.rows.items()]
        jobs += [lambda i=i, x=x: self._write_gone(name, i, *x) for i, x in enumerate(self.gone)]
        changes = [x for found in self.store.side_by_side(jobs) for x in found]
        changes += [Change("", name, table, "horizon", value=value) for table, value in self.horizons if self.snapshot.has(table)]
        if changes or self.batch:
            self.store.publish(name, number, changes, {self.batch.feed: self.note} if self.batch else {})

    def _write_rows(self, name: str, table: str, found: list[DataFrame]) -> list[Change]:
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more, allowMissingColumns=True)
        if len(found) > 1 and table not in GROWING:
            keys = schemas.TABLE_KEYS[table]
            rows = merge.dedup_last(rows, keys, [c for c in rows.columns if c not in keys] or keys)
        first = not self.snapshot.has(table)
        change = self.store.write_part(name, table, "base" if first else "rows", rows)
        return [change] if first or not self.store.spark.read.schema(rows.schema).parquet(change.path).isEmpty() else []

    def _write_gone(self, name: str, place: int, values: DataFrame, places: list) -> list[Change]:
        places = [p for p in places if self.snapshot.has(p[0])]
        if not places:
            return []
        path = f"{self.store.folder('removed', 'gone')}/{_COMMIT}={name}/{place}"
        values = values.toDF(*[f"id{i}" for i in range(len(values.columns))])
        values.write.parquet(path)
        if self.store.spark.read.schema(values.schema).parquet(path).isEmpty():
            return []
        size, schema = self.store.size_of(path), json.dumps(values.schema.jsonValue()["fields"])
        return [Change("", name, table, "gone", path, columns, schema, size) for table, columns in places]


@dataclass
class TableStore:
    """All stored tables below one root folder.

    A table is compacted when its later files exceed ``share`` of its base in bytes, or ``most_files`` writes.
    """

    spark: SparkSession
    root: str
    share: float = 0.25
    most_files: int = 24

    def folder(self, table: str, part: str) -> str:
        return f"{self.root}/data/{table}/{part}"

    def transaction(self, batch: Batch | None = None, note: dict | None = None) -> Transaction:
        return Transaction(self, batch, note)

    def snapshot(self) -> Snapshot:
        """The state that the manifests of now describe."""
        try:
            found = (self.spark.read.option("wholetext", True).option("recursiveFileLookup", True)
                     .text(f"{self.root}/commits").collect())
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            found = []
        return Snapshot(self, [json.loads(r[0]) for r in found])

    def read(self, table: str) -> DataFrame | None:
        """Rows of a table, or None while it was never written."""
        return self.snapshot().read(table)

    def layout(self, table: str, schema: T.StructType) -> list[str]:
        """Columns that the folders of a base are named by."""
        clusters = CLUSTER in schema.names and (CLUSTER not in schemas.TABLE_KEYS[table] or table == "series")
        return [*([_DAY] if table in TIMED else []), *(GROWING.get(table) or ([CLUSTER] if clusters else []))]

    # --- files -----------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(context._jsc.hadoopConfiguration()), target

    def size_of(self, path: str) -> int:
        fs, target = self._fs(path)
        return int(fs.getContentSummary(target).getLength())

    def _drop(self, path: str) -> None:
        fs, target = self._fs(path)
        fs.delete(target, True)

    def side_by_side(self, jobs: list) -> list:
        """Results of several writes, a few at a time: most are small, and tables do not wait for each other."""
        if len(jobs) < 2:
            return [job() for job in jobs]
        run = inheritable_thread_target(self.spark)
        with ThreadPoolExecutor(WRITERS) as pool:
            return [f.result() for f in [pool.submit(run(job)) for job in jobs]]

    def write_part(self, name: str, table: str, part: str, rows: DataFrame, covers: Iterable[str] = ()) -> Change:
        path, schema = f"{self.folder(table, part)}/{_COMMIT}={name}", rows.schema
        layout = self.layout(table, schema) if part == "base" or table in GROWING else []
        if layout:
            if _DAY in layout:
                rows = rows.withColumn(_DAY, F.to_date(TIMED[table]))
            # Rebalancing gathers each folder in few files; adaptive execution splits the large ones over tasks.
            rows.hint("rebalance", *[F.col(c) for c in layout]).write.partitionBy(*layout).parquet(path)
        else:
            rows.write.parquet(path)
        return Change("", name, table, part, path, (), json.dumps(schema.jsonValue()["fields"]), self.size_of(path), covers=tuple(covers))

    def publish(self, name: str, number: int, changes: list[Change], batches: dict[str, dict], replaces: list[str] | None = None) -> None:
        """Write a manifest: one file, put in place at once."""
        plain = [{**x.plain(), "id": x.id or f"{name}:{i}"} for i, x in enumerate(changes)]
        text = json.dumps({"commit": name, "number": number, "batches": batches, "changes": plain, "replaces": replaces or []})
        self.spark.range(1).select(F.lit(text)).coalesce(1).write.text(f"{self.root}/commits/{name}")

    # --- single changes --------------------------------------------------------------------------------------

    def write_upsert(self, table: str, rows: DataFrame, order: list[str] | None = None,
                     update_columns: list[str] | None = None, batch: Batch | None = None) -> None:
        with self.transaction(batch) as t:
            t.write_upsert(table, rows, order, update_columns)

    def delete_by_keys(self, table: str, ids: DataFrame, column: str = "uuid", batch: Batch | None = None) -> None:
        with self.transaction(batch) as t:
            t.delete_by_keys(table, ids, column)

    def cascade_delete(self, parent: str, ids: DataFrame, registry=None, batch: Batch | None = None) -> None:
        with self.transaction(batch) as t:
            t.cascade_delete(parent, ids, registry)

    def cascade_upsert(self, kind: str, objects: DataFrame, as_of=None, children: str = "replace",
                       batch: Batch | None = None, order: list[str] | None = None, **options) -> dict[str, DataFrame]:
        with self.transaction(batch) as t:
            return t.cascade_upsert(kind, objects, as_of, children, order, **options)

    def retention(self, table: str, as_of, days: int = 1) -> None:
        with self.transaction() as t:
            t.retention(table, as_of, days)

    def replace_slice(self, cluster_uuid: str, key_prefix: str, rows: DataFrame | None) -> None:
        """Replace the locked configuration of one cluster under a key prefix."""
        with self.transaction() as t:
            current = t.snapshot.read("config")
            if current is not None:
                keys = tuple(schemas.TABLE_KEYS["config"])
                kept = merge.replace_slice(current, cluster_uuid, key_prefix, None)
                t.remove(current.select(*keys).exceptAll(kept.select(*keys)), [("config", keys)])
            if rows is not None:
                t.write_upsert("config", rows)

    def upsert_cluster(self, row: DataFrame) -> None:
        self.write_upsert("cluster", row)

    def upsert_instance(self, row: DataFrame) -> None:
        """Put the instance row of a cluster in the place of all its former ones."""
        with self.transaction() as t:
            t.delete_by_keys("kubernetes_instance", row.select(CLUSTER), CLUSTER)
            t.write_upsert("kubernetes_instance", row)

    # --- maintenance -----------------------------------------------------------------------------------------

    def folded(self, snapshot: Snapshot, table: str, force: bool = False) -> list[Change]:
        """The files of a table that are due to become one.

        All of them, when those beside the base have grown enough. Of a table that only grows the smallest ones, each not
        far above the sum of those before it, so that a row is written again a few times only, however large the table is.
        """
        found = snapshot.changes[table]
        if table in GROWING:
            files = sorted(snapshot.parts(table, "base", "rows"), key=lambda x: x.bytes)
            small, total = files[:1], files[0].bytes
            for x in files[1:]:
                if not force and x.bytes > 4 * total:
                    break
                small, total = [*small, x], total + x.bytes
            return small if len(small) > 1 and (force or len(files) > self.most_files) else []
        bases = snapshot.parts(table, "base")
        later = [*snapshot.parts(table, "rows", "gone"), *bases[1:]]
        due = len(later) > self.most_files or sum(x.bytes for x in later) > self.share * sum(x.bytes for x in bases[:1])
        return found if len(found) > 1 and (force or due) else []

    def compact(self, tables: Iterable[str] | None = None, force: bool = False) -> list[str]:
        """Write the files that are due (with ``force`` all) as one, for each table; gives the names of the tables.

        Readers and writers go on meanwhile: the new files stand for just those they were made from.
        """
        snapshot = self.snapshot()
        picked = {t: found for t in (tables or snapshot.tables()) if snapshot.has(t) and (found := self.folded(snapshot, t, force))}
        if picked:
            name = f"{snapshot.number + 1:012d}-{uuid.uuid4().hex[:12]}"

            def write(table: str) -> Change:
                schema, files = snapshot.schema(table), picked[table]
                rows = snapshot._grown(table, schema, files) if table in GROWING else snapshot.read(table)
                part = "rows" if table in GROWING else "base"
                # In order it takes the place of the last file in it, so that what was written meanwhile comes after it. Rows of
                # a table that only grows are placed by their folder: its name too comes before that of the next write.
                last = max(x.commit for x in files)
                place = f"{last}.{uuid.uuid4().hex[:12]}" if table in GROWING else name
                return replace(self.write_part(place, table, part, rows.select(*schema.names), [x.id for x in files]), commit=last)

            with dropping_shuffles(self.spark):
                self.publish(name, snapshot.number, self.side_by_side([lambda t=t: write(t) for t in picked]), {})
        return list(picked)

    def vacuum(self) -> None:
        """Delete files that compaction replaced and days that retention dropped, and fold the manifests into one.

        For a time when nobody reads from an older snapshot.
        """
        snapshot = self.snapshot()
        if not snapshot.commits:
            return
        live = [x for found in snapshot.changes.values() for x in found]
        kept = {x.path for x in live}
        name = f"{snapshot.number:012d}-{uuid.uuid4().hex[:12]}"
        self.publish(name, snapshot.number, live, snapshot.batches, [c["commit"] for c in snapshot.commits])
        for commit in snapshot.commits:
            self._drop(f"{self.root}/commits/{commit['commit']}")
        for path in {x["path"] for c in snapshot.commits for x in c["changes"] if x.get("path")} - kept:
            self._drop(path)
        for table in snapshot.changes:
            for x in snapshot.parts(table, "horizon"):
                for base in snapshot.parts(table, "base")[:1]:
                    self._drop_days(base.path, dt.datetime.fromisoformat(x.value).date())

    def _drop_days(self, path: str, first: dt.date) -> None:
        fs, target = self._fs(path)
        for status in fs.listStatus(target):
            name, _, day = status.getPath().getName().partition("=")
            if name == _DAY and day[:4].isdigit() and dt.date.fromisoformat(day) < first:
                fs.delete(status.getPath(), True)


def merge_into(table: str, rows: DataFrame, keys: list[str], update_columns: list[str] | None = None) -> None:
    """Upsert into a catalogue table whose format supports MERGE (plain Parquet does not)."""
    condition = " AND ".join(f"source.{k} = {table}.{k}" for k in keys)
    merger = rows.alias("source").mergeInto(table, F.expr(condition))
    if update_columns is None:
        merger.whenMatched().updateAll().whenNotMatched().insertAll().merge()
    else:
        merger.whenMatched().update({c: F.col(f"source.{c}") for c in update_columns}).whenNotMatched().insertAll().merge()
