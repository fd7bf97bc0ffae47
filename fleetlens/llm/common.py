"""What the text operators share: words, hashes of words, and saving intermediate tables.

A word is a run of characters other than space and the controls 9 to 13 (tab to carriage return). Hashes are 64-bit
and the same in every process.
"""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import shared_folder

#: Fixed value: what separates words.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_MIX = (U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB))


class WordHashes(dict):
    """Word to 64-bit hash, remembered; forgets everything when it has grown to ``most`` words."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def hashes_of(words: list[str], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=U64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * _MIX[0]
        x = (x ^ (x >> U64(27))) * _MIX[1]
        return x ^ (x >> U64(31))


def shingle_hashes(hashed: np.ndarray, k: int) -> np.ndarray:
    """One hash per k consecutive words; a shorter text of at least one word has one shingle, all its words."""
    n = len(hashed)
    if n == 0:
        return hashed
    k = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - k + 1, U64(k))
        for i in range(k):
            out = out * _ODD + hashed[i:n - k + 1 + i]
    return mixed(out)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """``mapInArrow`` of a function from a batch to columns; ``make`` runs once per task and may hold state."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                if out is not None:
                    yield pa.RecordBatch.from_arrays(
                        [x if isinstance(x, pa.Array) and x.type == f.type else pa.array(x, f.type)
                         for x, f in ((out[f.name], f) for f in arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def text_key(text: Column) -> Column:
    """128 bits of the text as a string; equal texts share it. NULL for NULL."""
    return F.md5(text.cast("binary"))


#: Paths of the tables written inside each open :func:`scratch`.
_WRITTEN: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that :func:`saved` writes meanwhile, but for those it is told to keep (these go with the scratch
    around this one, if any); what is kept has to be written by then, as nothing can be computed from the others afterwards."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        context = spark.sparkContext
        for path in _WRITTEN.pop():
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def saved(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    if held := _WRITTEN[:-1] if keep else _WRITTEN:
        held[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pinned(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: as :func:`saved`, and keeps partitions and their order."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place_of(df: DataFrame, name: str) -> int | None:
    """Where a column stands: the name as written, else in other case where the session ignores case, else nowhere."""
    if name in df.columns:
        return df.columns.index(name)
    if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true":
        return None
    return next((i for i, c in enumerate(df.columns) if c.lower() == name.lower()), None)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, whatever else the table has; a missing one is NULL text."""
    places = [place_of(df, n) for n in names]
    apart = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # names that differ in case only are not ambiguous then
    return apart.select(*[F.lit(None).cast("string").alias(n) if i is None else F.col(f"c{i}").alias(n)
                          for n, i in zip(names, places)])


def carried(df: DataFrame) -> DataFrame:
    """One column ``given``, a struct of all the caller's columns by place, so that none of their names can clash."""
    marks = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*marks).select(F.struct(*map(F.col, marks)).alias("given"))


def field(df: DataFrame, name: str) -> Column:
    """A column of ``df`` inside the ``given`` of :func:`carried`; NULL text where ``df`` has none."""
    at = place_of(df, name)
    return (F.lit(None).cast("string") if at is None else F.col(f"given.c{at}")).alias(name)


def given_back(df: DataFrame, rows: DataFrame) -> DataFrame:
    """The caller's columns again, from the ``given`` of ``rows``."""
    return rows.select("given.*").toDF(*df.columns)
