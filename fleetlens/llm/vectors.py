"""Vectors as integers: what the operators on embeddings share.

A vector counts if it is not NULL, has no NULL and no non-finite entry, and has the table's dimension, which is the
length that most such vectors have (of equally frequent lengths the greatest). Integers are exact; an entry whose
integer is beyond a bound that the caller names stops the job with an ArithmeticError, as an overflow does elsewhere in
Spark, since results could no longer be exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetlens.llm.common import own_columns, saved

SCALE = 1024
#: Fixed dtype of stored integers, the same on every machine.
STORED = np.dtype("<i8")


def usable(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column: rows whose entries are all there and finite, their first places, and all entries as doubles."""
    values = lists.values
    entries = values.to_numpy(zero_copy_only=False).astype(np.float64)  # NULL becomes nan
    ends = lists.offsets.to_numpy()
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    good = (bad[ends[1:]] == bad[ends[:-1]]) & (ends[1:] > ends[:-1])
    if lists.null_count:
        good &= ~lists.is_null().to_numpy(zero_copy_only=False)
    return np.flatnonzero(good), ends, entries


def dimension_of(vectors: DataFrame) -> int:
    """The table's dimension, 0 if no vector counts."""
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, ends, _ = usable(batch.column(0))
                size, n = np.unique((ends[1:] - ends[:-1])[rows], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(n, pa.int64())], ["size", "n"])

    top = (vectors.select(F.col("embedding").cast("array<double>")).mapInArrow(lengths, "size int, n bigint").groupBy("size").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), F.desc("size")).limit(1).collect())
    return top[0]["size"] if top else 0


def integer_vectors(embeddings: DataFrame, bound: int, shift: int = 0) -> tuple[DataFrame, int]:
    """Stored rows vec_id, label, ints (binary: ``floor(1024 * entry) + shift`` of each entry), and the dimension."""
    own = own_columns(embeddings, "vec_id", "label", "embedding")
    if not isinstance(own.schema["embedding"].dataType, T.ArrayType):
        own = own.withColumn("embedding", F.lit(None).cast("array<float>"))
    dimension = dimension_of(own)
    schema = T.StructType([own.schema["vec_id"], own.schema["label"], T.StructField("ints", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not dimension:
                continue
            rows, ends, entries = usable(batch.column("embedding"))
            rows = rows[(ends[1:] - ends[:-1])[rows] == dimension]
            with np.errstate(over="ignore"):
                whole = np.floor(SCALE * entries[ends[rows][:, None] + np.arange(dimension)])
            if len(rows) and not np.abs(whole).max() < bound:
                raise ArithmeticError(f"an entry of a vector is {SCALE} times beyond {bound}: its integer would not be exact")
            ints = (whole.astype(STORED) + shift).astype(STORED)
            kept = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [kept.column("vec_id").cast(arrow.field("vec_id").type), kept.column("label").cast(arrow.field("label").type),
                 pa.array([r.tobytes() for r in ints], pa.binary())], schema=arrow)

    return saved(own.withColumn("embedding", F.col("embedding").cast("array<double>")).mapInArrow(run, schema)), dimension


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """Stored integers of a batch as (rows, dimension)."""
    return np.frombuffer(b"".join(column.to_pylist()), STORED).reshape(-1, dimension).astype(np.int64)
