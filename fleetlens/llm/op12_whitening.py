"""Embedding whitening: blockwise QR, bidiagonal qd solver, twisted factorisations.

Vectors become integers (``floor(1024 * entry) + SHIFT``), whose sums are exact. Each task centres its rows and folds
them into one triangular factor, block after block; factors meet in groups of ``FAN`` until few are left, and the last
one R has ``R'R = n V`` with the covariance V without V ever being formed. The solver in ``qd`` then finds
singular values and right directions of R, of the dimension's size whatever the number of rows: the directions are the
components, squares of the values over n their eigenvalues. A last pass over the rows centres, projects and scales.

Centring: with S = n m + r, an entry's distance to its mean is ``(x - m) - r / n``, and ``n (x - m) - r`` exactly.

Defined results: vectors that do not count (see ``vectors``) have no row; components whose eigenvalue is zero up to
rounding do not exist, so that a table of equal vectors, of one vector or of none gives no rows; of a
component's two signs the one whose greatest entry is positive is taken; repeated rows and NULL ids keep their rows; a
deviation that no long can hold is NULL; other columns are not read. Integers of 2^52 or more stop the job.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetlens.llm.common import saved, table
from fleetlens.llm.qd import right_directions
from fleetlens.llm.registry import query
from fleetlens.llm.vectors import integer_vectors, matrix

SHIFT = 100_000
COMPONENTS = 8
FAN = 64
BOUND = 1 << 52
LONG = 1 << 63


class Mean(NamedTuple):
    """Number of vectors, and per dimension the whole part and the rest of sum over n."""

    n: int
    whole: list[int]
    rest: list[int]


def mean_of(vectors: DataFrame, dimension: int) -> Mean:
    """Exact mean. Sums leave the tasks as decimal text, since a long may not hold them."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dimension
        for batch in batches:
            x = matrix(batch.column("ints"), dimension)
            n += len(x)
            high, low = (x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)
            total = [t + (int(h) << 26) + int(w) for t, h, w in zip(total, high, low)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dimension), pa.int32()), pa.array([str(x) for x in [n, *total]])],
                                         ["place", "total"])

    got = dict(vectors.select("ints").mapInArrow(sums, "place int, total string").groupBy("place")
               .agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("string")).collect())
    n = int(got.get(-1, 0))
    parts = [divmod(int(got[i]), n) for i in range(dimension)] if n else []
    return Mean(n, [w for w, _ in parts], [r for _, r in parts])


def centred(x: np.ndarray, mean: Mean) -> np.ndarray:
    """Distances to the mean as doubles."""
    return (x - np.array(mean.whole, np.int64)).astype(np.float64) - np.array(mean.rest, np.float64) / mean.n


def deviations(x: np.ndarray, mean: Mean) -> list[int | None]:
    """Per row the sum of ``(n x - S)^2``, exactly; None where a long cannot hold it."""
    away = x - np.array(mean.whole, np.int64)
    largest = mean.n * (int(np.abs(away).max(initial=0)) + 1)
    if largest * largest * x.shape[1] < LONG:
        scaled = mean.n * away - np.array(mean.rest, np.int64)
        return (scaled * scaled).sum(axis=1).tolist()
    scaled = away.astype(object) * mean.n - np.array(mean.rest, object)
    return [total if total < LONG else None for total in (scaled * scaled).sum(axis=1)]


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def triangular_factor(vectors: DataFrame, dimension: int, mean: Mean) -> np.ndarray:
    """R of the QR factorisation of all centred rows, as a square matrix."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = np.zeros((0, dimension))
        for batch in batches:
            if batch.num_rows:
                factor = triangle(np.concatenate([factor, centred(matrix(batch.column("ints"), dimension), mean)]))
        if len(factor):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              pa.array([factor.tobytes()], pa.binary())], ["block", "factor"])

    def stacked(found: pa.Table) -> np.ndarray:
        found = found.sort_by("block")  # one order, so that reruns agree to the last bit
        return triangle(np.concatenate([np.frombuffer(f, np.float64).reshape(-1, dimension) for f in found["factor"].to_pylist()]))

    def met(group: tuple, found: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([group[0].as_py()], pa.int64()), "factor": pa.array([stacked(found).tobytes()], pa.binary())})

    factors = saved(vectors.select("ints").mapInArrow(blocks, "block bigint, factor binary"))
    while factors.count() > FAN:
        up = factors.withColumn("group", F.floor(F.col("block") / FAN))
        factors = saved(up.groupBy("group").applyInArrow(met, "block bigint, factor binary"))
    last = stacked(factors.toArrow())
    return np.concatenate([last, np.zeros((dimension - len(last), dimension))])


def whitened(vectors: DataFrame, mean: Mean, transform: np.ndarray) -> DataFrame:
    """vec_id, deviation and the whitened coordinates (array) of every stored vector."""
    schema = T.StructType([vectors.schema["vec_id"], T.StructField("deviation", T.LongType()),
                           T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)
    dimension, width = transform.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("ints"), dimension)
                out = centred(x, mean) @ transform
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(deviations(x, mean), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(out.ravel()))
                     .cast(arrow.field("whitened").type)], schema=arrow)

    return vectors.select("vec_id", "ints").mapInArrow(run, schema)


class Whitening(NamedTuple):
    """Stored rows (vec_id, deviation, whitened), and what transforms other vectors alike."""

    rows: DataFrame
    mean: Mean
    components: np.ndarray   # unit columns
    eigenvalues: np.ndarray  # falling
    explained: np.ndarray    # shares of the whole variance
    identity_error: float


def whiten(embeddings: DataFrame, components: int = COMPONENTS, shift: int = SHIFT) -> Whitening:
    """Whitened coordinates of all vectors in the leading components."""
    vectors, dimension = integer_vectors(embeddings, BOUND, shift)
    mean = mean_of(vectors, dimension)
    if mean.n:
        factor = triangular_factor(vectors, dimension, mean)
        values, directions = right_directions(factor, components)
        eigenvalues, explained = values ** 2 / mean.n, values ** 2 / max((factor * factor).sum(), np.finfo(np.float64).tiny)
    else:
        directions, eigenvalues, explained = np.zeros((0, 0)), np.zeros(0), np.zeros(0)
    rows = whitened(vectors, mean, directions / np.sqrt(eigenvalues))
    if not len(eigenvalues):
        return Whitening(rows.limit(0), mean, directions, eigenvalues, explained, 0.0)
    rows = saved(rows)
    pairs = [(i, j) for i in range(len(eigenvalues)) for j in range(i + 1)]
    covariances = rows.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(covariances, pairs))
    return Whitening(rows, mean, directions, eigenvalues, explained, float(error))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"))
    explained = F.array(*[F.lit(float(x)) for x in found.explained]).cast("array<double>")
    each = found.rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(found.mean.n).cast("bigint").alias("n"), "deviation",
                       "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(found.identity_error).alias("identity_error"))
