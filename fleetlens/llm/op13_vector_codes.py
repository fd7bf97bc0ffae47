"""Vector codes: product quantisation in integers, with distances by limb-split exact matrix products.

Distances are ``|x|^2 - 2 x.c + |c|^2`` in 64-bit integers. The dot products come from float64 BLAS: both sides are
split into signed limbs so narrow that a product of two limb matrices, and every partial sum inside it, stays below
2^53 in size and so is exact whatever order BLAS adds in; products of limbs are shifted and added as integers. How many
limbs are needed follows from the largest entry, mostly one. The nearest entry is the first least distance.

A codebook per part starts from the vectors of the smallest ids (``ENTRIES``) and is refined in ``ROUNDS`` rounds: each
task assigns its vectors and sums them per entry, Spark adds the sums, the driver divides (one codebook's worth of
numbers: parts x entries x width, whatever the table's size). Integer sums do not depend on the order of adding, so
reruns and other partitionings agree.

Defined results: vectors that do not count (see ``vectors``) have no row; a dimension that is no multiple of the parts
is filled up with zeros; with fewer vectors than entries each vector starts an entry; rows of equal id are ordered by
their integers and each keeps its row; a NULL id comes last; NULL labels are one label; an empty table gives an empty
result; other columns are not read. Integers of 2^27 or more in size stop the job: squared distances would not fit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetlens.llm.common import saved, table
from fleetlens.llm.registry import query
from fleetlens.llm.vectors import integer_vectors, matrix

PARTS, ENTRIES, ROUNDS = 4, 256, 4
BOUND = 1 << 27
EXACT = 53  # bits in which float64 counts without gaps
BLOCK = 2048  # vectors whose distances a task holds at once


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Signed limbs of ``bits`` bits, lowest first, as float64: ``sum(limb << (bits * i)) == x``."""
    out, size = [], int(np.abs(x).max()) if x.size else 0
    while size >> bits:
        high = x >> bits  # floors, so that the low limb is never negative
        out.append((x - (high << bits)).astype(np.float64))
        x, size = high, int(np.abs(high).max())
    out.append(x.astype(np.float64))
    return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of integer matrices, exact in int64 as long as the results fit."""
    bits = (EXACT - max(a.shape[1] - 1, 0).bit_length()) // 2
    out = np.zeros((len(a), len(b)), np.int64)
    for i, low in enumerate(limbs(a, bits)):
        for j, other in enumerate(limbs(b, bits)):
            out += (low @ other.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first nearest entry of each row, and its squared distance."""
    index, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    norms = (book * book).sum(axis=1)
    for at in range(0, len(x), BLOCK):
        rows = x[at:at + BLOCK]
        score = norms - 2 * exact_products(rows, book)
        best = score.argmin(axis=1)
        index[at:at + BLOCK] = best
        distance[at:at + BLOCK] = score[np.arange(len(rows)), best] + (rows * rows).sum(axis=1)
    return index, distance


def cut(x: np.ndarray, parts: int) -> np.ndarray:
    """(rows, dimension) to (parts, rows, width), filled up with zeros."""
    width = -(-x.shape[1] // parts)
    x = np.pad(x, ((0, 0), (0, width * parts - x.shape[1])))
    return np.ascontiguousarray(x.reshape(len(x), parts, width).swapaxes(0, 1))


def first_books(vectors: DataFrame, dimension: int, parts: int, entries: int) -> np.ndarray:
    """Codebooks (parts, entries, width) from the vectors of the smallest ids."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "ints").select("ints").limit(entries).collect()
    return cut(matrix(pa.array([bytes(r["ints"]) for r in rows], pa.binary()), dimension), parts)


def refined(vectors: DataFrame, dimension: int, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floor of the mean of its parts, an unused one stays."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, width + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                for p, x in enumerate(cut(matrix(batch.column("ints"), dimension), parts)):
                    index = nearest(x, books[p])[0] + p * entries
                    np.add.at(total, index, np.pad(x, ((0, 0), (0, 1)), constant_values=1))
        used = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, width + 1), pa.int32()), pa.array(np.tile(np.arange(width + 1), len(used)), pa.int32()),
             pa.array(total[used].ravel(), pa.int64())], ["entry", "place", "total"])

    got = (vectors.select("ints").mapInArrow(sums, "entry int, place int, total bigint").groupBy("entry", "place")
           .agg(F.sum("total").alias("total")).toArrow())
    total = np.zeros((parts * entries, width + 1), np.int64)
    total[got["entry"].to_numpy(), got["place"].to_numpy()] = got["total"].to_numpy()
    used = total[:, -1] > 0
    out = books.reshape(parts * entries, width).copy()
    out[used] = total[used, :-1] // total[used, -1:]
    return out.reshape(books.shape)


def encoded(vectors: DataFrame, dimension: int, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (binary, one byte for each part) and error of every stored vector."""
    schema = T.StructType([vectors.schema["vec_id"], vectors.schema["label"], T.StructField("code", T.BinaryType()),
                           T.StructField("error", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [nearest(x, book) for x, book in zip(cut(matrix(batch.column("ints"), dimension), len(books)), books)]
                codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.array(sum(distance for _, distance in found), pa.int64())], schema=arrow)

    return vectors.mapInArrow(run, schema)


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors (vec_id, label, code, error) and the codebooks (parts, entries, width) that decode them."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part: 1 to 256 entries")
    vectors, dimension = integer_vectors(embeddings, BOUND)
    books = first_books(vectors, dimension, parts, entries) if dimension else np.zeros((parts, 0, 0), np.int64)
    for _ in range(rounds if dimension else 0):
        books = refined(vectors, dimension, books)
    return encoded(vectors, dimension, books), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all integers of the codebooks by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _sql() -> str:
    """The same rounds in SQL: each part's distances to all entries, the first least one, and floors of means."""
    far = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
cuts AS MATERIALIZED (
  SELECT vec_id, label, p.part, list_slice(v, p.part * len(v) // {PARTS} + 1, (p.part + 1) * len(v) // {PARTS}) AS x
  FROM kept, (SELECT unnest(range({PARTS})) AS part) p),
book0 AS MATERIALIZED (
  SELECT part, rn - 1 AS entry, x AS c FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS rn FROM cuts)
  WHERE rn <= {ENTRIES})"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT vec_id, part, any_value(label) AS label, any_value(x) AS x, min(d) AS d, arg_min(entry, (d, entry)) AS entry FROM (
    SELECT cuts.*, entry, {far.format("x", "c")} AS d FROM cuts JOIN book{r} USING (part)) GROUP BY vec_id, part)""")
        if r < ROUNDS:
            steps.append(f"""
book{r + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m, c) AS c FROM book{r} LEFT JOIN (
    SELECT part, entry, list(CAST(floor_mean AS BIGINT) ORDER BY i) AS m FROM (
      SELECT part, entry, i, (sum(x[i]) - (((sum(x[i]) % count(*)) + count(*)) % count(*))) // count(*) AS floor_mean
      FROM near{r}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM cuts))) AS i) GROUP BY part, entry, i)
    GROUP BY part, entry) USING (part, entry))""")
    return f"""WITH {",".join(steps)},
codes AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code,
  CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book{ROUNDS}) AS codebooks_sha256
FROM codes"""


@query("op13_vector_codes", _sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    codes = saved(codes)
    per_label = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(per_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
