"""Sharding into contiguous, byte-balanced shards by a global prefix sum.

Rows are laid out in the order of (doc_id, text hash) over range partitions of slim rows. Totals per partition give each
partition its start; the running size inside it gives every row its place, and equal cuts of the total give the shard
(by the middle of the row, so no shard is off its target by more than a row). Only totals per partition, and per
partition and shard, reach the driver: as many numbers as there are partitions.

Defined results: size is UTF-8 bytes of the text plus 8 (NULL text: 8); NULL ids come first; equal rows are
interchangeable and all placed; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.common import arrow_map, carried, field, own_columns, pinned, table
from fleetlens.llm.registry import query

SHARDS = 24
OVERHEAD = 8


def layout(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, text_hash, size, text_crc32, shard, slot (0, 1, .. in the shard), place (overall)."""
    slim = own_columns(docs, "doc_id", "text").select(
        "doc_id", F.xxhash64("text").alias("text_hash"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    parts = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "text_hash", "size"]
    # The number of a row's range is kept with the row: a caller's coalesce puts several ranges into one task.
    slim = pinned(slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != "part")

    totals = {r["part"]: (r["bytes"], r["rows"]) for r in slim.groupBy("part").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()}
    last = max(totals, default=-1) + 1
    starts = [0, *accumulate(totals.get(p, (0, 0))[0] for p in range(last))]
    firsts = [0, *accumulate(totals.get(p, (0, 0))[1] for p in range(last))]
    whole = starts[-1]

    def placed():
        at: dict[int, tuple[int, int]] = {}  # bytes and rows so far, by range

        def step(batch: pa.RecordBatch) -> dict:
            size, part = batch.column("size").to_numpy(), batch.column("part").to_numpy()
            ends, place = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            for i, j in zip(edges, edges[1:]):  # rows of one range follow each other
                p = int(part[i])
                done, rows = at.get(p, (starts[p], firsts[p]))
                ends[i:j] = np.cumsum(size[i:j]) + done
                place[i:j] = rows + np.arange(j - i)
                at[p] = int(ends[j - 1]), rows + int(j - i)
            shard = ((2 * ends - size) * shards) // (2 * whole)
            return {n: batch.column(n) for n in batch.schema.names} | {"shard": shard.astype(np.int32), "place": place}
        return step

    laid = arrow_map(slim, placed, f"{kept}, shard int, place bigint")
    first = {r["shard"]: r["first"] for r in laid.groupBy("shard").agg(F.min("place").alias("first")).collect()}
    start = F.element_at(F.array(*[F.lit(first.get(s, 0)).cast("bigint") for s in range(shards)]), F.col("shard") + 1)
    return laid.withColumn("slot", F.col("place") - start)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (columns of these names are replaced). Texts are shuffled once.

    Rows equal in id and text share the run of places found for them and are numbered inside it. All columns of the
    caller travel as one struct, so whatever they are called they come back as they were.
    """
    docs = docs.drop("shard", "slot")
    runs = layout(docs, shards).groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("place", "shard", "slot"))).alias("places"))
    right = runs.select(F.col("doc_id").alias("right_id"), F.col("text_hash").alias("right_hash"), "places")
    rows = carried(docs)
    left = rows.select("given", field(docs, "doc_id"), F.xxhash64(field(docs, "text")).alias("text_hash"))
    numbered = left.withColumn("number", F.row_number().over(
        Window.partitionBy("doc_id", "text_hash").orderBy(F.lit(0))))
    joined = numbered.join(right, F.col("doc_id").eqNullSafe(F.col("right_id")) & (F.col("text_hash") == F.col("right_hash")))
    place = F.element_at("places", F.col("number"))
    marks = [f"c{i}" for i in range(len(docs.columns))]
    return joined.select(*[F.col(f"given.{m}") for m in marks], place["shard"], place["slot"]).toDF(*docs.columns, "shard", "slot")


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
