"""Exact duplicates by a tree of merged digest runs, with DataFrame functions only.

Every input partition is a run: its rows as (digest, best row, count), sorted by digest. In each round the runs of
``2 ** BITS`` neighbouring numbers meet, that many binomial rounds at once: entries are exchanged by (run group,
digest), sorted, and equal digests merged into one entry that keeps the best row and the count. A digest stands at most
once in each run of a level, so however often a text repeats, no task gets more than ``2 ** BITS`` entries of it from
one group. The last round leaves one run. Its repeated digests then go back down the tree, level by level, each entry
again to at most ``2 ** BITS`` children, and from the first level to the rows of the runs.

Entries merge only if SHA-256, length and a second, unrelated 64-bit hash all agree, at every level.

Texts are compared after lower-casing A to Z only; which row stays is decided by doc_id (``keep``: "largest" or
"smallest"). Defined results: NULL text counts as empty; a NULL doc_id loses against any other and is ``keep_id`` only
where a group has no other; of rows equal in text and doc_id just one stays; empty tables give empty results; other
columns are not read. Every level is written to the shared folder, so a lost executor repeats tasks of one round.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import carried, field, given_back, own_columns, saved, table
from fleetlens.llm.registry import query

BITS = 3  # runs that meet in a round, as a power of two
#: What must agree for two rows to hold the same text.
KEY = ["digest", "n_bytes", "second"]


def normalised(text: Column) -> Column:
    """A to Z in lower case, nothing else changed; NULL is empty."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    # lower() touches other letters too, so it serves for texts of single-byte characters only, where it is faster
    return F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(
        F.translate(whole, string.ascii_uppercase, string.ascii_lowercase))


def numbered(docs: DataFrame) -> DataFrame:
    """Rows with ``run``, the number of their partition, and ``row``, unique. To be written before it is used twice."""
    return docs.withColumn("run", F.spark_partition_id().cast("bigint")).withColumn("row", F.monotonically_increasing_id())


def digests(rows: DataFrame) -> DataFrame:
    """(run, row, doc_id, text) to run, row, doc_id and the key of the normalised text."""
    text = rows.withColumn("text", normalised(F.col("text")))
    return text.select("run", "row", "doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
                       F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("second"))


def merged(entries: DataFrame, best: Column, count: Column) -> DataFrame:
    """One round: entries of neighbouring runs meet, equal keys become one entry. ``best`` is an aggregate of structs,
    which Spark evaluates over sorted rows, so that a task merges sorted runs and holds one entry at a time."""
    return entries.withColumn("run", F.shiftright("run", BITS)).groupBy("run", *KEY).agg(best.alias("best"), count.alias("n"))


def classes(rows: DataFrame, keep: str = "largest") -> DataFrame:
    """Digest rows to row, doc_id, digest, keep_id, group_size and kept. ``rows`` must be a stored table."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is 'largest' or 'smallest', not {keep!r}")
    choose = F.max if keep == "largest" else F.min
    known = F.col("doc_id").isNotNull() if keep == "largest" else F.col("doc_id").isNull()
    level = rows.withColumn("best", F.struct(known.alias("known"), "doc_id", "row"))
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    levels = [saved(merged(level, choose("best"), F.count(F.lit(1))))]
    runs = -(-runs >> BITS)
    while runs > 1:
        levels.append(saved(merged(levels[-1], choose("best"), F.sum("n"))))
        runs = -(-runs >> BITS)
    # back down: only digests that stand more than once
    found = levels[-1].filter("n > 1")
    for level in reversed(levels[:-1]):
        found = below(level.select("run", *KEY), found, "inner").select(
            "run", *KEY, F.col("_best").alias("best"), F.col("_n").alias("n"))
    out = below(rows, found, "left")
    return out.select("row", "doc_id", "digest", F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_best.doc_id")).alias("keep_id"),
                      F.coalesce("_n", F.lit(1)).cast("bigint").alias("group_size"),
                      F.coalesce(F.col("_best.row") == F.col("row"), F.lit(True)).alias("kept"))


def below(entries: DataFrame, parents: DataFrame, how: str) -> DataFrame:
    """Entries with ``_best`` and ``_n`` of their entry one level up."""
    up = parents.select(F.col("run").alias("_run"), *[F.col(k).alias(f"_{k}") for k in KEY], F.col("best").alias("_best"),
                        F.col("n").alias("_n"))
    same = F.shiftright("run", BITS) == F.col("_run")
    for k in KEY:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return entries.join(up, same, how)


def groups(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = saved(digests(numbered(own_columns(docs, "doc_id", "text"))))
    return classes(rows, keep).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One document of each group of equal texts, with all columns that came, whatever their names."""
    whole = saved(numbered(carried(docs)))
    stay = classes(saved(digests(whole.select("run", "row", field(docs, "doc_id"), field(docs, "text")))), keep)
    return given_back(docs, whole.join(stay.filter("kept").select("row"), "row", "left_semi"))


_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM t
"""


@query("op11_exact_dedup", _SQL)
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
