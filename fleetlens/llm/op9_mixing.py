"""Mixing sources to target weights, with DataFrame functions only.

The words of each source are laid end to end and cut into blocks of ``BLOCK`` words. The mix is a run of output slots,
one block each, cut into output shards of ``SLOTS`` slots. Sources hold as many slots as their targets need; a
pseudorandom permutation of all slots deals them to the shards, so the source counts of a shard are a multinomial draw
given the totals (a plain draw would miss the targets by its noise). Slot k of a source maps through the source's own
index permutation to a block, again from the start after each full pass, and blocks are joined by (source, index).
The last slot of a source takes only the words that its target still lacks, so it is met to the word.

Both permutations are swap-or-not shuffles: each round pairs x with (key - x) mod n and swaps by a hash bit, which is a
bijection for every n, needs no table, and is inverted by running the rounds backwards.

Defined results: NULL, empty and blank texts have size 0 and are taken 0 times; NULL is a source of its own, last; rows
equal in id and text are told apart; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.common import WORD_PATTERN, own_columns, pinned, table
from fleetlens.llm.registry import query

WEIGHTS = (5, 2, 1)
SHARE, CEILING = 1.5, 2
BLOCK = 512
SLOTS = 1024
ROUNDS = 24
SEED = 20240229
BUCKETS = 1024  # pieces that a source's rows are summed in, so that a large source is no single task
CHUNK = 4096    # slots made by one row


def word_count(text: Column) -> Column:
    """Words of a text as a long; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def permuted(x: Column, n: Column, key: Column, backwards: bool = False) -> Column:
    """Swap-or-not shuffle of x in 0 .. n-1 under a key; ``backwards`` inverts it."""
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if backwards else F.sequence(F.lit(1), F.lit(ROUNDS))

    def one(acc: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r, F.lit(SEED)), n) - acc, n)
        swap = F.pmod(F.xxhash64(F.greatest(acc, partner), key, r), F.lit(2)) == 1
        return F.when(swap, partner).otherwise(acc)

    return F.aggregate(rounds, x.cast("bigint"), one)


def targets(docs: DataFrame) -> DataFrame:
    """Per source: source, source_id (rank), source_size, target (double) and take, the words it gives.

    The ceiling binds sources in order of their size per weight; with the bound ones fixed the rest share what is left,
    which is the level at which resharing the excess ends. Works on one row per source.
    """
    sums = docs.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sums.withColumn("source_id", F.row_number().over(rank) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_id") % len(WEIGHTS) + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "source_id")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = CEILING * F.col("source_size")
    level = weighted.withColumn("cap", cap).withColumn(
        "level", (SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        / F.sum("weight").over(rest))
    free = F.col("level") * F.col("weight") <= F.col("cap")
    # the first source that its ceiling does not bind sets the level; those before it are at their ceiling
    final = level.withColumn("at", F.row_number().over(by_ratio)).withColumn(
        "open", F.min(F.when(free, F.struct("at", "level"))).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("open") * F.col("weight"), F.col("cap").cast("double")))
    return final.withColumn("target", target).withColumn(
        "take", F.least(F.round("target").cast("bigint"), F.col("cap"))).select(
        "source", "source_id", "source_size", "target", "take")


def packed(docs: DataFrame) -> DataFrame:
    """Rows with ``start``, the place of a document's first word among its source's words, and ``copy``, which tells rows
    equal in source, id and text apart (those without words share their start)."""
    bucketed = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(BUCKETS)))
    totals = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("total"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"),
                          F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    return (bucketed.withColumn("inner", F.sum("size").over(inside) - F.col("size"))
            .withColumn("copy", F.row_number().over(inside))
            .join(bases, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
            .select("doc_id", "text_hash", "copy", "source", "size", (F.col("base") + F.col("inner")).alias("start")))


def slots(plan: DataFrame) -> DataFrame:
    """The output slots: source_id, lap, block, taken words of the block, and where it goes (shard, slot)."""
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)
    blocks = F.ceil(F.col("source_size") / BLOCK)
    short = F.col("source_size") - (F.col("blocks") - 1) * BLOCK
    # slots in the full laps, then in the begun one; the short last block comes where the permutation puts it
    counted = (plan.filter("take > 0").withColumn("blocks", blocks).withColumn("short", short)
               .withColumn("short_at", permuted(F.col("blocks") - 1, F.col("blocks"), F.col("source_id"), backwards=True))
               .withColumn("laps", F.floor(F.col("take") / F.col("source_size")))
               .withColumn("rest", F.col("take") % F.col("source_size"))
               .withColumn("left", F.when(F.col("rest") > F.col("short_at") * BLOCK + F.col("short"),
                                          F.ceil((F.col("rest") + BLOCK - F.col("short")) / BLOCK))
                           .otherwise(F.ceil(F.col("rest") / BLOCK)))
               .withColumn("n", F.col("laps") * F.col("blocks") + F.col("left"))
               .withColumn("all", F.sum("n").over(everything))
               .withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))))
    chunked = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK))))
    low = F.col("chunk") * CHUNK
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = chunked.repartition(parts, "source_id", "chunk").withColumn(
        "k", F.explode(F.sequence(low, F.least(low + CHUNK, F.col("n")) - 1)))
    turn = F.col("k") % F.col("blocks")
    begin = F.col("turn") * BLOCK - F.when(F.col("turn") > F.col("short_at"), BLOCK - F.col("short")).otherwise(0)
    length = F.when(F.col("turn") == F.col("short_at"), F.col("short")).otherwise(BLOCK)
    return (each.withColumn("turn", turn).withColumn("lap", F.floor(F.col("k") / F.col("blocks")))
            .withColumn("block", permuted(F.col("turn"), F.col("blocks"), F.col("source_id")))
            .withColumn("at", permuted(F.col("ahead") + F.col("k"), F.col("all"), F.lit(-1)))
            .withColumn("words", F.least(length, F.when(F.col("lap") < F.col("laps"), F.lit(BLOCK))
                                         .otherwise(F.col("rest") - begin)))
            .select("source_id", "lap", "block", "words", F.floor(F.col("at") / SLOTS).alias("shard"),
                    (F.col("at") % SLOTS).alias("slot")))


def mix(docs: DataFrame) -> DataFrame:
    """One row per document and slot that takes words of it: doc_id, text_hash, copy, source, size, source_size, target, start,
    and lap, shard, slot, from_word, to_word (words of the document); a document not taken has one row without them."""
    slim = pinned(own_columns(docs, "doc_id", "text", "source").select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.col("source").cast("string"), word_count(F.col("text")).alias("size")))
    plan = pinned(targets(slim))
    each = packed(slim).join(plan.select(F.col("source").alias("_s"), "source_id", "source_size", "target"),
                             F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    first = F.floor(F.col("start") / BLOCK)
    last = F.floor((F.col("start") + F.greatest(F.col("size"), F.lit(1)) - 1) / BLOCK)
    pieces = (each.withColumn("block", F.explode(F.sequence(first, last)))
              .withColumn("low", F.greatest(F.col("start") - F.col("block") * BLOCK, F.lit(0)))
              .withColumn("high", F.least(F.col("start") + F.col("size") - F.col("block") * BLOCK, F.lit(BLOCK))))
    taken = slots(plan)
    # the planner takes exploded rows for few and would broadcast the slots, which grow with the data
    joined = pieces.join(taken.hint("merge").select(F.col("source_id").alias("_i"), F.col("block").alias("_b"), "lap", "words", "shard", "slot"),
                         (F.col("source_id") == F.col("_i")) & (F.col("block") == F.col("_b")), "left")
    word = F.col("block") * BLOCK - F.col("start")
    got = F.col("words").isNotNull() & (F.least("high", "words") > F.col("low"))
    return joined.select(
        "doc_id", "text_hash", "copy", "source", "source_id", "size", "source_size", "target", "start",
        *[F.when(got, c).alias(n) for n, c in (
            ("lap", F.col("lap")), ("shard", F.col("shard")), ("slot", F.col("slot")),
            ("from_word", word + F.col("low")), ("to_word", word + F.least("high", "words")))])


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each lap that takes words of a document gives a row with its columns and those words.

    A wholly taken text is kept as it is; a part is its words joined by a space. ``n_chars`` follows the new text.
    Texts are shuffled once.
    """
    parts = mix(docs).groupBy("source_id", "start", "doc_id", "text_hash", "copy", "source", "size", "lap").agg(
        F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("parts"),
        F.sum(F.col("to_word") - F.col("from_word")).alias("words"))
    laps = parts.filter("lap IS NOT NULL").groupBy("source_id", "start", "doc_id", "text_hash", "copy", "source", "size").agg(
        F.sort_array(F.collect_list(F.struct("lap", "words", "parts"))).alias("laps"))
    by_text = laps.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("source").alias("_source"),
                           ).agg(F.sort_array(F.collect_list(F.struct("start", "laps", "size"))).alias("_rows"))
    numbered = docs.withColumn("_text_hash", F.xxhash64("text")).withColumn("_n", F.row_number().over(
        Window.partitionBy("doc_id", "_text_hash", "source").orderBy(F.lit(0))))
    joined = numbered.join(by_text, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
                           & F.col("source").eqNullSafe(F.col("_source")))
    out = joined.withColumn("_row", F.get("_rows", F.col("_n") - 1)).withColumn("_lap", F.explode("_row.laps"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.flatten(F.transform(F.col("_lap.parts"), lambda p: F.slice(
        words, (p["from_word"] + 1).cast("int"), (p["to_word"] - p["from_word"]).cast("int")))), " ")
    new = F.when(F.col("_lap.words") == F.col("_row.size"), F.col("text")).otherwise(cut)
    return out.withColumn("_new", new).select(*[
        F.col("_new").alias("text") if c == "text" else F.length("_new").cast(docs.schema[c].dataType).alias(c)
        if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (mix(table(spark, sf_dir, "documents"))
            .groupBy("source_id", "start", "doc_id", "text_hash", "copy", "size", "source_size", "target")
            .agg(F.coalesce(F.sum(F.col("to_word") - F.col("from_word")), F.lit(0)).cast("bigint").alias("taken"))
            .select("doc_id", "size", "source_size", "target", "taken"))
