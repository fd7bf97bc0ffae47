"""Quality rules as a ledger: every rule evaluated once, failures kept as bits, policies applied to the bits.

``ledger`` gives each text its measurements and one ``long`` whose bit i says that rule i failed. A policy is a version
with a mask of enforced rules; ``verdicts`` is ``bits & mask``, so a new version costs no new pass over the texts, and
``ablations`` counts, from the few distinct bit patterns, what each rule rejects and what only it rejects.

Defined results: a NULL or wordless text has no words and fails ``few_words``; repeated rows are judged one by one;
extra columns are left alone (the ledger has only its own).
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import WORD, arrow_map, own_columns, table
from fleetlens.llm.registry import query

SYMBOL = re.compile(r"[#*$%&|<>]")  # fixed value: the characters counted as symbols

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words"]

#: Name and condition of failure, over the measurements; the position is the bit.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "n_lines >= 5 AND 100 * n_dup_lines > 40 * n_lines"),
    ("short_words", "n_words > 0 AND word_chars < 2 * n_words"),
    ("long_words", "n_words > 0 AND word_chars > 12 * n_words"),
    ("shouting", "n_words >= 50 AND 100 * n_upper_words > 60 * n_words"),
]
BASE = ("few_words", "repeated_words")


def mask(*names: str) -> int:
    """Bits of the named rules."""
    known = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    return sum(known[n] for n in set(names))


#: Versioned policies: which rules are enforced.
POLICIES = {
    1: mask(*BASE),
    2: mask(*BASE, "many_symbols", "repeated_lines"),
    3: mask(*[name for name, _ in RULES]),
}
CURRENT = 3


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    if not text:
        return (0,) * len(MEASURES)
    words = WORD.findall(text)
    n = len(words)
    windows = list(zip(words, words[1:], words[2:]))
    covered = 0
    if len(set(windows)) < len(windows):
        counts, end = Counter(windows), 0
        for i, window in enumerate(windows):
            if counts[window] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (n, sum(map(len, words)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)), covered, len(lines),
            sum(map(str.isupper, words)))


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, the measurements and ``bits``, one row per row of the input, in one narrow pass."""
    slim = own_columns(docs, key, text).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    key_type = slim.schema["key"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            rows = [measure(t.as_py()) for t in batch.column("text")]
            return {"key": batch.column("key")} | dict(zip(MEASURES, map(list, zip(*rows))))
        return step

    measured = arrow_map(slim, make, f"key {key_type}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    bits = reduce(lambda a, b: a.bitwiseOR(b), [
        F.when(F.expr(rule), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        for i, (_, rule) in enumerate(RULES)])
    return measured.select(F.col("key").alias(key), *MEASURES, bits.alias("bits"))


def verdicts(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` by the policy of the version; the base rules always hold."""
    base, enforced = mask(*BASE), POLICIES[version] | mask(*BASE)
    return rows.withColumns({
        "base_failed": F.col("bits").bitwiseAND(F.lit(base)) != 0,
        "kept": F.col("bits").bitwiseAND(F.lit(enforced)) == 0,
    })


def ablations(rows: DataFrame) -> DataFrame:
    """Per policy version and enforced rule: rows it fails, and rows that only it rejects (kept without it).

    The ledger is first reduced to its distinct bit patterns, at most two to the number of rules.
    """
    spark = rows.sparkSession
    patterns = rows.groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    plans = spark.createDataFrame(
        [(v, m, name, 1 << i) for v, m in POLICIES.items() for i, (name, _) in enumerate(RULES) if m >> i & 1],
        "version int, enforced bigint, rule string, bit bigint")
    hit = F.col("bits").bitwiseAND(F.col("enforced"))
    return (patterns.join(plans, hit.bitwiseAND(F.col("bit")) != 0)
            .groupBy("version", "rule")
            .agg(F.sum("n").alias("failed"), F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("only")))


def keep_good(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns."""
    def make():
        def step(batch: pa.RecordBatch) -> dict:
            rows = [measure(t.as_py()) for t in batch.column("text")]
            return {n: batch.column(n) for n in batch.schema.names} | {
                f"_{m}": list(c) for m, c in zip(MEASURES, zip(*rows))}
        return step

    if not docs.columns:
        return docs
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    measured = arrow_map(docs, make, schema + ", " + ", ".join(f"_{m} bigint" for m in MEASURES))
    enforced = POLICIES[version] | mask(*BASE)
    names = {m: f"_{m}" for m in MEASURES}
    for i, (_, rule) in enumerate(RULES):
        if enforced >> i & 1:
            for m in MEASURES:
                rule = re.sub(rf"\b{m}\b", names[m], rule)
            measured = measured.filter(f"NOT ({rule})")
    return measured.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
u AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT r, i, word, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM u
      WINDOW p AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, CASE WHEN w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, word, w2, w3) > 1 THEN 1 ELSE 0 END AS hit
      FROM g),
e AS (SELECT r, greatest(hit, coalesce(lag(hit, 1) OVER p, 0), coalesce(lag(hit, 2) OVER p, 0)) AS covered FROM c
      WINDOW p AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, sum(covered)::BIGINT AS n_repeat_words FROM e GROUP BY r),
l AS (SELECT r, x AS line FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d)
      WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines, count(*)::BIGINT AS n_lines FROM l GROUP BY r),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines,
    len(list_filter(ws, lambda x: upper(x) = x AND lower(x) <> x))::BIGINT AS n_upper_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR (n_lines >= 5 AND 100 * n_dup_lines > 40 * n_lines)
       OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 100 * n_upper_words > 60 * n_words) AS kept
FROM b
"""


@query("op8_quality_rules", ORACLE)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verdicts(ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
