"""Removal of repeated byte strings: every byte inside a 200-byte string that also starts elsewhere.

The method asked for merges Burrows-Wheeler transforms of shards byte by byte; that is one pass over all suffixes per byte of
common prefix, 200 passes, which no budget here allows (README). The merge is therefore done on phrases: each text is cut at
anchors that its own content fixes (the smallest hash of ``WINDOW`` consecutive 16-byte strings), so equal strings are cut
alike wherever they stand. The suffixes at anchors are refined in interleave steps that drop what is single: first by the
64 bytes after the anchor, then by the whole phrase with the bytes before it, which is the transform's preceding symbol. An
interval of at least two equal phrases is repeated throughout. Where an interval splits by its preceding bytes, its phrases
are compared at every start, so the result is exact to the byte (up to 64-bit hashes).

The anchor of a 200-byte string is the smallest hash among its own first ``WINDOW`` places, so equal strings have the same
one; the starts that share an anchor form its phrase. Large intervals are cut into blocks whose pairs are dealt to tasks.

Defined results: NULL counts as empty; texts below 200 bytes lose nothing; equal texts of 200 bytes or more lose all; rows
are returned one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.blocks import in_block_pairs, over_units
from fleetlens.llm.common import U64, arrow_map, mixed, own_columns, saved, scratch, table
from fleetlens.llm.registry import query

LENGTH = 200
GRAM = 16
CONTEXT = 64
WINDOW = LENGTH - CONTEXT + 1   # starts among which there is an anchor with CONTEXT bytes left in the string
BLOCK = 4096

_BASE = 0xD1B54A32D192ED03
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


class Hasher:
    """Hashes of any substring from prefix sums modulo 2^64."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, U64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.powers) <= n:
            size = max(2 * n, 1 << 14)
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.concatenate([[U64(1)], np.full(size, U64(_BASE))]), dtype=U64)
                self.inverses = np.cumprod(np.concatenate([[U64(1)], np.full(size, U64(_INVERSE))]), dtype=U64)
        out = np.zeros(n + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTES[data] * self.powers[:n], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((sums[end] - sums[start]) * self.inverses[start])


def phrases(data: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """Per anchor: context hash, phrase hash, anchor, first and last start."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.empty(0, U64 if i < 2 else np.int64) for i in range(5))
    sums = hasher.sums(data)
    at = np.arange(n - GRAM + 1)
    value = hasher.of(sums, at, at + GRAM)
    # the smallest hash of each window, of equal ones the last: its place is in the low half
    value = (value & U64(0xFFFFFFFF00000000)) | (U64(0xFFFFFFFF) - at.astype(U64))
    least, span = value, 1
    while span * 2 <= WINDOW:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    least = np.minimum(least[:len(least) - (WINDOW - span)], least[WINDOW - span:])
    # a start's anchor is the smallest of its own window, so it depends on nothing outside its 200 bytes
    place = (U64(0xFFFFFFFF) - (least[:n - LENGTH + 1] & U64(0xFFFFFFFF))).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [n - LENGTH]])
    anchors = place[first]
    context = hasher.of(sums, anchors, np.minimum(anchors + CONTEXT, n))
    with np.errstate(over="ignore"):
        phrase = mixed(hasher.of(sums, first, last + LENGTH) + (anchors - first).astype(U64) * U64(0x9E3779B97F4A7C15)
                       + (last - first).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    return context, phrase, anchors, first, last


def key_of(text: str | None) -> bytes:
    return xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"))


def phrase_table(docs: DataFrame) -> DataFrame:
    """A row per phrase of each text; ``place`` is its first start, with the distances of its anchor and last start in a byte each."""
    def make():
        hasher = Hasher()

        def step(batch: pa.RecordBatch) -> dict | None:
            found, keys = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                own = phrases(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), hasher)
                found.append(own)
                keys += [key_of(text)] * len(own[0]) if len(own[0]) else []
            context, phrase, anchor, first, last = (np.concatenate(x) for x in zip(*found))
            return {"context": context.view(np.int64), "phrase": phrase.view(np.int64), "key": keys,
                    "place": first << 16 | (anchor - first) << 8 | last - first}
        return step

    return arrow_map(own_columns(docs, "text"), make, "context bigint, phrase bigint, key binary, place bigint")


def in_place(place: Column, name: str) -> Column:
    """``anchor``, ``first`` or ``last`` of a ``place``."""
    first, apart = F.shiftright(place, 16), {"anchor": F.shiftright(place, 8), "last": place}
    return (first + apart[name].bitwiseAND(F.lit(255)) if name in apart else first).cast("int").alias(name)


def keyed_texts(docs: DataFrame) -> DataFrame:
    slim = own_columns(docs, "doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    return arrow_map(slim, lambda: lambda b: {
        "doc_id": b.column("doc_id"), "text": b.column("text"), "key": [key_of(t.as_py()) for t in b.column("text")]},
        f"doc_id {kind}, text string, key binary")


def compared(wanted: DataFrame) -> DataFrame:
    """(key, first, last) of runs of starts whose string is also in another phrase of the interval, for single phrases."""
    dealt = in_block_pairs(wanted, "context", "phrase", F.col("kinds"), BLOCK).select(
        "unit", "phrase", "n", "key", "anchor", "first", "last", "content")

    def work(parts) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for rows, borders in parts:
            unit = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
            columns = {c: rows.column(c).to_numpy() for c in ("phrase", "n", "anchor", "first", "last")}
            # a phrase that stands in several equal texts came several times
            _, once = np.unique(np.stack([unit, columns["phrase"]]), axis=1, return_index=True)
            once.sort()
            blobs, keys = rows.column("content"), rows.column("key")
            contents = [np.frombuffer(blobs[int(i)].as_py(), np.uint8) for i in once]
            sizes = columns["last"][once] - columns["first"][once] + 1
            starts = np.concatenate([[0], np.cumsum([len(c) for c in contents])[:-1]]).astype(np.int64)
            sums = hasher.sums(np.concatenate(contents))
            owner = np.repeat(np.arange(len(once)), sizes)
            step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = starts[owner] + step
            place = columns["anchor"][once][owner] - columns["first"][once][owner] - step  # bytes before the anchor
            with np.errstate(over="ignore"):
                value = mixed(hasher.of(sums, at, at + LENGTH) ^ mixed((unit[once][owner] * 1024 + place).astype(U64)))
            _, number, count = np.unique(value, return_inverse=True, return_counts=True)
            hit = (count[number] > 1) & (columns["n"][once][owner] == 1)
            owner, step = owner[hit], step[hit]
            if not len(owner):
                continue
            new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (step[1:] != step[:-1] + 1)])
            low = np.flatnonzero(new)
            high = np.concatenate([low[1:], [len(owner)]]) - 1
            row = once[owner[low]]
            yield pa.record_batch({
                "key": pa.array([keys[int(i)].as_py() for i in row], pa.binary()),
                "first": pa.array((columns["first"][row] + step[low]).astype(np.int32)),
                "last": pa.array((columns["first"][row] + step[high]).astype(np.int32))})

    return over_units(dealt, work, "key binary, first int, last int")


def live_phrases(docs: DataFrame) -> DataFrame:
    """Stored phrases of the intervals that hold more than one: how often each comes, and how many kinds its interval has."""
    with scratch(docs.sparkSession):
        kinds = saved(phrase_table(docs).groupBy("context", "phrase").agg(F.count(F.lit(1)).alias("n")))
        intervals = kinds.groupBy("context").agg(F.count(F.lit(1)).alias("kinds"), F.max("n").alias("most")).filter("kinds > 1 OR most > 1")
        return saved(kinds.join(intervals.hint("merge"), "context").filter("kinds > 1 OR n > 1").select(
            "context", "phrase", "n", "kinds"), keep=True)


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(key of the text, first, last), stored: runs of starts of strings that also start elsewhere."""
    with scratch(docs.sparkSession):
        # texts and places are dealt once, when it is known which phrases matter
        found = saved(phrase_table(docs).join(live_phrases(docs).hint("merge"), ["context", "phrase"]))
        whole = found.filter("n > 1").select("key", in_place(F.col("place"), "first"), in_place(F.col("place"), "last"))
        return saved(whole.unionByName(compared(phrases_to_compare(docs, found))), keep=True)


def phrases_to_compare(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Each phrase of an interval that splits, once, with its bytes."""
    kinds = found.filter("kinds > 1").groupBy("context", "phrase").agg(
        F.min("n").alias("n"), F.min("kinds").alias("kinds"), F.min(F.struct("key", "place")).alias("one"))
    split = kinds.groupBy("one.key").agg(F.collect_list(F.struct(
        "context", "phrase", "n", "kinds", *[in_place(F.col("one.place"), x) for x in ("anchor", "first", "last")])).alias("places"))
    texts = keyed_texts(docs).select("key", "text").join(split.hint("merge"), "key")

    def cut():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {c: [] for c in ("context", "phrase", "n", "kinds", "key", "anchor", "first", "last", "content")}
            for text, key, places in zip(batch.column("text"), batch.column("key").to_pylist(), batch.column("places").to_pylist()):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for p in places:
                    for name, value in p.items():
                        out[name].append(value)
                    out["key"].append(key)
                    out["content"].append(data[p["first"]:p["last"] + LENGTH])
            return out
        return step

    return arrow_map(texts, cut, "context bigint, phrase bigint, n bigint, kinds bigint, key binary, anchor int, first int, "
                                 "last int, content binary")


def cut_text(text: str | None, runs: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left, bytes removed and maximal removed runs."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not runs:
        return data, 0, 0
    kept, at, spans, end = [], 0, 0, -1
    for low, high in sorted((r["first"], r["last"] + LENGTH) for r in runs):
        if low > end:
            spans += 1
            kept.append(data[at:low])
        end = max(end, high)
        at = max(at, high)
    kept.append(data[at:])
    left = b"".join(kept)
    return left, len(data) - len(left), spans


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    runs = repeated_starts(docs).groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    rows = keyed_texts(docs).join(runs.hint("merge"), "key", "left")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
            for text, runs in zip(batch.column("text"), batch.column("runs").to_pylist()):
                left, removed, spans = cut_text(text.as_py(), runs)
                out["n_bytes"].append(len(left) + removed)
                out["n_removed"].append(removed)
                out["n_spans"].append(spans)
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            return {"doc_id": batch.column("doc_id")} | out
        return step

    return arrow_map(rows.select("doc_id", "text", "runs"), make,
                     f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


@query("op6_repeats")
def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
