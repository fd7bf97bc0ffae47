"""Benchmark decontamination by latent semantic retrieval.

Every text is split once: its lower-case words are written as 32-bit hashes to the shared folder, and all else is done on
these. Passages are bags of words hashed on to ``TERMS`` terms, weighed by TF-IDF with document frequencies over all
documents. A randomised SVD over all passages of all different texts, documents and items (runs of ``FIT_WORDS`` words, the
last with what is left over; items are weighed up, see ``ITEM_PART``) gives a latent basis: passages stay distributed, each
power step sums one (TERMS, RANK) matrix over them. Every window of every whole document (half-overlapping runs of about each item's length) is projected and compared by cosine with every item.
Windows at or above ``COSINE`` are candidates, and the longest common subsequence of words decides: coverage of the item by
``COVERAGE``, or by ``PARTIAL`` where the answer, the item's last sentence, is also there. Items are compared in blocks of
``ITEMS``, so what is sent to the tasks is bounded by parameters, not by the benchmark.

Defined results: NULL and wordless documents are clean; items without words are ignored, repeated items are reported each
under its id, items without an id under NULL; an empty benchmark leaves all clean; rows are judged one by one; other columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetlens.llm.common import carried, field, given_back, mixed, own_columns, saved, table
from fleetlens.llm.registry import query
from fleetlens.session import dropping_shuffles

#: ASCII bytes of words: letters in lower case, digits and the underscore; the other ASCII bytes part words.
PARTING = bytes(c if c > 127 or c == ord("_") or chr(c).isdigit() else ord(chr(c).lower()) if chr(c).isalpha() else ord(" ")
                for c in range(256))
PARTING_WIDE = re.compile(r"[^\w\x00-\x7f]+")
BASE = np.uint64(0x9E3779B97F4A7C15)  # of the polynomial in which a word's bytes are the coefficients
PIECE = 1 << 18        # bytes hashed at once
SENTENCE = re.compile(r"[.!?\n]+")
TERMS = 1 << 16
RANK, EXTRA, POWER = 64, 16, 2
LEADING = 16           # first directions left out: they tell languages and common words apart, not passages
FIT_WORDS = 48         # of a passage that the basis is fitted on
ITEM_PART = 4096       # a passage of an item counts as one in so many of the documents' passages, all items at most as much as these
FIT_CHUNK = 768        # words whose passages are multiplied at once
GATHERED = 1 << 16     # words taken together for this, of several texts or of one; a multiple of FIT_WORDS is cut off long ones
SUM_ROWS = 256         # of a sum of products, sent as one row
ITEMS = 4096
SHORTEST = 16          # words of the smallest window; each further one is half as long again
COSINE = 0.5
COVERAGE, PARTIAL, ANSWER = 0.6, 0.5, 0.8
ANSWER_WORDS = 4       # a shorter last sentence proves nothing
STEP = 4               # words that windows are made of and move by
CHUNK = 1 << 12        # words projected at once, of one long document or of several short ones; a multiple of STEP
BLOCK_ROWS = 1 << 12   # of the basis, decomposed at once
SEED = 5


def lowered(text: str) -> bytes:
    """The text in lower case, a space for every byte and every wide character that parts words."""
    if not text.isascii():
        text = PARTING_WIDE.sub(" ", text.lower())
    return text.encode("utf-8", "replace").translate(PARTING)


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return lowered(text).decode().split() if text else []


@functools.lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse, modulo 2^64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))]) for x in (BASE, inverse))


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the words of all texts, one text after the other, and where each text begins (and the last ends)."""
    parts = [lowered(t) if t else b"" for t in texts]
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], data != 32, [False]])))
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint32)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + PIECE, "right")))
        part = data[low:ends[to - 1]].astype(np.uint64)
        up, down = powers(max(PIECE, len(part)))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[:len(part)])])
            first = starts[at:to] - low
            out[at:to] = mixed((sums[ends[at:to] - low] - sums[first]) * down[first]) >> np.uint64(32)
        at = to
    return out, np.searchsorted(starts, begins)


def hashes_of_words(words: list[str]) -> np.ndarray:
    return hashed_words([" ".join(words)])[0]


def split(rows: DataFrame) -> DataFrame:
    """Stored rows: what ``rows`` has besides ``text``, and ``words``, the hashes of the text's words (binary)."""
    kept = T.StructType([*(f for f in rows.schema.fields if f.name != "text"), T.StructField("words", T.BinaryType())])
    arrow = to_arrow_schema(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                hashes, places = hashed_words(piece.column("text").to_pylist())
                words = pa.array([hashes[a:b].tobytes() for a, b in zip(places, places[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([words if f.name == "words" else piece.column(f.name) for f in arrow], schema=arrow)

    return saved(rows.mapInArrow(run, kept))


def hashes_in(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_py(), np.uint32)


def terms_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint32(TERMS - 1)).astype(np.int32)


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """log((1 + documents) / (1 + documents with the term)) per term, over all documents."""
    def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for words in batch.column("words"):
                counts[terms_of(hashes_in(words))] += 1  # an index that repeats counts once
            counts[TERMS] += batch.num_rows
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["term", "n"])

    rows = texts.select("words").mapInArrow(counts_of, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    counts = np.zeros(TERMS + 1)
    for row in rows.collect():  # at most TERMS rows
        counts[row["term"]] = row["n"]
    return np.log((1 + counts[TERMS]) / (1 + counts[:TERMS])).astype(np.float32) + np.float32(0.01)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of texts together, where each begins (and the last ends), and what its passages count: about ``GATHERED`` words a
    time. Long texts come in pieces, which part between passages."""
    most = GATHERED // FIT_WORDS * FIT_WORDS
    held, counts, size = [], [], 0
    for batch in batches:
        for words, share in zip(batch.column("words"), batch.column("share").to_pylist()):
            words = hashes_in(words)
            cuts = [*range(0, max(1, len(words) - FIT_WORDS + 1), most), len(words)]
            for low, high in zip(cuts, cuts[1:]):
                held.append(words[low:high])
                counts.append(share)
                size += high - low
                if size >= GATHERED:
                    yield np.concatenate(held), np.cumsum([0, *map(len, held)]), np.array(counts, np.float32)
                    held, counts, size = [], [], 0
    if held:
        yield np.concatenate(held), np.cumsum([0, *map(len, held)]), np.array(counts, np.float32)


def add_products(words: np.ndarray, begins: np.ndarray, counts: np.ndarray, ranks: np.ndarray, idf: np.ndarray, v: np.ndarray,
                 out: np.ndarray) -> None:
    """Add A^T A V to ``out``, A being the TF-IDF passages (of length 1, times the root of their text's count) of texts with words.

    A few passages at once: a small matrix over the terms they have, so that a term's row of V is read once for all of them.
    ``idf``, ``v`` and ``out`` have the terms in the order of ``ranks``."""
    sizes = np.diff(begins)
    numbers = np.maximum(sizes // FIT_WORDS, 1)
    within = (np.arange(len(words)) - np.repeat(begins[:-1], sizes)) // FIT_WORDS
    passage = np.repeat(np.cumsum(numbers) - numbers, sizes) + np.minimum(within, np.repeat(numbers, sizes) - 1)
    counted = np.repeat(counts, numbers)
    terms = ranks[terms_of(words)]
    weights = idf[terms]
    place = np.empty(TERMS, np.intp)
    at = 0
    while at < len(words):
        to = min(at + FIT_CHUNK, len(words))
        if to < len(words):
            to = int(np.searchsorted(passage, passage[to]))  # a passage has fewer words than a chunk
        ordered = np.sort(terms[at:to], kind="stable")
        used = ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])].astype(np.intp)
        place[used] = np.arange(len(used))
        first, n = passage[at], int(passage[to - 1] - passage[at]) + 1
        rows = np.bincount((passage[at:to] - first) * len(used) + place[terms[at:to]], weights[at:to], n * len(used))
        rows = rows.reshape(n, len(used)).astype(np.float32)
        product = rows @ v.take(used, axis=0)
        product *= (counted[first:first + n] / np.einsum("ij,ij->i", rows, rows))[:, None]
        out[used] = out.take(used, axis=0) + rows.T @ product
        at = to


def fit_basis(texts: DataFrame, bench: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Right singular vectors after the leading ones, (TERMS, RANK) as float32, of the TF-IDF passages of all texts."""
    spark = texts.sparkSession
    width = LEADING + RANK + EXTRA
    rows = texts.select("words", F.lit(False).alias("item")).union(bench.select("words", F.lit(True))).filter(
        F.octet_length("words") > 0).withColumn("hash", F.xxhash64("words", F.lit(SEED)))
    # Copies count as one text. Only hashes are dealt: each of n copies counts 1 / n.
    passages = F.greatest(F.lit(1), F.floor(F.octet_length("words") / (4 * FIT_WORDS)))
    groups = saved(rows.groupBy("hash", "item").agg(F.count(F.lit(1)).alias("n"), F.min(passages).alias("passages")))
    total = {r["item"]: r["passages"] for r in groups.groupBy("item").agg(F.sum("passages").alias("passages")).collect()}
    # Documents outnumber items so far that these would have no directions of their own.
    weight = max(1.0, total.get(False, 0) / max(ITEM_PART, total.get(True, 0)))
    repeated = saved(groups.filter("n > 1").select("hash", "item", "n"))
    counted = rows.join(repeated, ["hash", "item"], "left").select(
        "words", (F.when(F.col("item"), F.lit(weight)).otherwise(F.lit(1.0)) / F.coalesce("n", F.lit(1))).alias("share"))
    # A task's sum is as large as V whatever it reads, so there are no more tasks than run at once, or one for four stored parts.
    parts = rows.rdd.getNumPartitions()
    counted = counted.coalesce(max(spark.sparkContext.defaultParallelism, -(-parts // 4)))
    # Common terms first, as rows that are often read are read faster from one place.
    order = np.argsort(idf, kind="stable")
    ranks = np.empty(TERMS, np.uint16)
    ranks[order] = np.arange(TERMS)
    frequencies = spark.sparkContext.broadcast((ranks, idf[order]))
    basis = np.random.default_rng(SEED).standard_normal((TERMS, width), np.float32)

    def step_of(sent):
        """A^T A V of a partition's passages, as rows of ``SUM_ROWS`` terms."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((TERMS, width), np.float32)
            for words, begins, counts in gathered(batches):
                add_products(words, begins, counts, *frequencies.value, sent.value, out)
            for i in range(0, TERMS, SUM_ROWS):
                if out[i:i + SUM_ROWS].any():
                    part = out[i:i + SUM_ROWS].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.binary())], ["block", "part"])
        return run

    def summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SUM_ROWS * width)  # in double precision, so that the order of the parts hardly matters
        for batch in batches:
            for part in batch.column("part"):
                total += np.frombuffer(part.as_py(), np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())],
                                         ["block", "part"])

    for _ in range(POWER):
        orthonormal(basis)
        sent = spark.sparkContext.broadcast(basis)
        basis[:] = 0
        with dropping_shuffles(spark):
            sums = saved(counted.mapInArrow(step_of(sent), "block int, part binary").groupBy("block").applyInArrow(
                summed, "block int, part binary"))
        sent.destroy()
        for row in sums.toLocalIterator():  # TERMS x width numbers, whatever the data, a partition at a time
            basis[row["block"]:row["block"] + SUM_ROWS] = np.frombuffer(row["part"], np.float32).reshape(-1, width)
    frequencies.destroy()
    # after the last step the columns span the leading space; order it by what each direction keeps
    u, kept, _ = np.linalg.svd(orthonormal(basis))
    rank = int((kept > 1e-6 * max(float(kept[0]), 1e-30)).sum())
    first = min(LEADING, max(0, rank - RANK))  # where there are directions to spare
    return basis.take(ranks, axis=0) @ u[:, first:first + RANK].astype(np.float32)


def orthonormal(basis: np.ndarray) -> np.ndarray:
    """Put Q of the QR decomposition in the place of a tall matrix and return R; blocks of rows come first, then what is left
    of them, so that the copies in double precision are those of a block."""
    blocks = [basis[i:i + BLOCK_ROWS] for i in range(0, len(basis), BLOCK_ROWS)]
    inner, r = np.linalg.qr(np.concatenate([np.linalg.qr(block.astype(np.float64), "r") for block in blocks]))
    for block, part in zip(blocks, np.split(inner, len(blocks))):
        block[:] = np.linalg.qr(block.astype(np.float64))[0] @ part
    return r.astype(np.float32)


class Item:
    """A benchmark item: words (as hashes), answer, and the bit masks for the common subsequence."""

    def __init__(self, item_id: int | None, text: str):
        self.id = item_id
        self.hashes = hashes_of_words(words_of(text))
        self.words = self.hashes.tolist()
        sentences = [w for s in SENTENCE.split(text) if (w := words_of(s))]
        self.answer = hashes_of_words(sentences[-1]).tolist() if len(sentences) > 1 and len(sentences[-1]) >= ANSWER_WORDS else []
        self.masks, self.answer_masks = masks(self.words), masks(self.answer)
        self.counts, self.distinct = Counter(self.words), frozenset(self.words)
        self.window = SHORTEST
        while self.window < len(self.words):
            self.window = self.window * 3 // 8 * 4


def masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_length(pattern: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, by bits over the pattern."""
    whole = (1 << size) - 1
    v = whole
    for w in words:
        m = pattern.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & whole
    return size - v.bit_count()


class Finder:
    """Finds items in a text."""

    def __init__(self, items: list[Item], basis: np.ndarray, idf: np.ndarray):
        self.vectors = np.zeros((TERMS + 1, RANK), np.float32)  # the last one fills up a text's last step
        np.multiply(basis, idf[:, None], out=self.vectors[:TERMS])
        self.by_window: dict[int, tuple[list[Item], np.ndarray]] = {}
        for window in sorted({i.window for i in items}):
            own = [i for i in items if i.window == window]
            vectors = np.stack([self.vectors[terms_of(i.hashes)].sum(axis=0) for i in own])
            self.by_window[window] = own, unit(vectors).T.astype(np.float32)

    def pieces(self, texts: list[np.ndarray]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
        """(text, first word, words) of the texts' chunks, gathered until ``CHUNK`` words are together. A chunk reads on for
        the longest window; one that is followed by another ends its gathering."""
        reach, held, size = max(self.by_window), [], 0
        for number, words in enumerate(texts):
            for low in range(0, len(words), CHUNK):
                held.append((number, low, words[low:low + CHUNK + reach]))
                size += len(held[-1][2])
                if size >= CHUNK:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def candidates(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, Item, float]]:
        """(text, first word, last word, item, cosine) of the windows that an item is near to."""
        for pieces in self.pieces(texts):
            # sums of STEP words, from which windows of every length are differences
            sizes = np.array([-(-len(words) // STEP) for _, _, words in pieces])
            places = np.cumsum(sizes) - sizes
            terms = np.full(int(sizes.sum()) * STEP, TERMS, np.intp)
            for place, (_, _, words) in zip((places * STEP).tolist(), pieces):
                terms[place:place + len(words)] = terms_of(words)
            steps = self.vectors.take(terms[::STEP], axis=0)
            for k in range(1, STEP):
                steps += self.vectors.take(terms[k::STEP], axis=0)
            sums = np.zeros((len(steps) + len(pieces), RANK), np.float32)
            begins = places + np.arange(len(pieces))
            for place, begin, size in zip(places.tolist(), begins.tolist(), sizes.tolist()):
                np.cumsum(steps[place:place + size], axis=0, out=sums[begin + 1:begin + 1 + size])
            for window, (items, vectors) in self.by_window.items():
                span, stride = window // STEP, max(1, window // (4 * STEP))
                counts = -(-np.clip(sizes - span + stride, 1, CHUNK // STEP) // stride)
                owner = np.repeat(np.arange(len(pieces)), counts)
                ends = np.cumsum(counts)
                starts = (np.arange(len(owner)) - np.repeat(ends - counts, counts)) * stride
                vector = sums.take(begins[owner] + np.minimum(starts + span, sizes[owner]), axis=0)
                vector -= sums.take(begins[owner] + starts, axis=0)
                length = np.sqrt(np.einsum("ij,ij->i", vector, vector)) + np.float32(1e-9)
                product = np.empty((len(vector), len(items)), np.float32)
                for begin, end in zip((ends - counts).tolist(), ends.tolist()):  # by text, so rounding depends on no other text
                    np.matmul(vector[begin:end], vectors, out=product[begin:end])
                near = np.flatnonzero(product >= COSINE * length[:, None])
                rows, which = np.divmod(near, len(items))
                cosines = product.ravel()[near] / length[rows]
                for at, step, i, cosine in zip(owner[rows].tolist(), starts[rows].tolist(), which.tolist(), cosines.tolist()):
                    number, low, _ = pieces[at]
                    first = low + step * STEP
                    yield number, first, min(len(texts[number]), first + window), items[i], cosine

    def find(self, texts: list[np.ndarray]) -> list[list[tuple[int | None, float, float, bool, int, int]]]:
        """(item, coverage, cosine, answer there, first word, last word) of the items that each text contains, best place of each."""
        best: list[dict[int, tuple]] = [{} for _ in texts]
        for number, first, last, item, cosine in self.candidates(texts) if self.by_window else ():
            margin, own = item.window // 4, best[number]
            region = texts[number][max(0, first - margin):last + margin].tolist()
            # words of the item that occur at all bound the common subsequence
            if sum(map(item.counts.__getitem__, item.distinct.intersection(region))) < PARTIAL * len(item.words):
                continue
            coverage = common_length(item.masks, len(item.words), region) / len(item.words)
            if coverage < PARTIAL or item.id in own and own[item.id][1] >= coverage:
                continue
            there = bool(item.answer) and common_length(item.answer_masks, len(item.answer), region) >= ANSWER * len(item.answer)
            if coverage >= COVERAGE or there:
                own[item.id] = (item.id, coverage, cosine, there, first, last)
        return [[own[i] for i in sorted(own, key=lambda i: (i is not None, i))] for own in best]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


FOUND = "array<struct<item_id: bigint, coverage: double, cosine: double, answer: boolean, first_word: int, last_word: int>>"


def findings(rows: DataFrame, bench: DataFrame) -> DataFrame:
    """Stored rows with ``found``, the items in each text, in the place of ``text``; one narrow pass per block of items."""
    spark = rows.sparkSession
    items = own_columns(bench, "item_id", "text").filter("text IS NOT NULL")
    total = items.count()
    if not total:
        return rows.drop("text").withColumn("found", F.array().cast(FOUND))
    texts = split(rows)
    idf = inverse_frequencies(texts)
    basis = spark.sparkContext.broadcast(fit_basis(texts, split(items.select("text")), idf))
    frequencies = spark.sparkContext.broadcast(idf)
    blocks = -(-total // ITEMS)
    out = texts.withColumn("found", F.array().cast(FOUND))
    for block in range(blocks):
        picked = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        block_items = [(r["item_id"], r["text"]) for r in picked.collect()]
        schema = out.schema

        def run(batches: Iterator[pa.RecordBatch], block_items=block_items, schema=schema) -> Iterator[pa.RecordBatch]:
            finder = Finder([i for i in (Item(*x) for x in block_items) if i.words], basis.value, frequencies.value)
            names = ("item_id", "coverage", "cosine", "answer", "first_word", "last_word")
            arrow = to_arrow_schema(schema)
            for batch in batches:
                texts = [hashes_in(words) for words in batch.column("words")]
                found = [[*(old or []), *(dict(zip(names, x)) for x in own)]
                         for own, old in zip(finder.find(texts), batch.column("found").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(found, arrow.field("found").type) if f.name == "found" else batch.column(f.name)
                                                  for f in arrow], schema=arrow)

        out = out.mapInArrow(run, schema)
    return out.drop("words")


def with_findings(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The caller's columns as ``given`` (see ``carried``) with ``found``, the items in each text."""
    return findings(carried(docs).select("given", field(docs, "text")), bench)


def clean_documents(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    return given_back(docs, with_findings(docs, bench).filter(F.size("found") == 0))


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(own_columns(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    best = F.array_max(F.transform("found", lambda x: x["coverage"]))
    return rows.select(
        "doc_id", (F.size("found") > 0).alias("contaminated"), F.transform("found", lambda x: x["item_id"]).alias("item_ids"),
        best.alias("coverage"), F.array_max(F.transform("found", lambda x: x["cosine"])).alias("cosine"))
