"""Near-duplicate join on the Jaccard similarity of five-word shingles, by a MinHash LSH forest.

Equal texts are one node. A node's MinHash signature is read as ``TREES`` labels of ``DEPTH`` values: its paths in as many
prefix tries. Nodes that share a prefix in a trie are candidates. The prefix is the longest at which a pair at the threshold
is found with probability ``RECALL``, whatever other pairs the table has: a mean over found pairs would be that of the
largest groups. At the four values taken it is 0.9998. Candidate pairs whose signatures allow the threshold connect nodes
to candidate groups; inside these every pair is verified on the shingle sets, so a link missed by the tries is still found.

Pairs stay inside a task's unit (groups are cut into blocks, and pairs of blocks are dealt out); what leaves it is a count
of links per node and a spanning forest of the links, linear in the group. Nothing is capped.

Defined results: a text of one to four words has one shingle, all its words; wordless texts have none and link to nothing,
but equal texts, also empty ones, are one class; a NULL text is a class of its own row; rows equal in id and text are in one
class; an empty table gives an empty result; other columns are not read. ``class_id`` is a doc_id, so classes without ids or
with a repeated one share it; ``class_key`` tells classes apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.blocks import Forest, fixed_width, in_block_pairs, over_units
from fleetlens.llm.common import (U64, WORD, WordHashes, arrow_map, hashes_of, mixed, own_columns, saved,
                                  shingle_hashes, table)
from fleetlens.llm.components import connected
from fleetlens.llm.registry import query

SHINGLE = 5
THRESHOLD = (4, 5)      # similarity of at least 4 / 5, compared in integers
TREES, DEPTH = 16, 8
RECALL = 0.999          # of pairs at the threshold
ALLOWED = 0.6           # estimated similarity from which a pair is looked at: 5.6 standard errors below the threshold
BLOCK = 512
PAIRS = 1 << 14          # signature pairs compared at once in a task
SEED = 77


def prefix_length() -> int:
    """The longest prefix at which one of the tries holds a pair at the threshold with probability ``RECALL``."""
    alike = THRESHOLD[0] / THRESHOLD[1]
    return next(p for p in range(DEPTH, 0, -1) if 1 - (1 - alike ** p) ** TREES >= RECALL)


def multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = TREES * DEPTH
    return rng.integers(0, 1 << 63, n, dtype=U64) * U64(2) + U64(1), rng.integers(0, 1 << 63, n, dtype=U64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The 16 leading bits of the minimum under each hash function."""
    least = np.full(len(a), np.iinfo(U64).max, U64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 256):
            part = shingles[i:i + 256, None] * a
            part += b
            np.minimum(least, part.min(axis=0), out=least)
    return (mixed(least) >> U64(48)).astype(np.uint16)


def key_of(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def with_signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text, NULL for NULL), n shingles and signature of each row."""
    slim = own_columns(docs, "doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()

    def make():
        known, (a, b) = WordHashes(), multipliers()

        def step(batch: pa.RecordBatch) -> dict:
            keys, counts, signs = [], [], []
            seen: dict[bytes, tuple] = {}
            for value in batch.column("text"):
                text = value.as_py()
                key = None if text is None else key_of(text)
                if key not in seen:
                    shingles = shingle_hashes(hashes_of(WORD.findall(text or ""), known), SHINGLE)
                    seen[key] = len(shingles), signature(shingles, a, b).tobytes() if len(shingles) else None
                keys.append(key)
                counts.append(seen[key][0])
                signs.append(seen[key][1])
            return {"doc_id": batch.column("doc_id"), "key": keys, "n": counts, "signature": signs}
        return step

    return arrow_map(slim, make, f"doc_id {kind}, key binary, n int, signature binary")


def buckets(nodes: DataFrame, prefix: int) -> DataFrame:
    """(bucket, key) for each node and trie: the trie node at the prefix length."""
    def make():
        def step(batch: pa.RecordBatch) -> dict:
            signs = fixed_width(batch.column("signature"), 2 * TREES * DEPTH).view(np.uint16).reshape(-1, TREES, DEPTH)
            label = np.broadcast_to(np.arange(1, TREES + 1, dtype=U64), signs.shape[:2])
            with np.errstate(over="ignore"):
                for i in range(prefix):
                    label = mixed(label * U64(0x9E3779B97F4A7C15) + signs[:, :, i])
            keys = batch.column("key").take(pa.array(np.repeat(np.arange(len(signs)), TREES)))
            return {"bucket": label.reshape(-1).view(np.int64), "key": keys}
        return step

    return arrow_map(nodes.select("key", "signature"), make, "bucket bigint, key binary")


def pairs_of(borders: np.ndarray, side: np.ndarray, same: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs inside units, at most ``PAIRS`` at once; units of one size together."""
    sizes = np.diff(borders)
    for size in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(size, 1)
        starts = borders[:-1][sizes == size]
        together = max(1, PAIRS // len(i))
        for k in range(0, len(starts), together):
            first = starts[k:k + together, None]
            left, right = (first + i).ravel(), (first + j).ravel()
            wanted = same[left] | (side[left] != side[right])
            left, right = left[wanted], right[wanted]
            for low in range(0, len(left), PAIRS):
                yield left[low:low + PAIRS], right[low:low + PAIRS]


def candidate_links(nodes: DataFrame, prefix: int) -> DataFrame:
    """Spanning links (a, b) of the candidate pairs at a prefix length."""
    members = saved(buckets(nodes, prefix))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rows = members.join(shared, "bucket").join(nodes.select("key", "signature"), "key")
    dealt = in_block_pairs(rows, "bucket", "key", F.col("size"), BLOCK).select("unit", "side", "same", "key", "signature")

    def work(groups) -> Iterator[pa.RecordBatch]:
        for rows, borders in groups:
            keys = rows.column("key").to_pylist()
            signs = fixed_width(rows.column("signature"), 2 * TREES * DEPTH).view(np.uint16)
            forest, tree = Forest(len(keys)), np.arange(len(keys))
            a, b = [], []
            for left, right in pairs_of(borders, rows.column("side").to_numpy(), rows.column("same").to_numpy()):
                near = (signs[left] == signs[right]).mean(axis=1) >= ALLOWED
                left, right = left[near], right[near]
                # of the pairs between two trees one makes the link
                apart = tree[left] != tree[right]
                left, right = left[apart], right[apart]
                if len(left):
                    _, one = np.unique(tree[left] * len(keys) + tree[right], return_index=True)
                    for i, j in zip(left[one].tolist(), right[one].tolist()):
                        if forest.join(i, j):
                            a.append(keys[i])
                            b.append(keys[j])
                    tree = forest.roots()
            yield pa.record_batch({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return over_units(dealt, work, "a binary, b binary").distinct()


def verified(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Exact check inside candidate groups: rows (key, links) and (a, b) of a spanning forest of the links."""
    slim = own_columns(docs, "doc_id", "text").filter("text IS NOT NULL").select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()

    def keyed():
        return lambda batch: {"text": batch.column("text"), "key": [key_of(t.as_py()) for t in batch.column("text")],
                              "doc_id": batch.column("doc_id")}

    texts = arrow_map(slim, keyed, f"doc_id {kind}, text string, key binary")
    # the same plan at every size: a small list of nodes is not broadcast where a larger one would be shuffled
    chosen = texts.join(groups.hint("merge"), (texts["key"] == groups["node"]) & texts["doc_id"].eqNullSafe(groups["least"])).select(
        "key", "text", "root", "size")

    def sets():
        known = WordHashes()
        return lambda batch: {
            "key": batch.column("key"), "root": batch.column("root"), "size": batch.column("size"),
            "shingles": [np.unique(shingle_hashes(hashes_of(WORD.findall(t.as_py()), known), SHINGLE)).tobytes()
                         for t in batch.column("text")]}

    shingled = arrow_map(chosen, sets, "key binary, root binary, size bigint, shingles binary")
    dealt = in_block_pairs(shingled, "root", "key", F.col("size"), BLOCK).select("unit", "side", "same", "key", "shingles")

    def work(parts) -> Iterator[pa.RecordBatch]:
        for rows, borders in parts:
            keys = rows.column("key").to_pylist()
            blobs = rows.column("shingles")
            sides, sames = rows.column("side").to_numpy(), rows.column("same").to_numpy()
            a, b, links = [], [], []
            for low, high in zip(borders[:-1], borders[1:]):
                # rows equal in id and text would stand for one node twice
                first: dict[bytes, int] = {}
                chosen = [i for i in range(low, high) if first.setdefault(keys[i], i) == i]
                if len(chosen) < 2:
                    continue
                near = similar([np.frombuffer(blobs[i].as_py(), U64) for i in chosen])
                if not sames[low]:
                    side = sides[chosen]
                    near &= side[:, None] != side[None, :]
                count = near.sum(axis=1)
                forest = Forest(len(chosen))
                for i, j in zip(*np.nonzero(np.triu(near, 1))):
                    if forest.join(int(i), int(j)):
                        a.append(keys[chosen[i]])
                        b.append(keys[chosen[j]])
                        links.append(0)
                for i in np.flatnonzero(count):
                    a.append(keys[chosen[i]])
                    b.append(None)
                    links.append(int(count[i]))
            yield pa.record_batch({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "links": pa.array(links, pa.int64())})

    return over_units(dealt, work, "a binary, b binary, links bigint")


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sorted distinct sets reach the threshold, exactly; the diagonal is False."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    number = np.cumsum(new) - 1
    counts = np.bincount(number)
    keep = counts[number] > 1
    number, owner = number[keep], owner[keep]
    both = np.zeros((m, m), np.float32)
    if len(number):
        number = np.cumsum(np.concatenate([[0], number[1:] != number[:-1]]))
        for low in range(0, int(number[-1]) + 1, 4096):  # shared shingles in slabs
            i, j = np.searchsorted(number, [low, low + 4096])
            held = np.zeros((m, min(4096, int(number[-1]) + 1 - low)), np.float32)
            held[owner[i:j], number[i:j] - low] = 1
            both += held @ held.T
    shared = both.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - shared
    near = (THRESHOLD[1] * shared >= THRESHOLD[0] * union) & (shared > 0)
    np.fill_diagonal(near, False)
    return near


def join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, key, class_key (smallest text key of the class, its identity), class_id (smallest
    doc_id of the class, which other classes can share), n_links (different texts linked to the text), n_copies (documents
    with the text) and class_size (documents of the class). A NULL text has no keys."""
    rows = saved(with_signatures(docs))
    nodes = saved(rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
        F.first("signature").alias("signature")))
    able = nodes.filter("n > 0")
    groups = connected(candidate_links(able, prefix_length()))
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    groups = saved(groups.join(sizes, "root").join(nodes.select(F.col("key").alias("node"), "least"), "node"))
    told = saved(verified(docs, groups))
    classes = connected(told.filter("b IS NOT NULL").select("a", "b"))
    counts = told.filter("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("n_links"))
    by_key = (nodes.select("key", "least", "copies").join(classes.withColumnRenamed("node", "key"), "key", "left")
              .join(counts, "key", "left").withColumn("root", F.coalesce("root", "key")))
    heads = by_key.groupBy("root").agg(
        F.min("key").alias("class_key"), F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    known = by_key.join(heads, "root").select(
        "key", "class_key", "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.col("copies").alias("n_copies"), "class_size")
    one = F.lit(1).cast("bigint")
    return rows.select("doc_id", "key").join(known, "key", "left").select(
        "doc_id", "key", "class_key", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("n_copies", one).alias("n_copies"),
        F.coalesce("class_size", one).alias("class_size"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, the one of the smallest doc_id (NULL is the last, ties go to the smallest text
    key); rows with a NULL text stay."""
    found = join(docs).filter("key IS NOT NULL")
    chosen = found.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("_least"))
    keyed = with_keys(docs)
    kept = keyed.join(chosen.select(F.col("_least.key").alias("_key"), F.col("_least.doc_id").alias("_id")),
                      (F.col("_own_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).dropDuplicates(["_own_key"])
    return kept.select(*docs.columns).unionByName(docs.filter("text IS NULL"))


def with_keys(docs: DataFrame) -> DataFrame:
    """Rows with a text and its key as ``_own_key``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def make():
        return lambda batch: {n: batch.column(n) for n in batch.schema.names} | {
            "_own_key": [key_of(t.as_py()) for t in batch.column("text")]}
    return arrow_map(docs.filter("text IS NOT NULL"), make, schema + ", _own_key binary")


@query("op1_ngram_join")
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "n_links", "n_copies", "class_size", F.lower(F.hex("class_key")).alias("class_key"))
