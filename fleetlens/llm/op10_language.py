"""Language identification by a convolutional network over bytes, trained in numpy.

Bytes of a fixed-length window are embedded, filters of several widths slide over them, each filter keeps its maximum,
and a softmax over the languages follows. It is trained on windows of a bounded, hash-chosen sample of labelled rows
(``WINDOWS_PER_LANGUAGE``). Prediction cuts every whole text into windows and averages their log-probabilities by length.
Trained weights are folded into tables over byte pairs, so a filter's response is one or two look-ups a position.

Defined results: NULL texts, texts without a letter, and every text where nothing could be learned get ``und`` with score
0; rows with NULL id are neither held out nor learned from; repeated rows are predicted one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import arrow_map, own_columns, table
from fleetlens.llm.registry import query

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
WINDOWS_PER_LANGUAGE = 1000
PER_TEXT = 2          # training windows of one text
EPOCHS, BATCH, RATE = 8, 64, 0.004
SEED = 11
NONE = "und"


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zero-padded windows, the text each belongs to, and its bytes."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    flat = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
    length = np.full(len(owner), WINDOW, np.int64)
    at = 0
    for t, n in zip(texts, counts):
        if n:
            flat[at:at + len(t)] = np.frombuffer(t, np.uint8)
            at += int(n) * WINDOW
            length[at // WINDOW - 1] = len(t) - (int(n) - 1) * WINDOW
    return flat.reshape(-1, WINDOW), owner, length


def train(x: np.ndarray, y: np.ndarray, classes: int) -> dict:
    """Weights after ``EPOCHS`` passes of Adam over windows x (n, WINDOW) and class numbers y."""
    rng = np.random.default_rng(SEED)
    w = {"embed": rng.normal(0, 0.3, (256, EMBED)), "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)),
         "out_bias": np.zeros(classes)}
    for k in WIDTHS:
        w[f"conv{k}"] = rng.normal(0, (2 / (k * EMBED)) ** 0.5, (k * EMBED, FILTERS))
        w[f"bias{k}"] = np.zeros(FILTERS)
    w = {n: v.astype(np.float32) for n, v in w.items()}
    first = {n: np.zeros_like(v) for n, v in w.items()}
    second = {n: np.zeros_like(v) for n, v in w.items()}
    steps = 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            bx, by, n = x[rows], y[rows], len(rows)
            embedded, pooled, kept = w["embed"][bx], [], []
            for k in WIDTHS:
                m = WINDOW - k + 1
                columns = np.concatenate([embedded[:, j:j + m] for j in range(k)], axis=2)
                z = columns @ w[f"conv{k}"] + w[f"bias{k}"]
                at = z.argmax(axis=1)
                pooled.append(np.maximum(np.take_along_axis(z, at[:, None, :], 1)[:, 0], 0))
                kept.append((columns, at))
            hidden = np.concatenate(pooled, axis=1)
            logits = hidden @ w["out"] + w["out_bias"]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), by] -= 1
            p /= n
            grad = {"out": hidden.T @ p, "out_bias": p.sum(axis=0), "embed": np.zeros_like(w["embed"])}
            back = (p @ w["out"].T) * (hidden > 0)
            for i, k in enumerate(WIDTHS):
                g, (columns, at) = back[:, i * FILTERS:(i + 1) * FILTERS], kept[i]
                chosen = columns[np.arange(n)[:, None], at]
                grad[f"conv{k}"] = np.einsum("bf,bfk->kf", g, chosen)
                grad[f"bias{k}"] = g.sum(axis=0)
                into = g[:, :, None] * w[f"conv{k}"].T[None]
                for j in range(k):
                    np.add.at(grad["embed"], bx[np.arange(n)[:, None], at + j], into[:, :, j * EMBED:(j + 1) * EMBED])
            steps += 1
            for name, g in grad.items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                w[name] -= RATE * (first[name] / (1 - 0.9 ** steps)) / (np.sqrt(second[name] / (1 - 0.999 ** steps)) + 1e-7)
    return {n: v.astype(np.float32) for n, v in w.items()}


class Predictor:
    """The network with its filters folded into tables over byte pairs."""

    def __init__(self, weights: dict):
        self.w = weights
        single = {k: [weights["embed"] @ weights[f"conv{k}"][j * EMBED:(j + 1) * EMBED] for j in range(k)] for k in WIDTHS}

        def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (a[:, None] + b[None]).reshape(65536, FILTERS)
        self.two = pair(single[2][0] + weights["bias2"], single[2][1])
        self.three = pair(single[3][0] + weights["bias3"], single[3][1]), single[3][2]
        self.four = pair(single[4][0] + weights["bias4"], single[4][1]), pair(single[4][2], single[4][3])

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(windows, classes) for windows x; worked off in small blocks that stay in the cache."""
        out = np.empty((len(x), len(self.w["out_bias"])), np.float32)
        for i in range(0, len(x), 64):
            b = x[i:i + 64]
            pairs = b[:, :-1].astype(np.intp) * 256 + b[:, 1:]
            z3 = self.three[0].take(pairs[:, :-1], axis=0)
            z3 += self.three[1].take(b[:, 2:], axis=0)
            z4 = self.four[0].take(pairs[:, :-2], axis=0)
            z4 += self.four[1].take(pairs[:, 2:], axis=0)
            hidden = np.maximum(np.concatenate(
                [self.two.take(pairs, axis=0).max(axis=1), z3.max(axis=1), z4.max(axis=1)], axis=1), 0)
            logits = hidden @ self.w["out"] + self.w["out_bias"]
            logits -= logits.max(axis=1, keepdims=True)
            out[i:i + 64] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return out

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Class number and probability of each non-empty text."""
        x, owner, length = windows_of(texts)
        sums = np.zeros((len(texts), len(self.w["out_bias"])))
        np.add.at(sums, owner, self.log_probabilities(x) * length[:, None])
        mean = sums / np.maximum(np.array([len(t) for t in texts]), 1)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fit(docs: DataFrame) -> tuple[list[str], dict] | None:
    """Languages and weights learned from (text, lang) of rows that are not held out; None if there are none.

    Counts per language cover all rows; a hash threshold from them picks about as many rows of each language, and no more
    than ``WINDOWS_PER_LANGUAGE`` windows of each reach the driver.
    """
    rows = own_columns(docs, "doc_id", "text", "lang").filter(
        (remainder(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return None
    texts = WINDOWS_PER_LANGUAGE // PER_TEXT
    share = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    cut = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(min(1.0, texts / counts[name])))])
    span = F.length("text")
    picked = rows.filter(share < F.element_at(cut, F.col("lang"))).select("lang", *[
        F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(span - WINDOW, F.lit(1))) + 1).cast("int"),
                    F.lit(WINDOW)).alias(f"w{i}") for i in range(PER_TEXT)]).limit(2 * texts * len(languages))
    x, y = [], []
    for row in picked.collect():
        for i in range(PER_TEXT):
            x.append(row[f"w{i}"].encode()[:WINDOW])
            y.append(languages.index(row["lang"]))
    order = sorted(range(len(x)), key=lambda i: (y[i], x[i]))
    blocks, owner, _ = windows_of([x[i] for i in order])
    return languages, train(blocks, np.array([y[i] for i in order])[owner], len(languages))


def predict(docs: DataFrame, model: tuple[list[str], dict] | None) -> DataFrame:
    """doc_id, lang_pred and score for every row of (doc_id, text)."""
    slim = own_columns(docs, "doc_id", "text").withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    kind = slim.schema["doc_id"].dataType.simpleString()
    if model is None:
        return slim.select("doc_id", F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"))
    languages, weights = model

    def make():
        net = Predictor(weights)

        def step(batch: pa.RecordBatch) -> dict:
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            names, scores = np.full(len(letters), NONE, object), np.zeros(len(letters))
            at = np.flatnonzero(letters)
            column = batch.column("text")
            size = 0
            part: list[int] = []
            for i in at:
                part.append(i)
                size += len(column[i].as_buffer())
                if size > 1 << 22 or i == at[-1]:
                    best, p = net.texts([column[j].as_buffer().to_pybytes() for j in part])
                    names[part], scores[part] = np.array(languages, object)[best], p
                    part, size = [], 0
            return {"doc_id": batch.column("doc_id"), "lang_pred": list(names), "score": scores}
        return step

    return arrow_map(slim, make, f"doc_id {kind}, lang_pred string, score double")


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
