"""Exact dedup, whitening and vector codes against brute force, with NULLs, odd entries, ties, repeated rows, clashing names
and empty tables."""

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import op11_exact_dedup, op12_whitening, op13_vector_codes
from fleetlens.llm.common import own_columns, saved, scratch
from fleetlens.llm.qd import right_directions

DOCS = "doc_id bigint, text string, lang string, _best string, run int, digest string, _n string"
VECTORS = "vec_id bigint, embedding array<float>, label int, ints string, part int"


@pytest.fixture(scope="module", autouse=True)
def shared(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def documents():
    texts = ["Same Text", "same text", "SAME TEXT", "same  text", None, "", " ", "Ünlike", "ünlike", "ÜNLIKE", "x" * 100_000, "X" * 100_000, "İI", "ii"]
    rows = [(i, t, "en", "b", i, "d", "n") for i, t in enumerate(texts)]
    rows += [(100 + i, "hot Copy" if i % 2 else "HOT copy", None, None, None, None, None) for i in range(400)]
    rows += [(None, "same text", None, None, None, None, None), (None, "alone", None, None, None, None, None), (None, "alone", None, None, None, None, None),
             (2, "SAME TEXT", "en", "b", 2, "d", "n"), (7, "other", None, None, None, None, None)]
    return rows


@pytest.mark.parametrize("parts,keep", [(1, "largest"), (30, "largest"), (75, "smallest")])
def test_exact_dedup(spark, parts, keep):
    rows = documents()
    docs = spark.createDataFrame(rows, DOCS).repartition(parts)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[lowered(r[1])].append(r[0])
    got = op11_exact_dedup.groups(docs, keep).collect()
    assert len(got) == len(rows)
    of = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = collections.Counter()
    for r in got:
        ids = of[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == ((max if keep == "largest" else min)(known) if known else None)
        if r["kept"]:
            kept[r["text_sha256"]] += 1
            assert r["doc_id"] == r["keep_id"]
    assert kept == collections.Counter(dict.fromkeys(of, 1))
    stay = op11_exact_dedup.keep_one(docs, keep)
    assert stay.columns == docs.columns
    assert collections.Counter(lowered(r["text"]) for r in stay.collect()) == collections.Counter(dict.fromkeys(groups, 1))


def test_exact_dedup_edges(spark):
    none = spark.createDataFrame([], DOCS)
    assert op11_exact_dedup.groups(none).count() == 0 and op11_exact_dedup.keep_one(none).count() == 0
    other = spark.createDataFrame([("a", "T"), ("b", "t")], "id string, Text string")  # no doc_id, name in other case
    assert op11_exact_dedup.groups(other).select("group_size").distinct().collect() == [(2,)]
    assert op11_exact_dedup.keep_one(other).count() == 1
    twice = other.select(F.col("id").alias("text"), F.col("Text"))
    assert sorted(r[0] for r in own_columns(twice, "text").collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        op11_exact_dedup.groups(other, "first")


def test_levels_hold_a_digest_once_per_run(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("text")).repartition(40)
    digests = op11_exact_dedup.digests(op11_exact_dedup.numbered(rows))
    level = op11_exact_dedup.merged(digests.withColumn("best", F.struct("doc_id", "row")), F.max("best"), F.count(F.lit(1)))
    assert level.count() == 5 and level.agg(F.sum("n")).first()[0] == 4000
    plan = digests._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def vectors(n=700, dimension=10, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dimension)).astype(np.float32) * np.linspace(0.02, 0.3, dimension, dtype=np.float32)
    rows = [(int(i), [float(v) for v in r], int(i) % 3 if i % 7 else None, "c", 1) for i, r in zip(rng.permutation(n), x)]
    rows += [rows[5], rows[5], (None, rows[9][1], 1, None, None)]
    bad = [(10_000, None, 1, None, None), (10_001, [None] + rows[0][1][1:], 1, None, None), (10_002, [math.nan] + rows[0][1][1:], 1, None, None),
           (10_003, [math.inf] + rows[0][1][1:], 1, None, None), (10_004, [], 1, None, None), (10_005, [0.5, 0.5], 1, None, None)]
    return rows, bad


def integers(rows, shift=0):
    return np.floor(1024 * np.array([np.float32(r[1]) for r in rows]).astype(np.float64)).astype(np.int64) + shift


def test_whitening(spark):
    rows, bad = vectors()
    found = op12_whitening.whiten(spark.createDataFrame(rows + bad, VECTORS).repartition(5), 4)
    x = integers(rows, 100_000)
    n, total = len(x), x.sum(axis=0)
    y = x - total / n
    values, directions = np.linalg.eigh(y.T @ y / n)
    values, directions = values[::-1][:4], directions[:, ::-1][:, :4]
    assert found.mean.n == n
    np.testing.assert_allclose(found.eigenvalues, values, rtol=1e-10)
    np.testing.assert_allclose(found.explained, values / np.trace(y.T @ y / n), rtol=1e-10)
    signs = np.sign((found.components * directions).sum(axis=0))
    np.testing.assert_allclose(found.components * signs, directions, atol=1e-9)
    assert found.identity_error < 1e-9
    white = y @ directions / np.sqrt(values) * signs
    want = sorted(((r[0] if r[0] is not None else -1, int(((n * xi - total) ** 2).sum()), *np.round(w, 6)) for r, xi, w in zip(rows, x, white)))
    got = sorted(((r["vec_id"] if r["vec_id"] is not None else -1, r["deviation"], *np.round(r["whitened"], 6)) for r in found.rows.collect()))
    np.testing.assert_allclose(got, want, atol=2e-6)


def test_whitening_edges(spark):
    def run(rows):
        return op12_whitening.whiten(spark.createDataFrame(rows, VECTORS))

    assert run([]).rows.count() == 0
    assert run([(1, [0.5, 0.25], 0, None, None)] * 5).rows.count() == 0          # no variance
    line = run([(i, [float(i), 2.0 * i], 0, None, None) for i in range(6)])      # one direction only
    assert len(line.eigenvalues) == 1 and line.identity_error < 1e-9
    even = run([(i, [float((i == d) - (i == d + 3)) for d in range(3)], 0, None, None) for i in range(6)])  # all eigenvalues equal
    assert len(even.eigenvalues) == 3 and even.identity_error < 1e-9
    with pytest.raises(Exception, match="not be exact"):
        run([(1, [1e30, 0.0], 0, None, None)])
    huge = op12_whitening.Mean(1 << 40, [0, 0], [1, 2])
    assert op12_whitening.deviations(np.array([[1 << 30, 5]]), huge) == [None]
    assert op12_whitening.deviations(np.array([[3, 5]]), op12_whitening.Mean(4, [1, 2], [1, 3])) == [(4 * 3 - 5) ** 2 + (4 * 5 - 11) ** 2]


def test_many_factors_meet_in_groups(spark, monkeypatch):
    monkeypatch.setattr(op12_whitening, "FAN", 2)
    rows, _ = vectors(200, 6)
    found = op12_whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(9), 6)
    y = integers(rows) - integers(rows).mean(axis=0)
    np.testing.assert_allclose(found.eigenvalues, np.linalg.eigvalsh(y.T @ y / len(y))[::-1], rtol=1e-10)


@pytest.mark.parametrize("spectrum", [
    np.linspace(5, 1, 30), [4.0] * 10 + [1.0] * 5, [1 + 1e-10 * i for i in range(12)], np.logspace(0, -12, 25), [3, 2, 1, 0, 0, 0]])
def test_singular_directions(spectrum):
    rng = np.random.default_rng(1)
    n = len(spectrum)
    a = np.linalg.qr(rng.normal(size=(n, n)))[0] * np.array(spectrum, float) @ np.linalg.qr(rng.normal(size=(n, n)))[0]
    values, directions = right_directions(a, 8)
    want = np.linalg.svd(a, compute_uv=False)[:len(values)]
    assert len(values) == min(8, np.count_nonzero(spectrum))
    np.testing.assert_allclose(values, want, rtol=1e-9)
    np.testing.assert_allclose(a.T @ (a @ directions), directions * values ** 2, atol=1e-12 * want[0] ** 2)
    np.testing.assert_allclose(directions.T @ directions, np.eye(len(values)), atol=1e-11)


def coded(x, parts, entries, rounds):
    """Brute force in Python's integers, no limbs, no products."""
    width = -(-x.shape[1] // parts)
    x = np.pad(x, ((0, 0), (0, width * parts - x.shape[1]))).reshape(len(x), parts, width).astype(object)
    books = [[list(v[p]) for v in x[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for v in x]

    for _ in range(rounds):
        now = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p] for v, a in zip(x, now) if a[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    return assign(), books


@pytest.mark.parametrize("n,dimension,entries", [(150, 8, 16), (40, 10, 16), (5, 8, 16)])
def test_vector_codes(spark, n, dimension, entries):
    rows, bad = vectors(n, dimension) if n > 20 else ([(i, [0.01 * i * (d + 1) for d in range(dimension)], 1, None, None) for i in range(n)], [])
    rows.sort(key=lambda r: (r[0] is None, r[0], tuple(integers([r])[0].tobytes())))
    want, books = coded(integers(rows), 4, entries, 3)
    codes, got_books = op13_vector_codes.compress(spark.createDataFrame(rows + bad, VECTORS).repartition(4), 4, entries, 3)
    assert got_books.tolist() == books
    expected = sorted((-1 if r[0] is None else r[0], bytes(k for _, k in w), sum(d for d, _ in w)) for r, w in zip(rows, want))
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], bytes(r["code"]), r["error"]) for r in codes.collect()) == expected


def test_vector_codes_edges(spark):
    codes, books = op13_vector_codes.compress(spark.createDataFrame([], VECTORS))
    assert codes.count() == 0 and books.size == 0
    bare = spark.createDataFrame([(1,), (2,)], "vec_id int")
    assert op13_vector_codes.compress(bare)[0].count() == 0
    with pytest.raises(Exception, match="not be exact"):
        op13_vector_codes.compress(spark.createDataFrame([(1, [1e9], 1, None, None)], VECTORS))


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for top in (5, 1 << 20, (1 << 27) - 1):
        a, b = rng.integers(-top, top + 1, (30, 16)), rng.integers(-top, top + 1, (9, 16))
        a[0], b[0] = top, -top
        assert (op13_vector_codes.exact_products(a, b) == a @ b.T).all()
    bits = (53 - 4) // 2
    assert len(op13_vector_codes.limbs(np.array([[1 << 26]]), bits)) == 2
    assert (sum(x.astype(np.int64) << (bits * i) for i, x in enumerate(op13_vector_codes.limbs(np.arange(-9, 9) << 24, bits)))
            == np.arange(-9, 9) << 24).all()


def test_equal_distances_take_the_first_entry():
    book = np.array([[2], [0], [0], [4]])
    index, distance = op13_vector_codes.nearest(np.array([[1], [3], [0]]), book)
    assert index.tolist() == [0, 0, 1] and distance.tolist() == [1, 1, 0]


def test_scratch_tables_go(spark):
    before = saved(spark.range(3).toDF("a"))
    with scratch(spark):
        inner = saved(before.withColumn("b", F.lit(1)))
        kept = saved(inner, keep=True)
    assert kept.count() == 3 and before.count() == 3
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        spark.read.parquet(inner.inputFiles()[0] if inner.inputFiles() else "gone").count()
