"""The text operators against brute force on small tables, with the cases that tables bring: NULLs, empty texts, ties, repeated
rows, extra columns, no rows at all."""

import collections
import hashlib
import os
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import (op1_ngram_join, op2_sharding, op3_decontamination, op4_licenses, op5_html, op6_repeats,
                           op7_warc, op8_quality, op9_mixing, op10_language)
from fleetlens.llm.common import saved, scratch
from fleetlens.session import shared_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, size int"


def words(n, start=0):
    return " ".join(f"w{(i * 7 + start) % 1009}" for i in range(n))


@pytest.fixture(scope="module")
def rows():
    base = words(120)
    long = words(3000, 5)
    near = base.replace("w7 ", "other ", 1)
    texts = [base, base, near, words(90, 400), None, "", "   \n\t", "one two three", "one two three", long, base + " " + words(60, 700),
             "é ß ñ " + words(70, 33), words(90, 400).upper(), "### %%% " * 60]
    out = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, ""][i % 4], len(t) if t else None, "k", 1) for i, t in enumerate(texts)]
    return [*out, out[3], (None, words(80, 111), None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], DOCS)


def test_quality_ledger(docs, rows, none):
    got = op8_quality.verdicts(op8_quality.ledger(docs)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for doc_id, text, *_ in rows:
        ws = WORD.findall(text or "")
        tri = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
        counts = collections.Counter(tri)
        covered = {j for i, t in enumerate(tri) if counts[t] > 1 for j in range(i, i + 3)}
        r = by_id[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(ws), sum(map(len, ws)), len(covered))
        assert r["base_failed"] == (len(ws) < 50 or 100 * len(covered) > 50 * len(ws))
    assert by_id[0]["kept"] and not by_id[13]["kept"] and not by_id[12]["kept"]
    kept = {r["doc_id"] for r in op8_quality.keep_good(docs).collect()}
    assert kept == {r["doc_id"] for r in got if r["kept"]}
    ledger = op8_quality.ledger(docs)
    failed = {(r["version"], r["rule"]): (r["failed"], r["only"]) for r in op8_quality.ablations(ledger).collect()}
    few = sum(len(WORD.findall(t or "")) < 50 for _, t, *_ in rows)
    assert failed[1, "few_words"] == (few, few)
    assert op8_quality.ledger(none).count() == 0


def test_sharding(docs, rows, none):
    got = op2_sharding.layout(docs, 4).orderBy("place").collect()
    assert len(got) == len(rows) and [r["place"] for r in got] == list(range(len(rows)))
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)
    total, at = sum(r["size"] for r in got), 0
    slots = collections.Counter()
    for r in got:
        at += r["size"]
        assert r["shard"] == (2 * at - r["size"]) * 4 // (2 * total)
        assert r["slot"] == slots[r["shard"]]
        slots[r["shard"]] += 1
    wide = op2_sharding.shard_documents(docs, 4).collect()
    assert collections.Counter((r["shard"], r["slot"]) for r in wide) == collections.Counter((r["shard"], r["slot"]) for r in got)
    assert op2_sharding.layout(none).count() == 0
    # fewer tasks than ranges: the law and the slots hold for whoever writes fewer files
    for tasks in (1, 2):
        assert collections.Counter(map(tuple, op2_sharding.layout(docs, 4).coalesce(tasks).collect())) == collections.Counter(map(tuple, op2_sharding.layout(docs, 4).collect()))
    named = docs.select("*", *[F.lit(n).alias(n) for n in ("_places", "_id", "_n", "_hash", "places", "number", "given", "part")])
    back = op2_sharding.shard_documents(named, 4)
    assert back.columns == [*named.columns, "shard", "slot"] and back.count() == docs.count()
    assert {tuple(r) for r in back.select("_places", "_id", "_n", "_hash", "places", "number", "given", "part").distinct().collect()} == {
        ("_places", "_id", "_n", "_hash", "places", "number", "given", "part")}


def test_near_duplicates(docs, rows, none):
    got = op1_ngram_join.join(docs).collect()
    assert len(got) == len(rows)
    distinct = sorted({t for _, t, *_ in rows if t is not None})
    def shingles(t):
        ws = WORD.findall(t)
        return {tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()
    sets = {t: shingles(t) for t in distinct}
    links = collections.Counter()
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
    text_of = {d: t for d, t, *_ in rows}
    for r in got:
        assert r["n_links"] == links[text_of[r["doc_id"]]]
    classes = {r["doc_id"]: r["class_id"] for r in got}
    assert classes[0] == classes[1] == classes[2] == 0 and classes[8] == 7 and classes[4] == 4 and classes[10] == 10
    kept = op1_ngram_join.keep_one(docs).collect()
    assert sorted((r["doc_id"] for r in kept if r["doc_id"] is not None)) == sorted(set(classes.values()) - {None})
    assert op1_ngram_join.join(none).count() == 0


def test_decontamination(spark, docs, none):
    item = words(40, 250)
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "x y")], "item_id bigint, text string")
    altered = item.split()
    altered[5], altered[20] = "changed", "too"
    more = spark.createDataFrame([(100, words(50, 600) + " " + item + " " + words(50, 800)), (101, " ".join(altered))], "doc_id bigint, text string")
    found = {r["doc_id"]: [x["item_id"] for x in r["found"]] for r in op3_decontamination.findings(
        docs.select("doc_id", "text").union(more), bench).collect()}
    assert found[100] == [1] and found[101] == [1] and found[4] == [] and found[7] == []
    assert op3_decontamination.with_findings(none, bench).count() == 0
    assert op3_decontamination.clean_documents(docs, bench.limit(0)).count() == docs.count()


def test_items_without_an_id_are_searched(spark, docs):
    item, other, named = words(40, 250), words(30, 77), words(35, 500)
    bench = spark.createDataFrame([(None, item), (None, other), (7, named), (None, None)], "item_id bigint, text string")
    more = spark.createDataFrame([(100, f"{words(50, 600)} {item} {words(50, 800)}"), (101, f"{item} {named} {other}"), (102, words(90, 310)[::-1])],
                                 "doc_id bigint, text string")
    found = {r["doc_id"]: [x["item_id"] for x in r["found"]] for r in op3_decontamination.findings(more, bench).collect()}
    assert found == {100: [None], 101: [None, 7], 102: []}
    assert [r["doc_id"] for r in op3_decontamination.clean_documents(more, bench).collect()] == [102]


def test_basis_is_fitted_on_all_passages_of_all_texts(spark, docs, monkeypatch):
    op3, rng = op3_decontamination, np.random.default_rng(4)
    texts = [" ".join(f"v{x}" for x in rng.zipf(1.3, n) % 4000) for n in rng.integers(1, 400, 120)]
    texts.append(" ".join(f"long{i}" for i in range(3 * 480 + 47)))
    split = lambda some: op3.split(spark.createDataFrame([(t,) for t in some], "text string").repartition(3))
    idf = op3.inverse_frequencies(split(texts))
    stored = split([*texts, *texts[:50], *texts[:20], "", None])  # copies change nothing
    monkeypatch.setattr(op3, "ITEM_PART", 100)
    got = op3.fit_basis(stored, split(texts[40:60]), idf)
    rows = []
    for t in [*texts, *texts[40:60]]:
        hashes = op3.hashes_of_words(op3.words_of(t))
        n = max(1, len(hashes) // op3.FIT_WORDS)
        for i in range(n):
            part = hashes[i * op3.FIT_WORDS:(i + 1) * op3.FIT_WORDS if i + 1 < n else None]
            row = np.bincount(op3.terms_of(part), minlength=op3.TERMS) * idf.astype(np.float64)
            rows.append(row / np.linalg.norm(row))
    a = np.array(rows)
    n = sum(max(1, len(op3.words_of(t)) // op3.FIT_WORDS) for t in texts)
    assert n > 400 and len(a) - n < 100
    a[n:] *= np.sqrt(n / 100)  # the items' passages, each as one in ITEM_PART of the documents'
    v = np.random.default_rng(op3.SEED).standard_normal((op3.TERMS, op3.LEADING + op3.RANK + op3.EXTRA), np.float32).astype(np.float64)
    v = v[np.argsort(np.argsort(idf, kind="stable"), kind="stable")]  # the start has the commonest term first
    for _ in range(op3.POWER):
        v = a.T @ (a @ np.linalg.qr(v)[0])
    q, r = np.linalg.qr(v)
    want = q @ np.linalg.svd(r)[0][:, op3.LEADING:op3.LEADING + op3.RANK]
    assert np.abs(got @ got.T[:, ::64] - want @ want.T[:, ::64]).max() < 1e-3
    assert got[np.unique(op3.terms_of(op3.hashes_of_words(op3.words_of(texts[-1]))))].any(axis=1).all()
    # a long text in pieces has the passages of the whole
    monkeypatch.setattr(op3, "GATHERED", 480)
    batch = pa.RecordBatch.from_pydict({"words": [op3.hashes_of_words(op3.words_of(t)).tobytes() for t in texts], "share": [1.0] * len(texts)})
    pieces, out = list(op3.gathered(iter([batch]))), np.zeros((op3.TERMS, 96), np.float32)
    assert len(pieces) > 10 and max(len(words) for words, _, _ in pieces) < 480 + 527
    v = np.random.default_rng(5).standard_normal(out.shape, np.float32)
    for piece in pieces:
        op3.add_products(*piece, np.arange(op3.TERMS), idf, v, out)
    assert np.abs(out - a[:n].T @ (a[:n] @ v)).max() < 1e-3


def test_basis_is_decomposed_in_little_memory():
    basis = np.random.default_rng(1).standard_normal((op3_decontamination.TERMS, 96), np.float32) * np.logspace(0, -3, 96, dtype=np.float32)
    q = basis.copy()
    tracemalloc.start()
    try:
        r = op3_decontamination.orthonormal(q)
        assert tracemalloc.get_traced_memory()[1] < basis.nbytes  # one copy of the whole in double precision is twice that
    finally:
        tracemalloc.stop()
    assert np.abs(q @ r - basis).max() < 1e-5 and np.abs(q.T @ q - np.eye(96)).max() < 1e-5


def test_finder_takes_short_texts_together():
    op3 = op3_decontamination
    rng = np.random.default_rng(2)
    items = [op3.Item(i, words(20 + 15 * i, 100 * i)) for i in range(4)]
    finder = op3.Finder(items, rng.standard_normal((op3.TERMS, op3.RANK)).astype(np.float32), np.ones(op3.TERMS, np.float32))
    texts = [op3.hashes_of_words(words(n, start).split()) for n, start in
             [(30, 0), (0, 0), (1, 3), (90, 180), (op3.CHUNK, 7), (2 * op3.CHUNK + 5, 300), (3, 9), (70, 290)]]
    together = [collections.Counter() for _ in texts]
    for number, first, last, item, cosine in finder.candidates(texts):
        together[number][first, last, item.id, round(cosine, 3)] += 1
    assert together == [collections.Counter((*x[1:3], x[3].id, round(x[4], 3)) for x in finder.candidates([t])) for t in texts]
    assert finder.find(texts) and [[x[0] for x in f] for f in finder.find(texts)] == [[x[0] for x in finder.find([t])[0]] for t in texts]
    assert len(list(finder.pieces([t for t in texts if len(t) < 100] * 40))) < 4
    assert finder.find([]) == [] and op3.Finder([], finder.vectors[:-1], np.ones(op3.TERMS, np.float32)).find(texts) == [[]] * len(texts)


def test_licenses(spark, none):
    scan = {r["doc_id"]: r for r in op4_licenses.scan_licenses(spark.createDataFrame([
        (1, words(30) + "\nReleased under the MIT License.\n" + words(5)), (2, None), (3, ""), (4, words(200)),
        (5, "Licensed under the Apache  License, version 2.0. All rights reserved."), (6, "Released under the Other License.")],
        "doc_id bigint, text string")).collect()}
    assert scan[1]["licenses"] == ["MIT"] and scan[1]["matches"][0]["first_word"] == 30
    assert scan[5]["licenses"] == ["All rights reserved", "Apache-2.0"]
    assert [scan[i]["n_matches"] for i in (2, 3, 4, 6)] == [0, 0, 0, 0]
    assert op4_licenses.scan_licenses(none).count() == 0


def test_html(spark, docs):
    page = ("<html><head><title>t</title></head><body><nav><a>menu</a></nav><header>site</header><article><header><h1>Head &amp; more</h1>"
            "</header><p>One <b>two</b><br>\n three<ul><li>a<li>b</ul><div class='ad box'>buy</div><section class=comments><p>c</p></section>"
            "</article><footer>f</footer><script>var x='<p>no</p>'</script></body></html>")
    pages = spark.createDataFrame([(1, "http://h.example/1", page), (2, "http://h.example/2", page.replace("One", "Uno")), (3, None, None),
                                   (4, "x", ""), (4, "x", ""), (5, "http://i.example/", "<p>a < b &lt;c<p>d")],
                                  "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in op5_html.extract(pages).collect()}
    assert got[1] == "Head & more\n\nOne two three\n\na\n\nb" and got[2].startswith("Head & more\n\nUno")
    assert got[3] == got[4] == "" and got[5] == "a < b <c\n\nd"
    assert op5_html.extract(pages.limit(0)).count() == 0


def test_repeats(docs, rows, none, spark):
    shared = words(60, 11)
    more = [(200, "start " + shared + " end one"), (201, "begin it " + shared + " stop two"), (202, "ab" * 400), (203, shared[:199])]
    table = [(d, t) for d, t, *_ in rows] + more
    data = [(t or "").encode() for _, t in table]
    counts = collections.Counter(b[p:p + 200] for b in data for p in range(len(b) - 199))
    want = collections.Counter()
    for (doc_id, _), b in zip(table, data):
        mask = bytearray(len(b))
        for p in range(len(b) - 199):
            if counts[b[p:p + 200]] > 1:
                mask[p:p + 200] = b"\1" * 200
        spans = sum(1 for j, m in enumerate(mask) if m and (j == 0 or not mask[j - 1]))
        left = bytes(x for x, m in zip(b, mask) if not m)
        want[doc_id, len(b), sum(mask), spans, hashlib.sha256(left).hexdigest()] += 1
    got = op6_repeats.remove_repeats(spark.createDataFrame(table, "doc_id bigint, text string").repartition(3)).collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert op6_repeats.remove_repeats(none).count() == 0


def test_repeats_keep_only_their_runs(docs, spark):
    """What is stored on the way goes as soon as the runs are written; a place gives back its three numbers."""
    folder = shared_folder(spark)
    before = set(os.listdir(folder))
    text = words(200, 77)
    table = spark.createDataFrame([(1, text), (2, "a " + text), (3, text + " b"), (4, words(90, 5))], "doc_id bigint, text string")
    runs = op6_repeats.repeated_starts(table)
    assert len([x for x in set(os.listdir(folder)) - before if x.startswith("table-")]) == 1
    assert runs.count() and runs.columns == ["key", "first", "last"]
    data = text.encode()
    _, _, anchor, first, last = op6_repeats.phrases(np.frombuffer(data, np.uint8), op6_repeats.Hasher())
    own = op6_repeats.phrase_table(table.filter("doc_id = 1")).select(
        *[op6_repeats.in_place(F.col("place"), x) for x in ("anchor", "first", "last")])
    assert sorted(map(tuple, own.collect())) == sorted(zip(anchor.tolist(), first.tolist(), last.tolist()))


def test_scratch_inside_scratch(docs, spark):
    """What the inner one keeps goes with the outer one."""
    with scratch(spark):
        with scratch(spark):
            kept, gone = saved(spark.range(3).toDF("n"), keep=True), saved(spark.range(2).toDF("n"))
            lost = re.sub("^file:/+", "/", gone.inputFiles()[0])
        path = re.sub("^file:/+", "/", kept.inputFiles()[0])
        assert kept.count() == 3 and os.path.exists(path) and not os.path.exists(lost)
    assert not os.path.exists(path)


def test_warc(spark, docs, tmp_path):
    body = "<p>" + "x" * 120 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3</p>"
    pages = spark.createDataFrame([(5, "http://a/", body), (3, "http://b/\r\nx", body), (9, None, body), (1, "u", "short"), (2, "u", "short"),
                                   (7, "u", None), (None, "u", "é" * 90)], "page_id bigint, url string, html string")
    op7_warc.write_archives(pages, str(tmp_path / "w"))
    got = {r["metadata"]["page_id"]: r for r in op7_warc.assemble(op7_warc.read_records(spark, str(tmp_path / "w"))).collect()}
    assert len(got) == 7 and got[3]["response"]["payload"] == body and got[5]["response"]["kind"] == "revisit"
    assert got[9]["response"]["refers_to"] == "<urn:page:3>" and got[2]["response"]["kind"] == "response"
    assert got[7]["metadata"]["payload_bytes"] == 0 and got[None]["response"]["payload_bytes"] == 180
    for r in got.values():
        if r["response"]["kind"] == "response":
            assert r["response"]["digest"] == r["response"]["payload_digest"]


def test_mixing(docs, rows, none):
    parts = op9_mixing.mix(docs).collect()
    sizes = collections.Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, share = {}, 1.5 * sum(sizes.values())
    open_ = set(names)
    while True:
        level = (share - sum(goal.values())) / max(1, sum(weight[s] for s in open_))
        bound = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not bound:
            break
        goal |= {s: 2.0 * sizes[s] for s in bound}
        open_ -= bound
    goal |= {s: level * weight[s] for s in open_}
    taken = collections.Counter()
    for p in parts:
        assert p["target"] == pytest.approx(goal[p["source"]])
        if p["to_word"] is not None:
            taken[p["source"]] += p["to_word"] - p["from_word"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in names)
    places = [(p["shard"], p["slot"]) for p in parts if p["slot"] is not None]
    assert max(s for _, s in places) < op9_mixing.SLOTS
    again = collections.Counter(map(tuple, op9_mixing.mix(docs).collect()))
    assert again == collections.Counter(map(tuple, parts))
    mixed = op9_mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r["text"])) for r in mixed.collect()) == sum(taken.values())
    assert op9_mixing.mix(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_permutation(spark, docs, n):
    row = spark.range(n).select(op9_mixing.permuted(F.col("id"), F.lit(n), F.lit(3)).alias("x"), "id")
    back = row.select("x", op9_mixing.permuted(F.col("x"), F.lit(n), F.lit(3), backwards=True).alias("y"), "id").collect()
    assert sorted(r["x"] for r in back) == list(range(n)) and all(r["y"] == r["id"] for r in back)


def test_language(spark, docs, none):
    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op10_language.predict(data, op10_language.fit(data)).join(data.select("doc_id", "lang"), "doc_id")
    held = got.filter(op10_language.remainder(F.col("doc_id")) == 2)
    assert held.filter("lang_pred = lang").count() >= 0.97 * held.count()
    odd = op10_language.predict(docs, op10_language.fit(data)).collect()
    assert {r["lang_pred"] for r in odd if r["doc_id"] in (4, 5, 6, 13)} == {"und"}
    assert {r["lang_pred"] for r in op10_language.predict(docs, op10_language.fit(none)).collect()} == {"und"}


def test_pipeline(spark, docs):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    ids = {r["doc_id"] for r in out}
    good = {r["doc_id"] for r in op8_quality.verdicts(op8_quality.ledger(documents)).filter("kept").collect()}
    bench = [" ".join(op3_decontamination.words_of(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    text_of = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert ids <= good
    assert not any(b in " ".join(op3_decontamination.words_of(text_of[i])) for i in ids for b in bench)
    assert len({text_of[i] for i in ids}) == len(ids)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def jaccard_classes(texts):
    """Classes of distinct texts by exact Jaccard similarity of five-word shingles: text to a set of texts."""
    sets = {}
    for t in texts:
        ws = WORD.findall(t)
        sets[t] = {tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()
    of = {t: {t} for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if of[a] is not of[b] and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                of[a] |= of[b]
                for t in of[a]:
                    of[t] = of[a]
    return of


def one_of_each(table):
    """(doc_id, text) rows with one of each class, the smallest doc_id (NULL last); a tie is left to the caller's ids."""
    of = jaccard_classes(sorted({t for _, t in table if t is not None}))
    best = {}
    for doc_id, t in table:
        if t is not None:
            name = min(of[t])
            best[name] = min(best.get(name, (True, 1 << 62)), (doc_id is None, doc_id or 0))
    return of, collections.Counter([(n, None if none else d) for n, (none, d) in best.items()])


def test_near_duplicates_ids(spark, docs):
    """Ids that are NULL or name several texts do not put unlinked texts into one class."""
    base = words(120)
    near = base.replace("w7 ", "other ", 1)
    table = [(None, words(90, 400)), (None, words(90, 401)), (None, words(90, 402)), (None, words(90, 402)), (None, ""),
             (7, words(80, 500)), (7, words(80, 501)), (7, words(80, 501)), (3, base), (7, near), (None, near), (9, None), (None, None)]
    frame = spark.createDataFrame(table, "doc_id bigint, text string").repartition(3)
    of, want = one_of_each(table)
    got = op1_ngram_join.keep_one(frame).collect()
    assert collections.Counter((min(of[r["text"]]), r["doc_id"]) for r in got if r["text"] is not None) == want
    assert sorted(r["doc_id"] or 0 for r in got if r["text"] is None) == [0, 9]
    joined = frame.join(op1_ngram_join.with_keys(frame).select("text", F.col("_own_key").alias("key")).distinct(), "text")
    text_of = {bytes(r["key"]): r["text"] for r in joined.collect()}
    keys = collections.defaultdict(set)
    for r in op1_ngram_join.join(frame).collect():
        if r["key"] is None:
            assert r["class_key"] is None
        else:
            keys[min(of[text_of[bytes(r["key"])]])].add(bytes(r["class_key"]))
    assert len(keys) == len(want) and all(len(k) == 1 for k in keys.values())
    assert len(set.union(*keys.values())) == len(want)


def test_pipeline_rows(spark, docs, tmp_path):
    """The rows that each deterministic stage keeps, and what the others make of them, by brute force."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    given = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]

    def passes(text):
        ws, lines = WORD.findall(text or ""), [line for line in (text or "").split("\n") if WORD.search(line)]
        tri = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
        counts = collections.Counter(tri)
        covered = {j for i, t in enumerate(tri) if counts[t] > 1 for j in range(i, i + 3)}
        return not (len(ws) < 50 or 100 * len(covered) > 50 * len(ws) or 10 * sum(c in "#*$%&|<>" for c in text) > len(ws)
                    or len(lines) >= 5 and 100 * (len(lines) - len(set(lines))) > 40 * len(lines)
                    or not 2 * len(ws) <= sum(map(len, ws)) <= 12 * len(ws) or 100 * sum(w.isupper() for w in ws) > 60 * len(ws))

    good = max(given, key=lambda r: len(r[1] or "") if passes(r[1]) else 0)[1]
    given += [(None, words(200, k), "en", "web", None) for k in range(3)] + [(5, words(210, 50 + k), "en", "web", None) for k in range(2)]
    given += [(None, good + " end", "en", "web", None)]
    spark.createDataFrame(given, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")

    rows = [r[:2] for r in given if passes(r[1])]
    of, kept = one_of_each(rows)
    bench = [op3_decontamination.words_of(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def leaks(text):
        """Whether an item stands in the text word by word."""
        line = " " + " ".join(op3_decontamination.words_of(text)) + " "
        return any(b and " " + " ".join(b) + " " in line for b in bench)

    stages = dict(corpus_pipeline.STAGES)
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first = stages["quality rules"](spark, read, str(tmp_path))
    assert collections.Counter((r["doc_id"], r["text"]) for r in first.collect()) == collections.Counter(rows)
    second = stages["n-gram Jaccard join"](spark, first, str(tmp_path))
    got = second.collect()
    assert collections.Counter((min(of[r["text"]]), r["doc_id"]) for r in got) == kept
    third = [r["text"] for r in stages["benchmark decontamination"](spark, second, str(tmp_path)).collect()]
    clean = {r["text"] for r in got if not leaks(r["text"])}
    altered = clean - set(third)  # contain an item with changes: judged by the stage, few
    assert set(third) <= clean and len(third) == len(set(third)) and len(altered) <= len(bench)
    # all that is left comes out of the whole run, as often and as long as the targets say, in full shards
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = {t: r["doc_id"] for t in third for r in got if r["text"] == t}
    assert {w for r in out for w in WORD.findall(r["text"])} <= {w for t in whole for w in WORD.findall(t)}
    plan = op9_mixing.mix(spark.createDataFrame(
        [(r["doc_id"], r["text"], r["source"]) for r in got if r["text"] in whole], "doc_id bigint, text string, source string"))
    takes = plan.filter("lap IS NOT NULL").groupBy("doc_id").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("n")).collect()
    have = collections.Counter()
    for r in out:
        have[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert have == collections.Counter({r["doc_id"]: r["n"] for r in takes})
    slots = collections.defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_near_duplicates_beside_large_group(spark, docs):
    """A large group of near copies does not end the search for separate pairs at the threshold."""
    base = words(300).split()
    group = [" ".join([*base[:i], f"other{i}", *base[i + 1:]]) for i in range(300)]
    pairs = []
    for k in range(1000):
        own = [f"p{k}x{i}" for i in range(40)]  # 32 of 40 shingles shared
        pairs += [" ".join(own), " ".join(own[:36] + [f"q{k}x{i}" for i in range(4)])]
    frame = spark.createDataFrame(list(enumerate(group + pairs)), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["n_links"] for r in op1_ngram_join.join(frame).collect()}
    missed = sum(got[i] != 1 for i in range(300, 2300)) / 2
    assert missed <= 1000 * (1 - op1_ngram_join.RECALL) + 1e-6 and all(got[i] == 299 for i in range(300))


def test_mixing_repeated_empty_rows(spark, docs, tmp_path):
    """Rows without words are told apart even where source, id and text are equal."""
    table = [(None, None, "a")] * 4 + [(None, "", "a")] * 3 + [(2, " ", "a")] * 2 + [(1, words(700), "a")] * 2 + [(3, None, None)] * 2
    spark.createDataFrame(table, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op9_mixing.op9_mixing(spark, str(tmp_path)).collect()
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter(
        (d, len(WORD.findall(t or ""))) for d, t, _ in table)
    assert all(r["taken"] == 0 for r in got if r["size"] == 0) and sum(r["taken"] for r in got) == 2100


def test_html_constants(spark, docs):
    """A text is boilerplate where different pages agree on all of it at one place, and only there."""
    def host(name, pages):
        return [(f"{name}{i}", f"http://{name}.example/{i}", p) for i, p in enumerate(pages)]

    copy = "<body><div><h1>Head</h1><p>Short article.</p></div><div class=ad>{}</div></body>"
    long = "Terms &amp; conditions " + words(80)
    late = "<body><div class=intro>" + words(60) + " {0}</div><div class=body>" + words(60, 3) + " {0}</div><div class=end>" + long + "</div></body>"
    place = "<body><div class=a>Contact us</div><div class=b>{}</div></body>"
    rows = (host("c", [copy.format("x")] * 4) + host("d", [copy.format(i) for i in range(4)])
            + host("l", [late.format(i) for i in range(4)]) + host("m", [place.format(x) for x in ("one", "two", "three", "Contact us")]))
    got = {r["page_id"]: r["text"] for r in op5_html.extract(
        spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert all(got[f"{h}{i}"] == "Head\n\nShort article." for h in "cd" for i in range(4))
    assert [got[f"l{i}"] for i in range(4)] == [f"{words(60)} {i}\n\n{words(60, 3)} {i}" for i in range(4)]
    assert [got[f"m{i}"] for i in range(4)] == ["one", "two", "three", "Contact us"]


def test_html_region(spark, docs):
    """Without a named main part everything that varies is read, on each of a host's templates."""
    one = "<body><div class=top>Site name</div><h2>Title {0}</h2><div class=body><p>" + words(90) + " {0}</p><p>next {0}</p></div></body>"
    two = "<body><div class=top>Site name</div><div class=note>note {0}</div><div class=body><p>more {0}</p></div></body>"
    rows = [(i, f"http://r.example/{i}", (one if i < 4 else two).format(i)) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in op5_html.extract(
        spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[i] for i in range(4)] == [f"Title {i}\n\n{words(90)} {i}\n\nnext {i}" for i in range(4)]
    assert [got[i] for i in range(4, 8)] == [f"note {i}\n\nmore {i}" for i in range(4, 8)]


def test_licenses_side_by_side(spark, docs):
    """Short notices that follow each other directly are reported one by one."""
    scan = {r["doc_id"]: r for r in op4_licenses.scan_licenses(spark.createDataFrame([
        (1, "All rights reserved. All rights reserved."), (2, "Released under the MIT License.\n" * 4)],
        "doc_id bigint, text string")).collect()}
    assert [(m["first_word"], m["last_word"]) for m in scan[1]["matches"]] == [(0, 3), (3, 6)]
    assert [(m["first_word"], m["last_word"]) for m in scan[2]["matches"]] == [(0, 5), (5, 10), (10, 15), (15, 20)]
