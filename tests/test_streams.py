"""Streaming functions over file sources, compared with batch results."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from fleetlens import schemas
from fleetlens.functions.text import log_tail
from fleetlens.operators.links import node_aliases
from fleetlens.operators.normalize import with_meta
from fleetlens.plans.metric_catalogue import metric_points
from fleetlens.session import DROP_SHUFFLES
from fleetlens.sources.readers import append_samples, read_changes, stored_samples
from fleetlens.sources.tables import TableStore
from fleetlens.streaming.alerts import alert_subscriber
from fleetlens.streaming.changes import ChangeApplier, not_deleting_soon, reconcile, run_changes
from fleetlens.streaming.links import label_maps
from fleetlens.streaming.logs import LogKeeper, append_logs, lines_of_containers, started_only
from fleetlens.streaming.metrics import MetricPoller

NOW = dt.datetime(2024, 1, 1, 12)


def change(seq, type_, uid, kind="config_map", **meta):
    body = {"meta": {"uid": uid, "namespace": "ns", "name": uid, "resourceVersion": str(seq), "labels": {"n": str(seq % 3)}, **meta}}
    if kind == "deployment":
        body |= {"desired": 1, "available": 0, "unavailable": 1}
    return {"seq": seq, "type": type_, "cluster_uid": "c", "kind": kind, "uid": uid, "key": f"ns/{uid}", "ts": "2024-01-01T00:00:00Z",
            "object": None if type_ == "DELETED" else json.dumps(body)}


def put(folder, name, changes):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(c) + "\n" for c in changes))


def random_feed(n):
    rnd = random.Random(7)
    feed = [change(i, rnd.choice(["ADDED", "UPDATED", "UPDATED", "DELETED"]), f"o{rnd.randrange(6)}", rnd.choice(["config_map", "event"])) for i in range(n)]
    return feed


def state(store):
    out = {}
    for table in ("config_map", "event", "config_map_label", "resource_label"):
        df = store.read(table)
        out[table] = sorted(tuple(r) for r in df.collect()) if df is not None else []
    return out


def drive(spark, tmp_path, name, files, **options):
    store = TableStore(spark, str(tmp_path / name / "store"))
    applier = ChangeApplier(store, kinds=["config_map", "event"], as_of=lambda: NOW, **options)
    source = tmp_path / name
    source.mkdir()
    for i, part in enumerate(files):
        put(source / "in", f"{i}.json", part)
        stream = read_changes(spark, str(source / "in"), stream=True)
        run_changes(stream, applier, str(source / "cp"), availableNow=True).awaitTermination()
    return store


def test_one_batch_equals_many_with_restarts(spark, tmp_path):
    feed = random_feed(30)
    whole = drive(spark, tmp_path, "one", [feed])
    parts = drive(spark, tmp_path, "many", [feed[:9], feed[9:21], feed[21:]])
    assert state(whole) == state(parts)
    last = {}
    for c in feed:
        if c["kind"] == "config_map":
            last[c["uid"]] = c
    kept = {c["uid"]: str(c["seq"]) for c in last.values() if c["type"] != "DELETED"}
    assert {r.uid: r.resource_version for r in whole.read("config_map").collect()} == kept
    assert {r.uid for r in whole.read("event").collect()} == {c["uid"] for c in feed if c["kind"] == "event" and c["type"] != "DELETED"}


def test_repeated_batch_and_delete_soon(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    applier = ChangeApplier(store, kinds=["config_map"], as_of=lambda: NOW)
    soon = {"deletionTimestamp": (NOW + dt.timedelta(seconds=20)).isoformat() + "Z"}
    later = {"deletionTimestamp": (NOW + dt.timedelta(seconds=40)).isoformat() + "Z"}
    first = [change(0, "ADDED", "x"), change(1, "ADDED", "a"), change(2, "ADDED", "b", **soon), change(3, "ADDED", "c", **later)]
    second = [change(4, "DELETED", "a"), change(5, "UPDATED", "c")]
    frame = lambda rows: spark.createDataFrame([json.dumps(r) for r in rows], "string").select(
        F.from_json("value", schemas.FEED_SCHEMAS["change"]).alias("c")).select("c.*")
    applier(frame(first), 0)
    assert {r.uid for r in store.read("config_map").collect()} == {"x", "a", "c"}
    for _ in range(3):
        applier(frame(second), 1)
    assert {r.uid: r.resource_version for r in store.read("config_map").collect()} == {"x": "0", "c": "5"}
    assert store.read("config_map_label").count() == 2


def test_subscribers_run_after_the_write_and_send_alerts(spark, tmp_path):
    store, seen = TableStore(spark, str(tmp_path / "s")), []
    applier = ChangeApplier(store, kinds=["deployment"], as_of=lambda: NOW, subscribers=[
        lambda kind, tables, gone, batch: seen.append((kind, store.read("deployment").count())),
        alert_subscriber(str(tmp_path / "alerts"), "https://w")])
    rows = spark.createDataFrame([json.dumps(change(1, "ADDED", "d", "deployment"))], "string").select(
        F.from_json("value", schemas.FEED_SCHEMAS["change"]).alias("c")).select("c.*")
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "alerts").rglob("*")}
    applier(rows, 0)
    assert seen == [("deployment", 1)]
    once = files()
    applier(rows, 0)
    assert files() == once and len(seen) == 2, "a repeated batch sends nothing again"
    next((tmp_path / "alerts").rglob("_SUCCESS")).unlink()
    applier(rows, 0)
    assert spark.read.option("recursiveFileLookup", True).json(str(tmp_path / "alerts")).count() == 1, "a batch that was cut off replaces what it left"
    sent = spark.read.option("recursiveFileLookup", True).json(str(tmp_path / "alerts")).first()
    assert sent.severity == "crit" and sent.name == "ns/d" and sent.url.startswith("https://w/deployment?id=") and sent.tags.resource == "deployment"


def test_reconcile(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    raw = lambda *pairs: spark.createDataFrame(
        [{"cluster_uid": "c", "meta": {"uid": u, "namespace": "ns", "name": n, "resourceVersion": "1"}} for u, n in pairs], schemas.kind_schema("config_map"))
    store.cascade_upsert("config_map", raw(("u1", "a"), ("u2", "b"), ("u3", "x")))
    stale = reconcile(store, "config_map", raw(("u1", "a"), ("u2new", "b")))
    assert {r.key.split("|")[2] for r in stale.collect()} == {"b", "x"}
    assert {r.uid for r in store.read("config_map").collect()} == {"u1"}


def test_stored_logs_over_batches(spark, tmp_path):
    """Numbers with gaps and repeats, a repeated batch, containers that have not started, a deleted pod, an empty batch."""
    store = TableStore(spark, str(tmp_path / "store"))
    names = {(p, c): None for p in ("p1", "p2", "p3") for c in ("a", "b")}
    found = lines_of_containers(spark.createDataFrame([(p, c, NOW, 0, "") for p, c in names], schemas.FEED_SCHEMAS["log_line"])).collect()
    ids = dict(zip(names, [(r.container_uuid, r.pod_uuid) for r in found]))
    store.write_upsert("container", spark.createDataFrame(
        [(*ids[k], k != ("p2", "b")) for k in names], "uuid string, pod_uuid string, started boolean"))
    store.write_upsert("pod", spark.createDataFrame([(x,) for x in {p for _, p in ids.values()}], "uuid string"))
    rnd = random.Random(5)
    batches = [[(p, c, NOW + dt.timedelta(seconds=i), rnd.randrange(5) * 10**15 + b * 10**17, rnd.choice(["é" * rnd.randrange(9), "plain", "", None]))
                for p, c in rnd.choices(list(names), [9, 1, 1, 1, 1, 1], k=n) for i in [rnd.randrange(n)]] for b, n in enumerate((400, 60, 0, 90))]
    keeper, want = LogKeeper(store, 90, writer="test"), dict.fromkeys(names)
    for b, lines in enumerate(batches):
        df = spark.createDataFrame(lines, schemas.FEED_SCHEMAS["log_line"]).repartition(3)
        keeper(df, b)
        keeper(df, b)
        for p, c, _, _, text in sorted(lines, key=lambda x: (x[3], x[2], (x[4] or "") + "\n")):
            want[p, c] = (want[p, c] or "") + (text or "") + "\n"
    whole = spark.createDataFrame([(ids[k][0], t) for k, t in want.items() if k != ("p2", "b") and t], "c string, t string")
    expected = {r.c: r.t for r in whole.select("c", log_tail(F.col("t"), 90).alias("t")).collect()}
    assert {r.container_uuid: r.logs for r in store.read("container_log").collect()} == expected
    store.cascade_delete("pod", spark.createDataFrame([(ids["p1", "a"][1],)], "uuid string"))
    assert {r.pod_uuid for r in store.read("container_log").collect()} == {ids["p2", "a"][1], ids["p3", "a"][1]}


def test_logs_equal_plain_concatenation(spark):
    rnd = random.Random(3)
    lines = [(c, i, dt.datetime(2024, 1, 1), rnd.choice(["é" * rnd.randrange(9), "plain", "", None])) for c in ("hot", "cold") for i in range(6000 if c == "hot" else 3)]
    df = spark.createDataFrame(lines, "container_uuid string, seq bigint, ts timestamp, text string").repartition(4)
    stored = spark.createDataFrame([("cold", "old\n", None), ("idle", "same", None)], "container_uuid string, logs string, last_update timestamp")
    for size in (50, 4000):
        got = {r.container_uuid: r.logs for r in append_logs(stored, df, size).collect()}
        whole = {c: "".join((t or "") + "\n" for k, _, _, t in lines if k == c) for c in ("hot", "cold")}
        whole["cold"] = "old\n" + whole["cold"]
        want = spark.createDataFrame(list(whole.items()), "c string, t string").select("c", log_tail(F.col("t"), size).alias("t"))
        assert got == {**{r.c: r.t for r in want.collect()}, "idle": "same"}
    started = spark.createDataFrame([("hot", True), ("cold", False)], "uuid string, started boolean")
    assert started_only(df, started).select("container_uuid").distinct().collect()[0][0] == "hot"


def test_metric_poller_updates_its_own_minutes(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    base = dt.datetime(2024, 1, 1, 0, 0)
    rows = [("c", "kube_pod_container_resource_requests", {"node": "n1", "namespace": "ns", "pod": "p", "container": "a", "resource": "cpu"},
             base + dt.timedelta(seconds=60 * i), float(i)) for i in range(4)]
    rows += [("c", "machine_cpu_cores", {"node": "n1"}, base + dt.timedelta(seconds=60 * i), 4.0) for i in range(4)]
    feed = spark.createDataFrame(rows, "cluster_uuid string, metric string, labels map<string,string>, ts timestamp, value double")
    node = spark.createDataFrame([{"cluster_uid": "k", "meta": {"uid": "u", "name": "n1"}, "status": {"addresses": []}}], schemas.kind_schema("node"))
    nodes = with_meta(node).withColumn("cluster_uuid", F.lit("c"))
    pods = spark.createDataFrame([("c", "ns", "p", "pu")], "cluster_uuid string, namespace string, name string, uuid string")
    poller = MetricPoller(store, lambda: nodes, lambda: pods, scopes=("node",), writer="w")
    poller(feed.filter(F.col("ts") < F.lit(base + dt.timedelta(minutes=2))), 0)
    poller(feed.filter(F.col("ts") >= F.lit(base + dt.timedelta(minutes=2))), 1)
    got = {(r.category, r.timestamp.minute): r.value for r in store.read("prometheus_node_metric").collect()}
    # the last value stays visible for five steps
    assert {k: v for k, v in got.items() if k[0] == "cpu.request"} == {("cpu.request", i): float(min(i, 3)) for i in range(8)}
    assert got["cpu.request.percentage", 3] == 0.75


def test_metric_poller_equals_the_batch_form(spark, tmp_path):
    base = dt.datetime(2024, 1, 1, 0, 0)
    minutes = [0, 1, 4, 5, 13, 14, 30, 2, 31]  # with gaps and a late sample
    rows = [("c", metric, {"node": "n1", "namespace": "ns", "pod": "p", "container": "a", "resource": "cpu"}, base + dt.timedelta(minutes=m, seconds=s), m + s + 1.0)
            for m in minutes for s in (0, 20) for metric in ("kube_pod_container_resource_requests", "machine_cpu_cores")]
    feed = spark.createDataFrame(rows, "cluster_uuid string, metric string, labels map<string,string>, ts timestamp, value double")
    node = spark.createDataFrame([{"cluster_uid": "k", "meta": {"uid": "u", "name": "n1"}, "status": {"addresses": []}}], schemas.kind_schema("node"))
    nodes = with_meta(node).withColumn("cluster_uuid", F.lit("c"))
    pods = spark.createDataFrame([("c", "ns", "p", "pu")], "cluster_uuid string, namespace string, name string, uuid string")

    def points(df):
        return sorted((r.category, r.name, r.timestamp, r.value) for r in df.collect())

    want = points(metric_points("node", feed, node_aliases(nodes), pods))
    for parts in (1, 3):
        store = TableStore(spark, str(tmp_path / str(parts)))
        poller = MetricPoller(store, lambda: nodes, lambda: pods, scopes=("node",), writer=f"in {parts}")
        size = -(-len(rows) // parts)
        for i in range(parts):
            for _ in range(1 + (i == 1)):
                poller(spark.createDataFrame(rows[i * size:(i + 1) * size], feed.schema), i)
        assert store.read("sample").count() == len(rows) and store.read("series").count() == 1
        found, _ = poller.sums_of_minutes(feed)
        text = found._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "CartesianProduct" not in text
        assert points(store.read("prometheus_node_metric")) == want


def test_label_maps_and_guard(spark):
    pods = spark.createDataFrame([("u", "c", "ns")], "uuid string, cluster_uuid string, namespace string")
    links = spark.createDataFrame([("u", "l1"), ("u", "l2")], "resource_uuid string, label_uuid string")
    labels = spark.createDataFrame([("l1", "a", "1"), ("l2", "b", "2")], "uuid string, name string, value string")
    assert label_maps(pods, links, labels).first().labels == {"a": "1", "b": "2"}
    raw = spark.createDataFrame([{"cluster_uid": "c", "meta": {"uid": "u"}}], schemas.kind_schema("config_map"))
    assert not_deleting_soon(raw, NOW).count() == 1


def test_stored_samples_open_only_their_days_and_metrics(spark, tmp_path):
    rows = [("c", f"m{i % 3}", {"n": str(i % 2)}, dt.datetime(2024, 1, 1 + i % 4, 12), float(i)) for i in range(24)]
    feed = spark.createDataFrame(rows, "cluster_uuid string, metric string, labels map<string,string>, ts timestamp, value double")
    store = TableStore(spark, str(tmp_path / "s"))
    for i in range(2):
        with store.transaction() as t:
            append_samples(t, feed.filter(F.col("value") % 2 == i))
    assert store.read("series").count() == 2

    def picked():
        samples, series = stored_samples(store.snapshot(), ["m1"], dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3, 20))
        text = samples._jdf.queryExecution().executedPlan().toString()
        filters = text.split("PartitionFilters: [")[1].split("]")[0]
        assert "_day" in filters and "metric" in filters
        files = {r[0] for r in samples.select(F.input_file_name()).distinct().collect()}
        assert all("metric=m1" in f and ("_day=2024-01-02" in f or "_day=2024-01-03" in f) for f in files)
        back = samples.join(series, ["cluster_uuid", "series_id"])
        return sorted((r.metric, r.labels["n"], r.ts, r.value) for r in back.collect())

    want = sorted((m, labels["n"], ts, v) for _, m, labels, ts, v in rows if m == "m1" and ts.day in (2, 3))
    assert picked() == want
    assert set(store.compact(force=True)) == {"sample", "series"}
    assert picked() == want and store.read("sample").count() == 24
    store.most_files = 2
    for i in range(3):
        with store.transaction() as t:
            append_samples(t, feed.limit(1))
    assert store.compact() == ["sample"] and store.read("sample").count() == 27
    store.retention("sample", "2024-01-03 13:00:00")
    assert {r.ts.day for r in store.read("sample").collect()} == {3, 4}
    with pytest.raises(ValueError), store.transaction() as t:
        t.append("label", feed)


def test_poller_deals_samples_by_series_only(spark, tmp_path):
    """The minutes of a batch are staged, so Spark knows how few they are; its setting for shuffle files comes back after each write."""
    store, before = TableStore(spark, str(tmp_path / "s")), spark.conf.get(DROP_SHUFFLES)
    rows = [("c", "machine_cpu_cores", {"node": f"n{i}"}, dt.datetime(2024, 1, 1, 0, i), 4.0) for i in range(4)]
    feed = spark.createDataFrame(rows, "cluster_uuid string, metric string, labels map<string,string>, ts timestamp, value double")
    poller = MetricPoller(store, lambda: None, lambda: None, scopes=("node",), writer="w")
    with store.transaction() as t:
        append_samples(t, feed)
    assert spark.conf.get(DROP_SHUFFLES) == before
    with store.transaction() as t:
        found, steps = poller.sums_of_minutes(feed, t.stage)
        text = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(_minute" not in text and "hashpartitioning(series_id" in text
        assert steps.count() == 8 and {r.by[0]: [p.minute - 28401120 for p in r.points] for r in found.collect()} == {
            f"n{i}": list(range(i, i + 5)) for i in range(4)}
