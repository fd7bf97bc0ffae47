"""Instant values and counter rates against a plain model."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import samples as S
from fleetlens.plans import metric_catalogue as M

BASE = 1700000000 // 60 * 60
SCHEMA = "cluster_uuid string, metric string, labels map<string,string>, ts timestamp, value double"


def at(seconds):
    return dt.datetime.fromtimestamp(BASE + seconds, dt.timezone.utc)


def frame(spark, rows):
    return spark.createDataFrame([("c", m, labels, at(s), float(v)) for m, labels, s, v in rows], SCHEMA)


def seconds(ts):
    return round(ts.replace(tzinfo=dt.timezone.utc).timestamp() - BASE, 3)


@pytest.mark.parametrize("window", [1, 2, 3])
def test_rate_equals_model(spark, window):
    rnd = random.Random(window)
    rows, total = [], 0
    for s in sorted(rnd.sample(range(0, 600), 60)):
        total = 0 if rnd.random() < 0.1 else total + rnd.randint(0, 9)
        rows.append(("m", {"a": "1"}, s, total))
    rows += [("m", {"a": "2"}, 60, 5), ("m", {"a": "2"}, 120, 9), ("m", {"a": "3"}, 30, 1)]
    want = {}
    for name in "123":
        mine = [(s, v) for m, labels, s, v in rows if labels["a"] == name]
        for end in range(0, 900, 60):
            inside = [(s, v) for s, v in mine if end - 60 * window < s <= end]
            if len(inside) >= 2:
                rise = sum(b[1] if b[1] < a[1] else b[1] - a[1] for a, b in zip(inside, inside[1:]))
                want[name, float(end)] = rise / (inside[-1][0] - inside[0][0])
    # A repeated sample changes nothing.
    df = frame(spark, rows + rows[:20])
    got = {(r.a, seconds(r.step)): r.v0 for r in S.counter_rate(df, window, ["a"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_instant_equals_model(spark):
    rows = [("g", {"a": "1"}, 5, 1), ("g", {"a": "1"}, 50, 2), ("g", {"a": "1"}, 200, 3), ("g", {"a": "1"}, 240, 4), ("g", {}, 60, 9)]
    want = {}
    for name in ("1", ""):
        mine = [(s, v) for _, labels, s, v in rows if labels.get("a", "") == name]
        for end in range(0, 1200, 60):
            inside = [v for s, v in mine if end - 300 < s <= end]
            if inside:
                want[name, float(end)] = float(inside[-1])
    got = {(r.a, seconds(r.step)): r.v0 for r in S.instant(frame(spark, rows), ["g"], ["a"]).collect()}
    assert got == want
    point = S.instant_at(frame(spark, rows), at(210)).orderBy("v0").collect()
    assert [r.v0 for r in point] == [3.0, 9.0]


def test_samples_closer_than_a_millisecond_and_ties(spark):
    close = frame(spark, [("m", {}, 10 + i * 0.0001, i) for i in range(10)])
    assert abs(S.counter_rate(close, 2).first().v0 - 10000.0) < 1e-6
    tied = frame(spark, [("g", {}, 5, v) for v in (1, 3, 2)])
    assert {r.v0 for r in S.instant(tied, ["g"]).collect()} == {3.0}


def test_minute_bucket(spark):
    df = spark.createDataFrame([(dt.datetime(1970, 1, 1, 0, 1, 59, 900000),)], "ts timestamp")
    assert df.select(S.minute_bucket_ms(F.col("ts"))).first()[0] == 60000


def test_matchers_and_division(spark):
    df = frame(spark, [("m", {"d": "veth1"}, 0, 1), ("m", {"d": "eth0veth"}, 0, 2), ("m", {}, 0, 3), ("n", {}, 0, 4)])
    assert sorted(r.value for r in S.matches(df, "m", not_regex={"d": "(veth|lxc).*"}).collect()) == [2.0, 3.0]
    assert S.matches(df, "m", equal={"d": ""}).first().value == 3.0
    row = spark.range(1).select(S.divide(F.lit(1.0), F.lit(0.0)).alias("i"), S.divide(F.lit(0.0), F.lit(0.0)).alias("n"), S.divide(F.lit(1.0), F.lit(4.0)).alias("q")).first()
    assert row.i == float("inf") and row.n != row.n and row.q == 0.25
    assert S.drop_nan(spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "value double")).count() == 1


def test_collisions_and_names(spark):
    df = frame(spark, [("kube_pod_status_qos_class", {"qos_class": q}, 0, v) for q, v in (("Burstable", 3), ("Guaranteed", 1), ("BestEffort", 2))])
    query = M.QUERIES["m_cluster_qos_by_class"]
    values = M.evaluate(query, df)
    one = M.to_points(query, values).filter(F.col("timestamp") == F.lit(at(0)).cast("timestamp")).collect()
    assert [(r.name, r.value) for r in one] == [("", 1.0)]
    assert {r.name for r in M.to_points(query, values, keep_all=True).collect()} == {f"qos_class={q}" for q in ("Burstable", "Guaranteed", "BestEffort")}


def test_catalogue_is_complete():
    assert len(M.QUERIES) == 45
    assert {s: sum(q.scope == s for q in M.QUERIES.values()) for s in ("cluster", "node", "pod", "container")} == {
        "cluster": 12, "node": 13, "pod": 12, "container": 8}


def test_one_shuffle_of_raw_samples(spark):
    plan = S.counter_rate(frame(spark, [("m", {}, 0, 1)]), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "NestedLoop" not in plan


def test_sums_keep_a_value_in_one_row_for_all_its_minutes(spark):
    """A value travels as a span: one row per block of minutes, also over the end of a block and for two spans of one sum."""
    who = {"node": "n", "namespace": "ns", "pod": "p", "container": "c", "resource": "cpu"}
    start = 60 * (60 - BASE // 60 % 60) - 120  # two minutes before a block ends
    rows = [("kube_pod_container_resource_requests", who, start, 2), ("kube_pod_container_resource_requests", {**who, "container": "d"}, start + 120, 1),
            ("machine_cpu_cores", {"node": "n"}, start, 4), ("machine_cpu_cores", {"node": "n"}, start + 180, 0)]
    query = M.QUERIES["m_pod_cpu_request_percentage"]
    found = M.sums([query], frame(spark, rows))
    assert found.filter(F.size("by") == 3).count() == 2 and found.filter(F.size("by") == 1).count() == 2
    points = M.evaluate(query, frame(spark, rows)).select("pod", F.inline("points")).collect()
    # the second container joins after two minutes, the first one leaves after five; then a node without cores
    assert {r.minute - (BASE + start) // 60: r.value for r in points} == {0: 0.5, 1: 0.5, 2: 0.75, 3: float("inf"), 4: float("inf"), 5: float("inf"), 6: float("inf")}
    pods = spark.createDataFrame([("c", "ns", "p", "u")], "cluster_uuid string, namespace string, name string, uuid string")
    got = M.to_points(query, M.evaluate(query, frame(spark, rows)), pods=pods)
    assert {(seconds(r.timestamp) - start) / 60: r.value for r in got.collect()} == {r.minute - (BASE + start) / 60: r.value for r in points}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(entity_uuid" in plan and "timestamp" not in plan.split("hashpartitioning(entity_uuid")[1].split(")")[0]


def test_samples_of_pods_are_dealt_once(spark):
    """Samples with labels are dealt by pod; sums and lookup follow in the same partitions, then points are dealt by entity."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    ids = [f"{i}0000000-0000-4000-8000-00000000000{i}" for i in range(3)]
    pods = spark.createDataFrame([("c", "s", "p", ids[0]), ("c", "s", "q", ids[1]), ("c", "t", "p", ids[2])],
                                 "cluster_uuid string, namespace string, name string, uuid string")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for key in ("m_container_cpu_limit", "m_pod_memory_limit", "m_pod_memory_usage_bytes", "m_pod_cpu_usage"):
            query = M.QUERIES[key]
            rows = []
            for namespace, pod, value in (("s", "p", 1), ("s", "q", 2), ("t", "p", 4), ("t", "gone", 8), ("s", "", 16)):
                who = {"node": "n", "instance": "n", "namespace": namespace, "pod": pod, "container": "c", "resource": "memory" if "memory" in key else "cpu"}
                rows += [(query.metric, who, at, value * at) for at in (30, 60)]
                rows.append((query.metric, {**who, "node": "o", "instance": "o"}, 30, 0))
            points = M.to_points(query, M.evaluate(query, frame(spark, rows)), None, pods)
            plan = points._jdf.queryExecution().executedPlan().toString()
            found = {(r.entity_uuid, r.value) for r in points.collect() if seconds(r.timestamp) == 60}
            # the higher label text stays, but where nodes are added up; one sample gives no rate
            want = {"m_pod_cpu_usage": (1, 2, 4), "m_pod_memory_usage_bytes": (60, 120, 240)}.get(key, (0, 0, 0))
            assert sorted(v for _, v in found) == list(want), key
            dealt = plan.count("Exchange hashpartitioning(")
            assert dealt == 3 - (key == "m_pod_memory_usage_bytes") and "hashpartitioning(l_pod" in plan, key  # one of them deals the pods
            if key != "m_container_cpu_limit":
                assert {u for u, _ in found} == set(ids)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_containers_are_dealt_before_their_specifications_are_made(spark):
    from checks import inputs as I

    plan = I.pods(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "img/" in plan.split("RepartitionByExpression")[0] and "img/" not in plan.split("RepartitionByExpression")[1]


def test_gauges_are_sorted_once_and_points_are_made_once(spark):
    """Newest values follow from one window, spans of a block from another; no test of the points runs before they are taken apart."""
    query = M.QUERIES["m_pod_cpu_limit"]
    labels = {"node": "n", "namespace": "s", "pod": "p", "resource": "cpu"}
    rows = [(query.metric, {**labels, "container": c}, s, v) for c, s, v in (
        ("a", 10, 1), ("a", 10, 4), ("a", 5, 9), ("a", 130, 2), ("b", 70, 8), ("b", 130, 16))]
    df = frame(spark, rows)
    found = M.sums([query], df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    pods = spark.createDataFrame([("c", "s", "p", "u")], "cluster_uuid string, namespace string, name string, uuid string")
    points = M.to_points(query, M.evaluate(query, df), None, pods)
    assert "size(filter(transform" not in points._jdf.queryExecution().optimizedPlan().toString()
    # containers added up: the first is seen from minute 1, the second from minute 2, both anew from minute 3
    assert {seconds(r.timestamp) / 60: r.value for r in points.collect()} == {1: 4.0, 2: 12.0, **{m: 18.0 for m in range(3, 8)}}


def test_a_null_value_or_label_map_keeps_its_place(spark):
    """Of values at one instant a NULL is the least; a series without labels is one series."""
    df = spark.createDataFrame([("c", "g", None, at(5), 3.0), ("c", "g", None, at(5), None), ("c", "g", None, at(50), None),
                                ("c", "g", None, at(70), 7.0), ("c", "g", None, None, 1.0)], SCHEMA)
    spans = S.series_spans(df, (), ["g"]).filter("first IS NOT NULL").collect()
    minute = BASE // 60
    assert sorted((r.first - minute, r.last - minute, r.value) for r in spans) == [(1, 1, None), (2, 6, 7.0)]


def test_containers_are_gathered_as_sorted(spark, tmp_path):
    """A pod's containers are sorted as numbers once; neither specifications nor nested containers are sorted again."""
    from checks import inputs as I

    at = dt.datetime(2000, 1, 1)
    rows = {
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N", 0)]),
        "supplier": ("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", [(0, "S", 0, 0.0)]),
        "customer": ("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", [(1, "C", 0, 0.0, "M")]),
        "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
                   [(k, 1, "O", 1.0, at, "1") for k in (1, 2)]),
        "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double,"
                     " l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
                     [(1, part, 1, n, 13.0 if n == 4 else 1.0, 1.0, 0.0, 0.0, "N", "F", at) for n in (4, 2, 5, 1, 3) for part in (7, 8)]),
    }
    for name, (schema, made) in rows.items():
        spark.createDataFrame(made, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    pods = I.pods(spark, str(tmp_path))
    found = {r["uid"]: r for r in pods.select(
        "meta.uid", F.col("spec.initContainers.name").alias("inits"), F.col("spec.containers.name").alias("mains"),
        F.col("spec.containers.image").alias("images"), F.col("status.containerStatuses.name").alias("told")).collect()}
    one, two = found["order-1"], found["order-2"]
    assert (one.inits, one.mains, one.told) == (["c-1", "c-2"], ["c-3", "c-4", "c-5"], ["c-3", "c-5"])
    assert set(one.images) == {"img/8:1"} and (two.inits, two.mains, two.told) == (None, None, None)
    plan = pods._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "ObjectHashAggregate" not in plan
