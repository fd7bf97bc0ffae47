"""Joins against brute force on small data, and the shape of their plans."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import links, quality, rollup
from fleetlens.sources.tables import Batch, TableStore
from fleetlens.streaming.links import PairKeeper, update_pairs


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def cluster(spark):
    rnd = random.Random(1)
    texts = {"app": ["web", "db"], "tier": ["a", "b", "c"], "zone": ["z"]}
    pods = [("c%d" % (i % 2), f"p{i}", f"n{i % 3}", {k: rnd.choice(v) for k, v in texts.items() if rnd.random() < 0.8}) for i in range(60)]
    services = [("c%d" % (i % 2), f"s{i}", f"n{i % 3}", {k: rnd.choice(v) for k, v in texts.items() if rnd.random() < 0.5}) for i in range(25)]
    services += [("c0", "none", "n0", {}), ("c0", "null", "n0", None), ("c0", "unknown", "n0", {"zone": "z", "nowhere": "x"})]
    p = spark.createDataFrame(pods, "cluster_uuid string, pod_uuid string, namespace string, labels map<string,string>")
    s = spark.createDataFrame(services, "cluster_uuid string, service_uuid string, namespace string, selector map<string,string>")
    return pods, services, p, s


def brute(pods, services, same_namespace=False):
    return {(s[1], p[1]) for s in services for p in pods if s[3] and s[0] == p[0] and set(s[3].items()) <= set(p[3].items())
            and (not same_namespace or s[2] == p[2])}


@pytest.mark.parametrize("same", [False, True])
def test_service_pods_equals_brute_force(cluster, same):
    pods, services, p, s = cluster
    df = links.service_pods(p, s, same)
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(pods, services, same)
    assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_incremental_pairs(cluster, spark):
    pods, services, p, s = cluster
    old = links.service_pods(p.filter("pod_uuid < 'p3'"), s)
    gone = spark.createDataFrame([("p11",)], "pod_uuid string")
    for reconcile in (False, True):
        df = update_pairs(old, p.filter("pod_uuid >= 'p3'"), s.limit(0), p, s, gone, reconcile)
        assert {tuple(r) for r in df.collect()} == {x for x in brute(pods, services) if x[1] != "p11"}


def test_label_change_keeps_old_pair_unless_reconciled(spark):
    schema = "cluster_uuid string, pod_uuid string, namespace string, labels map<string,string>"
    now = spark.createDataFrame([("c", "p", "n", {"app": "db"})], schema)
    service = spark.createDataFrame([("c", "s", "n", {"app": "web"})], "cluster_uuid string, service_uuid string, namespace string, selector map<string,string>")
    pairs = spark.createDataFrame([("s", "p")], "service_uuid string, pod_uuid string")
    none = spark.createDataFrame([], "pod_uuid string")
    assert update_pairs(pairs, now, service.limit(0), now, service, none).count() == 1
    assert update_pairs(pairs, now, service.limit(0), now, service, none, reconcile=True).count() == 0


def test_stored_pairs_follow_both_sides(spark, tmp_path):
    """Pods and services come, change and go in several batches, each one called twice; the stored pairs equal brute force."""
    store = TableStore(spark, str(tmp_path / "store"))
    keeper = PairKeeper(store, reconcile=True)
    pod_schema, service_schema = "uuid string, cluster_uuid string, namespace string", "uuid string, cluster_uuid string, namespace string, resource_version string"
    entry = "uuid string, name string, value string"
    pods, services = {}, {}

    def rows(kind, changed, version, i):
        schema, link, noun = (pod_schema, "pod_label", "label") if kind == "pod" else (service_schema, "service_selector", "selector")
        own = [(u, "c", "n") + (() if kind == "pod" else (version,)) for u in changed]
        entries = [(f"{u}/{k}={v}", u, k, v) for u, held in changed.items() for k, v in held.items()]
        tables = {kind: spark.createDataFrame(own, schema), noun: spark.createDataFrame([(e, k, v) for e, _, k, v in entries], entry),
                  link: spark.createDataFrame([(u, e) for e, u, _, _ in entries], f"{kind}_uuid string, {noun}_uuid string")}
        with store.transaction(Batch(i, kind, "test")) as t:
            t.remove(tables[kind].select("uuid"), [(link, (f"{kind}_uuid",))])
            for name, df in tables.items():
                t.write_upsert(name, df)
        return tables

    steps = [({"p1": {"app": "a"}, "p2": {"app": "a", "tier": "x"}}, {}),
             ({"p3": {"app": "b"}}, {"s1": {"app": "a"}, "s2": {"app": "a", "tier": "x"}, "s0": {}}),
             ({"p1": {"app": "b"}, "p4": {"app": "a", "tier": "x", "more": "z"}}, {"s1": {"app": "b"}}),
             ({"p2": {"app": "a"}}, {"s2": {"tier": "x"}, "s3": {"app": "none"}})]
    none = spark.createDataFrame([], "uuid string")
    for i, (new_pods, new_services) in enumerate(steps):
        pods |= new_pods
        services |= new_services
        made = {kind: rows(kind, changed, str(i), i) for kind, changed in (("pod", new_pods), ("service", new_services)) if changed}
        for _ in range(2):
            for kind, tables in made.items():
                keeper(kind, tables, none, Batch(i, "changes", "test"))
        stored = store.read("service_pod")
        got = [] if stored is None else [tuple(r) for r in stored.select("service_uuid", "pod_uuid").collect()]
        want = {(s, p) for s, wanted in services.items() for p, held in pods.items() if wanted and wanted.items() <= held.items()}
        assert sorted(got) == sorted(want), i
    gone = spark.createDataFrame([("s2",)], "uuid string")
    store.cascade_delete("service", gone)
    keeper("service", {}, gone, Batch(9, "changes", "test"))
    assert {r.service_uuid for r in store.read("service_anchor").collect()} == {"s1", "s3"}
    assert "s2" not in {r.service_uuid for r in store.read("service_pod").collect()}


def test_node_lookup(spark):
    nodes = spark.sql("""SELECT 'c' cluster_uuid, 'u1' uuid, named_struct('name', 'n1') meta,
      named_struct('addresses', array(named_struct('type', 'InternalIP', 'address', '10.0.0.1'), named_struct('type', 'ExternalIP', 'address', '8.8.8.8'))) status""")
    points = spark.sql("""SELECT * FROM VALUES ('c', 'n1', 'x:1'), ('c', '', '10.0.0.1:9100'), ('c', NULL, '10.0.0.1'), ('c', '', '8.8.8.8:1'),
      ('c', '', 'a:b:c'), ('d', 'n1', NULL) AS t(cluster_uuid, node, instance)""")
    assert links.lookup_nodes(points, links.node_aliases(nodes)).count() == 3


def test_owner_roots_depth(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "y"), ("c", "d", "z"), ("d", "e", "w")], "child_uuid string, owner_uuid string, kind string")
    objects = spark.createDataFrame([("a",), ("c",), ("q",)], "uuid string")
    got = {r.uuid: (r.root_uuid, r.root_kind, r.hops) for r in links.owner_roots(objects, edges).collect()}
    assert got == {"a": ("e", "w", 4), "c": ("e", "w", 2), "q": ("q", None, 0)}
    # a long chain, a chain that ends in a cycle, and an object without edges at all
    long = [(f"n{i}", f"n{i + 1}", f"k{i}") for i in range(11)] + [("x", "y", "k"), ("y", "z", "k"), ("z", "y", "k")]
    edges = spark.createDataFrame(long, edges.schema)
    objects = spark.createDataFrame([("n0",), ("n10",), ("n11",), ("x",), ("z",)], "uuid string")
    got = {r.uuid: (r.root_uuid, r.root_kind, r.hops) for r in links.owner_roots(objects, edges).collect()}
    assert got == {"n0": ("n11", "k10", 11), "n10": ("n11", "k10", 1), "n11": ("n11", None, 0), "x": (None, None, None), "z": (None, None, None)}
    assert {r.hops for r in links.owner_roots(objects, edges.limit(0)).collect()} == {0}


def test_quality_and_roll_up(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None)], "uuid string, phase string")
    assert quality.pk_violations(df, ["uuid"]).first().rows == 2
    assert quality.null_violations(df, ["phase"]).first().bad_rows == 1
    assert quality.enum_violations(df, {"phase": ["y"]}).first().bad_rows == 1
    checks = quality.check_table("namespace", df)
    assert set(checks) == {"primary_key", "domain"}
    favorites = spark.createDataFrame([("r1", "pod", "u", 2), ("r2", "pod", "u", None), ("r3", "pod", "u", 1)],
                                      "resource_uuid string, kind string, username string, priority int")
    assert [r.resource_uuid for r in rollup.favorites_of(favorites, "u", "pod").collect()] == ["r3", "r1", "r2"]
    incidents = spark.createDataFrame([("pod", "ab1"), ("pod", "ab1"), ("pod", "cd")], "resource string, uuid string")
    found = [(r.resource, r.uuid) for r in rollup.incidents_by_kind(incidents).collect()]
    assert sorted(found) == sorted({(r.resource, r.uuid) for r in incidents.collect()})


def test_unreadable_rule_leaves_alerts_without_rules(spark):
    from fleetlens.operators.alerts import match_rules
    alerts = spark.createDataFrame([("u", "c", "pod")], "uuid string, cluster_uuid string, kind string")
    sources = {"t_rule": spark.createDataFrame([("u",)], "uuid string")}
    run = lambda *rules: match_rules(spark, alerts, spark.createDataFrame(list(rules), "id string, filter string"), sources, "v7").first()
    good = ("r1", '{"version":1,"kind":"pod","query":"SELECT 1 FROM t_rule WHERE uuid = ? AND \'?\' = \'?\'","args":[":uuid"]}')
    assert run(("r0", ""), good).rule_ids == ["r0", "r1"] and run(good).rules_version == "v7"
    assert run(("r0", ""), good, ("bad", "{nonsense")).rule_ids == []
    assert run(("r0", ""), ("old", '{"version":2,"kind":"pod","query":"SELECT 1","args":[]}')).rule_ids == []
    assert run(("r0", ""), ("fails", '{"version":1,"kind":"pod","query":"SELECT 1 FROM missing_table","args":[]}')).rule_ids == []
    assert run(("r0", ""), ("other", '{"version":1,"kind":"node","query":"SELECT 1 FROM missing_table","args":[]}')).rule_ids == ["r0"]


def rule(id_, query, *args, kind="pod"):
    return id_, json.dumps({"version": 1, "kind": kind, "query": query, "args": list(args)})


def test_many_rules_of_few_texts(spark):
    from fleetlens.operators.alerts import match_rules
    n = 500
    alerts = spark.createDataFrame([(f"u{i}", "c", "pod") for i in range(40)], "uuid string, cluster_uuid string, kind string")
    sources = {"obj": spark.createDataFrame([(f"u{i}", f"p{i % 7}", i) for i in range(40)], "uuid string, phase string, size int")}
    spark.createDataFrame([(1,)], "mine int").createOrReplaceTempView("obj")
    texts = [f"SELECT 1 FROM obj WHERE uuid = ? AND phase = ? AND size >= {i}" for i in range(4)] + ["SELECT size FROM obj o WHERE ? < o.size AND o.uuid = ?"]
    rows = [rule(f"r{i}-{t}", text, *([":uuid", f"p{i}"] if t < 4 else [str(i), ":uuid"])) for i in range(n) for t, text in enumerate(texts)]
    rules = spark.createDataFrame(rows, "id string, filter string")
    got = match_rules(spark, alerts, rules, sources)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LocalRelation") + plan.count("LogicalRDD") < 40 and "CartesianProduct" not in plan
    want = {f"u{i}": sorted([f"r{i % 7}-{t}" for t in range(4) if i >= t] + [f"r{k}-4" for k in range(n) if k < i]) for i in range(40)}
    assert {r.uuid: r.rule_ids for r in got.collect()} == want
    assert spark.table("obj").columns == ["mine"], "the user's view is as it was"


def test_an_argument_that_does_not_fit_leaves_the_other_rules(spark):
    from fleetlens.operators.alerts import match_rules
    alerts = spark.createDataFrame([("u", "c", "pod"), ("n", "c", "node")], "uuid string, cluster_uuid string, kind string")
    sources = {"obj": spark.createDataFrame([("u", 5), ("n", 5)], "uuid string, size int")}
    rules = spark.createDataFrame([
        ("all", ""), rule("fits", "SELECT 1 FROM obj WHERE uuid = ? AND size = ?", ":uuid", "5"),
        rule("bad", "SELECT 1 FROM obj WHERE uuid = ? AND size = ?", ":uuid", "five"), rule("zero", "SELECT 1 FROM obj WHERE uuid = ? AND 1 / (size - 5) > 0", ":uuid"),
        rule("cast", "SELECT 1 FROM obj WHERE uuid = ? AND CAST(? AS INT) = 5", ":uuid", "x"),
        rule("few", "SELECT 1 FROM obj WHERE uuid = ? AND size = ?", ":uuid", kind="node")], "id string, filter string")
    got = {r.kind: r.rule_ids for r in match_rules(spark, alerts, rules, sources).collect()}
    assert got == {"pod": ["all", "fits"], "node": []}
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_rules_that_change_while_they_are_matched(spark):
    from fleetlens.operators.alerts import match_current_rules
    alerts = spark.createDataFrame([("u", "c", "pod")], "uuid string, cluster_uuid string, kind string")

    def changing(times):
        state = {"reads": 0}

        def rules():
            state["reads"] += 1
            version = min(state["reads"] // 2, times)
            return spark.createDataFrame([(f"r{version}", "")], "id string, filter string"), {}, str(version)
        return rules

    settled = match_current_rules(spark, alerts, changing(2)).first()
    assert settled.rules_version == "2" and settled.rule_ids == ["r2"]
    with pytest.raises(RuntimeError):
        match_current_rules(spark, alerts, changing(99))
