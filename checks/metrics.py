"""The metric catalogue over samples of the driver's tables, and the expected points written as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import check, flat
from checks.sql import u5
from checks.tables import landing, new_store
from fleetlens.operators import samples as S
from fleetlens.operators.links import node_aliases
from fleetlens.plans import metric_catalogue as M
from fleetlens.schemas import feed_schema
from fleetlens.sources.readers import append_samples, read_samples, stored_samples
from fleetlens.streaming.metrics import MetricPoller

# Exact halves round differently in the two engines (decimal text against binary product): both sides add this first.
OFF_HALF = 0.0000000123

NODE_LABELS = "node, instance, cpu, mode, device"
POD_LABELS = "instance, namespace, pod, container"
GAUGE_LABELS = "node, instance, namespace, pod, container, resource, mountpoint, phase, qos_class"


def instant_sql(metric: str, where: str = "TRUE") -> str:
    """Newest sample per series for each of the five steps it is visible at."""
    return f"""(SELECT * FROM (SELECT g.*, slice + k * 60000 AS step FROM (
 SELECT *, CAST(ceil(ts_ms / 60000.0) AS BIGINT) * 60000 AS slice FROM k_gauge WHERE metric = '{metric}' AND {where}) g, (VALUES (0), (1), (2), (3), (4)) t(k))
 QUALIFY ROW_NUMBER() OVER (PARTITION BY cluster_uuid, {GAUGE_LABELS}, step ORDER BY ts_ms DESC, value DESC) = 1)"""


def rate_sql(metric: str, window: int, where: str = "TRUE") -> str:
    """Rise of each series over the samples of each window, straight from the raw samples."""
    labels = POD_LABELS if metric.startswith("container") else NODE_LABELS
    copies = ", ".join(f"({k})" for k in range(window))
    return f"""(SELECT cluster_uuid, {labels}, step, SUM(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END) / ((MAX(ts_ms) - MIN(ts_ms)) / 1000.0) AS value FROM (
 SELECT *, LAG(value) OVER (PARTITION BY cluster_uuid, {labels}, step ORDER BY ts_ms) AS prev FROM (
  SELECT c.*, CAST(ceil(ts_ms / 60000.0) AS BIGINT) * 60000 + k * 60000 AS step FROM k_counter c, (VALUES {copies}) t(k) WHERE metric = '{metric}' AND {where}))
 GROUP BY cluster_uuid, {labels}, step HAVING COUNT(*) >= 2)"""


def points_sql(scope: str, category: str, values: str, by: list[str], name: str = "''") -> str:
    """Resolve values (cluster_uuid, step, labels, value) to entities; of colliding series the highest label text stays."""
    text = " || ',' || ".join(f"'{b}=' || COALESCE(v.{b}, '')" for b in by) or "''"
    joins = {
        "cluster": ("v.cluster_uuid", ""),
        "node": ("k.uuid", "JOIN k_node k ON k.cluster_uuid = v.cluster_uuid AND " + (
            "k.name = v.node" if "node" in by else "'10.0.0.' || k.nkey || ':9100' = v.instance")),
        "pod": ("k.uuid", "JOIN k_pod k ON k.cluster_uuid = v.cluster_uuid AND k.namespace = v.namespace AND k.name = v.pod"),
    }
    joins["container"] = (u5("k.uuid", "v.container"), joins["pod"][1])
    entity, join = joins[scope]
    return f"""SELECT entity_uuid, step AS timestamp, '{category}' AS category, name, ROUND(arg_max(value, text) + {OFF_HALF:.10f}, 6) AS value FROM (
 SELECT {entity} AS entity_uuid, v.step, {name} AS name, v.value, {text} AS text FROM ({values}) v {join}) GROUP BY ALL"""


def sum_sql(source: str, by: list[str], expression: str = "SUM(value)") -> str:
    keys = "".join(f", {b}" for b in by)
    return f"SELECT cluster_uuid, step{keys}, {expression} AS value FROM {source} GROUP BY cluster_uuid, step{keys}"


BUSY = "NOT regexp_full_match(mode, 'idle|iowait|steal')"
PHYSICAL = "NOT regexp_full_match(device, '(veth|azv|lxc).*')"
TOTAL, AVAILABLE = "node_memory_MemTotal_bytes", "node_memory_MemAvailable_bytes"
RECEIVE, TRANSMIT = "node_network_receive_bytes_total", "node_network_transmit_bytes_total"


def _used(by: list[str]) -> str:
    keys = "".join(f", a.{b}" for b in by)
    pair = f"""(SELECT a.cluster_uuid, a.step{keys}, a.value AS total, a.value - b.value AS used FROM {instant_sql(TOTAL)} a
 LEFT JOIN {instant_sql(AVAILABLE)} b ON a.cluster_uuid = b.cluster_uuid AND a.step = b.step AND a.node = b.node AND a.instance = b.instance)"""
    return sum_sql(pair, by, "SUM(used) / SUM(total)")


def _capacity_ratio(metric: str, resource: str, by: list[str], capacity: str) -> str:
    left = sum_sql(instant_sql(metric, f"resource = '{resource}'"), by)
    keys = "".join(f", l.{b}" for b in by)
    return f"""SELECT l.cluster_uuid, l.step{keys}, l.value / r.value AS value FROM ({left}) l JOIN ({sum_sql(instant_sql(capacity), ['node'])}) r
 ON l.cluster_uuid = r.cluster_uuid AND l.step = r.step AND l.node = r.node"""


def expected() -> dict[str, str]:
    found = {}

    def add(scope: str, category: str, values: str, by: list[str], name: str = "''") -> None:
        found[f"m_{scope}_{category.replace('.', '_')}"] = points_sql(scope, category, values, by, name)

    add("cluster", "node.count", sum_sql(instant_sql("kube_node_info"), [], "CAST(COUNT(DISTINCT node) AS DOUBLE)"), [])
    add("cluster", "namespace.count", sum_sql(instant_sql("kube_namespace_created"), [], "CAST(COUNT(*) AS DOUBLE)"), [])
    for phase in ("Running", "Pending", "Failed", "Succeeded"):
        add("cluster", f"pod.{phase.lower()}", sum_sql(instant_sql("kube_pod_status_phase", f"phase = '{phase}'"), []), [])
    inner = sum_sql(rate_sql("node_cpu_seconds_total", 1, BUSY), ["instance", "cpu"])
    add("cluster", "cpu.usage", sum_sql(f"({inner})", [], "AVG(value)"), [])
    add("cluster", "memory.usage", _used([]), [])
    add("cluster", "qos_by_class", sum_sql(instant_sql("kube_pod_status_qos_class"), ["qos_class"]), ["qos_class"])
    received = sum_sql(rate_sql(RECEIVE, 2, PHYSICAL), ["device"])
    add("cluster", "network.received.bytes", received, ["device"])
    add("cluster", "network.received.bytes.bydevice", received, ["device"], "v.device")
    add("cluster", "network.transmitted.bytes", sum_sql(rate_sql(TRANSMIT, 2, PHYSICAL), ["device"], "-SUM(value)"), ["device"])
    inner = sum_sql(rate_sql("node_cpu_seconds_total", 2, BUSY), ["node", "cpu"])
    add("node", "cpu.usage", sum_sql(f"({inner})", ["node"], "AVG(value)"), ["node"])
    add("node", "memory.usage", _used(["instance"]), ["instance"])
    add("node", "network.received.bytes", sum_sql(rate_sql(RECEIVE, 2), ["node"]), ["node"])
    add("node", "network.transmitted.bytes", sum_sql(rate_sql(TRANSMIT, 2), ["node"], "-SUM(value)"), ["node"])
    disk = f"""(SELECT a.cluster_uuid, a.step, a.node, a.mountpoint, 1 - a.value / b.value AS value FROM {instant_sql('node_filesystem_avail_bytes')} a
 JOIN {instant_sql('node_filesystem_size_bytes')} b ON a.cluster_uuid = b.cluster_uuid AND a.step = b.step AND a.node = b.node AND a.mountpoint = b.mountpoint)"""
    add("node", "filesystem.usage", sum_sql(disk, ["node", "mountpoint"]), ["node", "mountpoint"], "v.mountpoint")
    cpu = "container_cpu_usage_seconds_total"
    add("pod", "cpu.usage", sum_sql(rate_sql(cpu, 2), ["instance", "namespace", "pod"]), ["instance", "namespace", "pod"])
    add("pod", "cpu.usage.cores", sum_sql(rate_sql(cpu, 2), ["namespace", "pod"]), ["namespace", "pod"])
    memory = instant_sql("container_memory_usage_bytes")
    share = f"""SELECT l.cluster_uuid, l.step, l.instance, l.namespace, l.pod, l.value / r.value AS value FROM ({sum_sql(memory, ['instance', 'namespace', 'pod'])}) l
 JOIN ({sum_sql(instant_sql(TOTAL), ['node'])}) r ON l.cluster_uuid = r.cluster_uuid AND l.step = r.step AND l.instance = r.node"""
    add("pod", "memory.usage", share, ["instance", "namespace", "pod"])
    add("pod", "memory.usage.bytes", sum_sql(memory, ["namespace", "pod"]), ["namespace", "pod"])
    for scope, by in (("node", ["node"]), ("pod", ["node", "namespace", "pod"]), ("container", ["node", "namespace", "pod", "container"])):
        for resource, capacity in (("cpu", "machine_cpu_cores"), ("memory", "machine_memory_bytes")):
            for what in ("request", "limit"):
                metric = f"kube_pod_container_resource_{what}s"
                add(scope, f"{resource}.{what}", sum_sql(instant_sql(metric, f"resource = '{resource}'"), by), by)
                add(scope, f"{resource}.{what}.percentage", _capacity_ratio(metric, resource, by, capacity), by)
    return found


def _run(query: M.MetricQuery):
    def run(spark, sf):
        samples = I.samples(spark, sf, *[m for m in (query.metric, query.other) if m])
        aliases = node_aliases(I.objects(spark, sf, "node")) if query.scope == "node" else None
        # A node's exporter address names it as well: the lookup by instance strips the port.
        pods = I.pod_facts(spark, sf).select(
            S_uuid("cluster_uid").alias("cluster_uuid"), "namespace", "name", S_uuid("uid").alias("uuid")) if query.scope in ("pod", "container") else None
        points = M.to_points(query, M.evaluate(query, samples), aliases, pods)
        return flat(points).withColumn("value", F.round(F.col("value") + OFF_HALF, 6))
    return run


def S_uuid(column: str):
    from fleetlens.functions.ids import ensure_uuid
    return ensure_uuid(F.col(column))


_EXPECTED = expected()
for _key, _query in M.QUERIES.items():
    check(_key, _EXPECTED[_key])(_run(_query))


@check("counter_rate", f"""SELECT cluster_uuid, instance || '/' || cpu || '/' || mode AS series, step AS timestamp, ROUND(value + {OFF_HALF:.10f}, 6) AS rate FROM {rate_sql('node_cpu_seconds_total', 2)}""")
def counter_rate(spark, sf):
    rates = S.counter_rate(I.samples(spark, sf, "node_cpu_seconds_total"), 2, ["instance", "cpu", "mode"])
    return flat(rates.select("cluster_uuid", F.concat_ws("/", "instance", "cpu", "mode").alias("series"), F.col("step").alias("timestamp"), F.round(F.col("v0") + OFF_HALF, 6).alias("rate")))


@check("scan_samples", """SELECT metric, COUNT(*) AS samples, CAST(SUM(CAST(value AS BIGINT)) AS BIGINT) AS total FROM k_counter GROUP BY metric""")
def scan_samples(spark, sf):
    """All counter samples, read from files, stored by day and metric, and read from there."""
    landed = landing(spark, "samples")
    I.counters(spark, sf).select(*feed_schema("sample").names).write.parquet(landed)
    store = new_store(spark)
    with store.transaction() as t:
        append_samples(t, read_samples(spark, landed))
    samples, _ = stored_samples(store.snapshot(), [m for m, source in I.SAMPLE_SOURCES.items() if source is I.counters])
    return samples.groupBy("metric").agg(F.count(F.lit(1)).alias("samples"), F.sum(F.col("value").cast("bigint")).alias("total"))


_POLLED = [q for q in M.QUERIES.values() if q.scope in ("node", "cluster")]


@check("metric_poll", " UNION ALL ".join(f"SELECT '{q.scope}' AS scope, * FROM ({_EXPECTED[q.key]})" for q in _POLLED))
def metric_poll(spark, sf):
    """All node and cluster metrics by the poller, in three batches: the last one brings late samples, the second is repeated."""
    # Landed once, as every batch takes its part of the same feed.
    landed, made = landing(spark, "feed"), I.samples(spark, sf, *sorted({m for q in _POLLED for m in (q.metric, q.other) if m}))
    made.select("cluster_uuid", "metric", "labels", "ts", "value").write.parquet(landed)
    feed = spark.read.schema("cluster_uuid string, metric string, labels map<string,string>, ts timestamp, value double").parquet(landed)
    store = new_store(spark)
    poller = MetricPoller(store, lambda: I.objects(spark, sf, "node"), lambda: None, ("node", "cluster"), "check")
    second = F.pmod(F.unix_seconds("ts"), F.lit(60))
    for i, part in ((0, second < 25), (1, second >= 40), (1, second >= 40), (2, second.between(25, 39))):
        poller(feed.filter(part), i)
    now, merged = store.snapshot(), None
    for scope in poller.scopes:
        points = now.read(f"prometheus_{scope}_metric").withColumnRenamed(f"{scope}_uuid", "entity_uuid").withColumn("scope", F.lit(scope))
        merged = points if merged is None else merged.unionByName(points)
    return flat(merged).withColumn("value", F.round(F.col("value") + OFF_HALF, 6))
