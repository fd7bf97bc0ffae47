"""Joins between kinds, alerts and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.normalized import bare_tables, tables
from checks.registry import ORACLES, check, flat
from checks.sql import STATES, eu, ms, u5
from checks.tables import landing, new_store
from fleetlens.functions.ids import ensure_uuid
from fleetlens.operators import alerts, links, quality, rollup
from fleetlens.operators.normalize import normalize
from fleetlens.sources.readers import read_incidents
from fleetlens.sources.sinks import emit_alerts
from fleetlens.sources.tables import Batch
from fleetlens.streaming.links import PairKeeper, update_pairs


def pod_labels(spark, sf):
    return I.bare_pod_objects(spark, sf).select(
        "cluster_uuid", F.col("uuid").alias("pod_uuid"), F.col("meta.namespace").alias("namespace"), F.col("meta.labels").alias("labels"),
        F.regexp_extract("meta.uid", "([0-9]+)$", 1).cast("bigint").alias("pkey"))


def selectors(spark, sf):
    return I.objects(spark, sf, "service").select(
        "cluster_uuid", F.col("uuid").alias("service_uuid"), F.col("meta.namespace").alias("namespace"), F.col("spec.selector").alias("selector"),
        F.regexp_extract("meta.uid", "svc-([0-9]+)-", 1).cast("bigint").alias("nation_key"))


check("service_pods", "SELECT * FROM k_service_pod")(lambda spark, sf: links.service_pods(pod_labels(spark, sf), selectors(spark, sf)))


def deleted_pods(spark, sf):
    """Pods named by error events."""
    return I.table(spark, sf, "events").filter(F.col("event_type") == "error").select(ensure_uuid(I.text("order-", F.col("event_id"))).alias("pod_uuid"))


_DELETED = f"""SELECT {eu("'order-' || event_id")} AS pod_uuid FROM events WHERE event_type = 'error'"""
check("service_pods_after_delete", f"SELECT * FROM k_service_pod WHERE pod_uuid NOT IN ({_DELETED})")(
    lambda spark, sf: links.remove_pods(links.service_pods(pod_labels(spark, sf), selectors(spark, sf)), deleted_pods(spark, sf)))


@check("service_pods_incr", f"SELECT * FROM k_service_pod WHERE pod_uuid NOT IN ({_DELETED})")
def service_pods_incr(spark, sf):
    """Pairs of the even pods and services first, then a batch that changes the odd ones and deletes some pods."""
    pods, services = pod_labels(spark, sf), selectors(spark, sf)
    old_pods, new_pods = pods.filter("pkey % 2 = 0"), pods.filter("pkey % 2 = 1")
    old_services, new_services = services.filter("nation_key % 2 = 0"), services.filter("nation_key % 2 = 1")
    before = links.service_pods(old_pods, old_services)
    return update_pairs(before, new_pods, new_services, pods, services, deleted_pods(spark, sf))


_PAIRED = {"pod": ["pod", "pod_label", "label"], "service": ["service", "service_selector", "selector"]}


@check("store_service_pods", ORACLES["service_pods_incr"])
def store_service_pods(spark, sf):
    """Half of the pods and services, then the others, the second batch repeated, then deletions; pairs as the keeper stored them."""
    store = new_store(spark)
    keeper, deal = PairKeeper(store), F.pmod(F.xxhash64(F.col("meta.uid")), F.lit(2))
    for i in (0, 1, 1):
        made = {kind: normalize(kind, raw(spark, sf).filter(deal == i), I.AS_OF) for kind, raw in (("pod", I.bare_pods), ("service", I.services))}
        with store.transaction(Batch(i, "objects", "check")) as t:
            for kind, names in _PAIRED.items():
                for name in names:
                    t.write_upsert(name, made[kind][name])
        for kind, names in _PAIRED.items():
            keeper(kind, {name: made[kind][name] for name in names}, made[kind][kind].select("uuid").limit(0), Batch(i, "changes", "check"))
    store.cascade_delete("pod", deleted_pods(spark, sf), batch=Batch(2, "objects", "check"))
    return store.read("service_pod")


check("metric_node_lookup", f"""SELECT k.uuid AS node_uuid, c.cpu, c.mode, COUNT(*) AS samples FROM k_counter c JOIN k_node k ON k.cluster_uuid = c.cluster_uuid AND k.name = c.node
 WHERE c.metric <> 'container_cpu_usage_seconds_total' GROUP BY ALL""")(
    lambda spark, sf: links.lookup_nodes(
        I.samples(spark, sf, "node_cpu_seconds_total", "node_network_receive_bytes_total", "node_network_transmit_bytes_total").select(
            "cluster_uuid", F.when(F.col("labels.mode") != "idle", F.col("labels.node")).alias("node"), F.col("labels.instance").alias("instance"),
            F.col("labels.cpu").alias("cpu"), F.col("labels.mode").alias("mode")),
        links.node_aliases(I.objects(spark, sf, "node"))).groupBy("node_uuid", "cpu", "mode").agg(F.count(F.lit(1)).alias("samples")))
check("metric_pod_lookup", """SELECT p.uuid AS pod_uuid, COUNT(*) AS samples FROM k_counter c JOIN k_pod p ON p.cluster_uuid = c.cluster_uuid AND p.namespace = c.namespace AND p.name = c.pod
 WHERE c.metric = 'container_cpu_usage_seconds_total' GROUP BY ALL""")(
    lambda spark, sf: links.lookup_pods(
        I.samples(spark, sf, "container_cpu_usage_seconds_total").select("cluster_uuid", F.col("labels.namespace").alias("namespace"), F.col("labels.pod").alias("pod")),
        I.bare_pod_objects(spark, sf).select("cluster_uuid", "uuid", "meta.namespace", "meta.name")).groupBy("pod_uuid").agg(F.count(F.lit(1)).alias("samples")))


@check("stale_keys", f"""SELECT namespace || '/' || name AS key, uuid FROM k_pod WHERE pkey % 5 = 0 OR pkey % 3 = 0""")
def stale_keys(spark, sf):
    """Every fifth pod is gone, every third now has another uid."""
    stored = I.bare_pod_objects(spark, sf).select(F.concat_ws("/", "meta.namespace", "meta.name").alias("key"), "uuid", F.col("meta.uid").alias("uid"))
    k = F.regexp_extract("uid", "([0-9]+)$", 1).cast("bigint")
    now = stored.filter(k % 5 != 0).select("key", F.when(k % 3 == 0, ensure_uuid(F.concat("uid", F.lit("b")))).otherwise(F.col("uuid")).alias("uuid"))
    return links.stale_keys(stored.select("key", "uuid"), now)


def known(spark, sf):
    return {"pod": I.bare_pod_objects(spark, sf).select("uuid"), "node": I.objects(spark, sf, "node").select("uuid")}


check("orphan_incidents", "SELECT uuid, cluster_uuid, resource, name, namespace FROM k_incident WHERE uuid NOT IN (SELECT uuid FROM k_pod)")(
    lambda spark, sf: links.orphan_incidents(I.incidents(spark, sf), known(spark, sf)))
check("orphan_alerts", """SELECT uuid, NULLIF(cluster_uuid, '') AS cluster_uuid, resource AS kind, CASE WHEN namespace = '' THEN name ELSE namespace || '/' || name END AS name, 'ok' AS severity,
 'Automatically resolving the incident because of an orphaned resource.' AS message, 'https://web.example/pod?id=' || uuid AS url,
 CASE WHEN cluster_uuid = '' THEN '' ELSE 'cluster_uuid=' || cluster_uuid || ',' END || 'name=' || name || ',namespace=' || namespace || ',resource=pod,uuid=' || uuid AS tags,
 CAST(NULL AS VARCHAR) AS extra_tags FROM k_incident WHERE uuid NOT IN (SELECT uuid FROM k_pod)""")(
    lambda spark, sf: flat(alerts.orphan_alerts(I.incidents(spark, sf), known(spark, sf), "https://web.example")))
@check("scan_incidents", "SELECT uuid, cluster_uuid, resource, name, namespace FROM k_incident")
def scan_incidents(spark, sf):
    """Open incidents landed as JSON lines and read from there."""
    landed = landing(spark, "incidents")
    I.incidents(spark, sf).select(F.struct("uuid", "cluster_uuid", "resource", "name", "namespace").alias("object_tags")).write.json(landed)
    return read_incidents(spark, landed)


check("incidents_by_kind", "SELECT DISTINCT resource, uuid FROM k_incident")(
    lambda spark, sf: flat(rollup.incidents_by_kind(I.incidents(spark, sf))))


def _alerts(spark, sf):
    return alerts.alert_stream({kind: tables(spark, sf, kind)[kind] for kind in alerts.ALERT_KINDS}, "https://web.example")


_ALERT = f"""
SELECT 'pod' AS kind, uuid, cluster_uuid, namespace, name, state_no, health_reason AS message FROM k_pod_health"""


def _with_workloads() -> str:
    from checks.registry import ORACLES
    parts = [_ALERT.replace("state_no,", f"{STATES}[state_no + 1] AS s,")]
    parts.append(f"SELECT 'node', k.uuid, k.cluster_uuid, '', k.name, h.health_state, h.health_reason FROM k_node k JOIN ({ORACLES['health_node']}) h ON k.uuid = h.uuid")
    for kind in ("deployment", "daemon_set", "replica_set", "stateful_set"):
        parts.append(f"SELECT '{kind}', c.uuid, c.cluster_uuid, c.namespace, c.name, h.health_state, h.health_reason FROM k_customer c JOIN ({ORACLES[f'health_{kind}']}) h ON c.uuid = h.uuid")
    return " UNION ALL ".join(parts)


check("alerts", f"""
SELECT uuid, cluster_uuid, kind, namespace || '/' || name AS name, ['ok','info','err','warning','crit'][list_position({STATES}, s)] AS severity, message,
 'https://web.example/' || replace(kind, '_', '') || '?id=' || uuid AS url, 'cluster_uuid=' || cluster_uuid || ',name=' || name || ',namespace=' || namespace || ',resource=' || kind || ',uuid=' || uuid AS tags,
 CAST(NULL AS VARCHAR) AS extra_tags FROM ({_with_workloads()})""")(lambda spark, sf: flat(_alerts(spark, sf)))


@check("alerts_json", f"""
SELECT CAST(json_object('name', namespace || '/' || name, 'severity', ['ok','info','err','warning','crit'][list_position({STATES}, s)], 'message', message,
 'url', 'https://web.example/' || replace(kind, '_', '') || '?id=' || uuid,
 'tags', json_object('uuid', uuid, 'cluster_uuid', cluster_uuid, 'name', name, 'namespace', namespace, 'resource', kind), 'extra_tags', NULL) AS VARCHAR) AS record
FROM ({_with_workloads()})""")
def alerts_json(spark, sf):
    """Each alert as the line of JSON it is sent as; its batch is sent twice."""
    sent, found = landing(spark, "alerts"), _alerts(spark, sf)
    for _ in range(2):
        emit_alerts(found, sent, Batch(0, "alerts", "check"))
    return spark.read.option("recursiveFileLookup", True).text(sent).withColumnRenamed("value", "record")


RULES = [
    ("all", ""),
    ("failed", '{"version":1,"kind":"pod","query":"SELECT 1 FROM rule_pod WHERE uuid = ? AND phase = ?","args":[":uuid","Failed"]}'),
    ("segment", '{"version":1,"kind":"pod","query":"SELECT uuid FROM rule_label WHERE resource_uuid = ? AND name = \'segment\' AND value = \'MACHINERY\'","args":[":uuid"]}'),
    ("nodes", '{"version":1,"kind":"node","query":"SELECT 1 FROM rule_pod WHERE uuid = ?","args":[":uuid"]}'),
]


@check("rule_matches", """
SELECT uuid, 'pod' AS kind, 'all' || CASE WHEN phase = 'Failed' THEN ',failed' ELSE '' END || CASE WHEN segment = 'MACHINERY' THEN ',segment' ELSE '' END AS rule_ids FROM k_pod
UNION ALL SELECT uuid, 'node', 'all' FROM k_node""")
def rule_matches(spark, sf):
    t = bare_tables(spark, sf)
    found = alerts.to_alert("pod", t["pod"]).unionByName(alerts.to_alert("node", tables(spark, sf, "node")["node"]))
    sources = {"rule_pod": t["pod"].select("uuid", "phase"),
               "rule_label": t["resource_label"].join(t["label"], F.col("label_uuid") == F.col("uuid")).select("resource_uuid", "uuid", "name", "value")}
    rules = spark.createDataFrame(RULES, "id string, filter string")
    return flat(alerts.match_rules(spark, found, rules, sources).select("uuid", "kind", "rule_ids"))


check("containers_of_deleted", f"SELECT uuid, name FROM k_placed_container WHERE sort = 'main' AND pod_uuid IN ({_DELETED})")(
    lambda spark, sf: links.containers_of(tables(spark, sf, "pod")["container"], deleted_pods(spark, sf)).select("uuid", "name"))
check("resources_by_label", "SELECT resource_uuid FROM k_pod_label WHERE name = 'segment' AND value = 'BUILDING'")(
    lambda spark, sf: links.resources_by_label(bare_tables(spark, sf)["resource_label"], bare_tables(spark, sf)["label"], "segment", "BUILDING"))


@check("owner_roots", f"""
SELECT p.uuid, CASE WHEN p.owner_key % 4 = 0 OR p.owner_key % 4 = 1 THEN {eu("'nation-' || c.nation_key")} ELSE {eu("'cust-' || p.owner_key")} END AS root_uuid,
 CASE WHEN p.owner_key % 4 IN (0, 1) THEN 'deployment' ELSE 'replica_set' END AS root_kind, CASE WHEN p.owner_key % 4 IN (0, 1) THEN 2 ELSE 1 END AS hops
FROM k_pod p JOIN k_customer c ON p.owner_key = c.ckey""")
def owner_roots(spark, sf):
    """Pod -> workload -> nation, where the workload is a deployment or replica set."""
    edges = None
    for kind in ("pod", "deployment", "replica_set"):
        part = bare_tables(spark, sf, kind)[f"{kind}_owner"].filter("controller").select(F.col(f"{kind}_uuid").alias("child_uuid"), "owner_uuid", "kind")
        edges = part if edges is None else edges.unionByName(part)
    return flat(links.owner_roots(I.bare_pod_objects(spark, sf).select("uuid"), edges))


@check("claim_links", f"""
SELECT p.uuid AS pod_uuid, 'data' AS volume_name, 'claim-' || p.owner_key AS claim_name, {eu("'pvc-' || p.owner_key")} AS pvc_uuid,
 CASE WHEN p.owner_key % 4 <> 0 THEN 'pv-' || p.owner_key END AS bound_volume, CASE WHEN p.owner_key % 4 <> 0 THEN {eu("'pv-' || p.owner_key")} END AS persistent_volume_uuid
FROM k_pod p JOIN k_customer c ON p.owner_key = c.ckey AND p.cluster_uuid = c.cluster_uuid AND p.namespace = c.namespace WHERE p.pkey % 3 = 0""")
def claim_links(spark, sf):
    pods, claims, volumes = bare_tables(spark, sf), tables(spark, sf, "pvc"), tables(spark, sf, "persistent_volume")
    return links.claim_links(pods["pod_pvc"], pods["pod"].select("uuid", "cluster_uuid", "namespace"), claims["pvc"], volumes["persistent_volume_claim_ref"])


check("events_with_pod", f"""SELECT 'ev-' || event_id AS uid, event_type AS reason, p.name AS object_name, p.namespace AS object_namespace
 FROM events LEFT JOIN k_pod p ON p.pkey = event_id""")(
    lambda spark, sf: links.events_with_reference(tables(spark, sf, "event")["event"], I.bare_pod_objects(spark, sf).select("uuid", "meta.name", "meta.namespace")).select(
        "uid", "reason", "object_name", "object_namespace"))


# --- checks of produced tables ----------------------------------------------------------------------------------

check("pk_violations", "SELECT l_orderkey, l_linenumber, COUNT(*) AS rows FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1")(
    lambda spark, sf: flat(quality.pk_violations(I.container_versions(spark, sf), ["l_orderkey", "l_linenumber"])))
check("null_violations", """SELECT 'reason' AS "column", COUNT(*) FILTER (reason IS NULL) AS bad_rows FROM k_pod UNION ALL SELECT 'uuid', 0 FROM k_pod GROUP BY 1
 UNION ALL SELECT 'node_name', COUNT(*) FILTER (node_name IS NULL) FROM k_pod""")(
    lambda spark, sf: quality.null_violations(bare_tables(spark, sf)["pod"], ["reason", "uuid", "node_name"]))
check("orphan_children", f"SELECT pkey, name FROM k_container_fact WHERE pkey NOT IN (SELECT pkey FROM k_pod WHERE pkey % 2 = 0)")(
    lambda spark, sf: quality.orphan_children(
        I.container_facts(spark, sf).select("pkey", F.col("spec.name").alias("name"), ensure_uuid(I.text("order-", F.col("pkey"))).alias("pod_uuid")),
        "pod_uuid", I.bare_pod_objects(spark, sf).filter(F.regexp_extract("meta.uid", "([0-9]+)$", 1).cast("bigint") % 2 == 0)).select("pkey", "name"))
check("unused_labels", """SELECT label_uuid AS uuid, name, value FROM k_pod_label WHERE resource_uuid IN (SELECT uuid FROM k_pod WHERE phase = 'Failed')""")(
    lambda spark, sf: quality.unused_labels(
        bare_tables(spark, sf)["label"],
        bare_tables(spark, sf)["resource_label"].join(bare_tables(spark, sf)["pod"].filter("phase <> 'Failed'").select(F.col("uuid").alias("resource_uuid")), "resource_uuid", "left_semi")))
check("length_violations", """SELECT 'text' AS "column", COUNT(*) FILTER (length(text) > 255) AS bad_rows FROM conversations UNION ALL SELECT 'role', COUNT(*) FILTER (length(role) > 4) FROM conversations""")(
    lambda spark, sf: quality.length_violations(I.table(spark, sf, "conversations"), {"text": 255, "role": 4}))
check("enum_violations", """SELECT 'phase' AS "column", COUNT(*) FILTER (phase NOT IN ('Running', 'Pending')) AS bad_rows FROM k_pod UNION ALL
 SELECT 'qos', COUNT(*) FILTER (qos NOT IN ('Guaranteed', 'Burstable', 'BestEffort')) FROM k_pod UNION ALL SELECT 'reason', COUNT(*) FILTER (reason = 'Evicted') FROM k_pod""")(
    lambda spark, sf: quality.enum_violations(bare_tables(spark, sf)["pod"], {
        "phase": ["Running", "Pending"], "qos": ["Guaranteed", "Burstable", "BestEffort"], "reason": ["NodeLost"]}))
