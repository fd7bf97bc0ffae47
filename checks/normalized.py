"""Normalised tables of every kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import check, flat
from checks.sql import STATES, eu, ms, u5
from fleetlens.operators import normalize as N
from fleetlens.operators import rollup
from fleetlens.operators.merge import dedup_last


def tables(spark, sf, kind):
    return N.normalize(kind, I.RAW[kind](spark, sf), I.AS_OF)


def bare_tables(spark, sf, kind="pod"):
    """As :func:`tables`, but pods come without containers: for child tables that do not depend on them."""
    return N.normalize("pod", I.bare_pods(spark, sf), I.AS_OF) if kind == "pod" else tables(spark, sf, kind)


def _meta(uid: str, cluster: str, namespace: str, name: str, created: str) -> str:
    return (f"{eu(uid)} AS uuid, {cluster} AS cluster_uuid, {uid} AS uid, {namespace} AS namespace, {name} AS name, '1' AS resource_version, "
            f"{created} AS created")


def _norm(key: str, kind: str, sql: str, table: str | None = None, source=tables):
    check(key, sql)(lambda spark, sf: flat(source(spark, sf, kind)[table or kind]))


check("meta_pods", f"SELECT uuid, cluster_uuid, uid, namespace, name, '1' AS resource_version, {ms('created')} AS created FROM k_pod")(
    lambda spark, sf: flat(I.bare_pod_objects(spark, sf).select(*N.meta_columns())))

_norm("norm_namespace", "namespace", f"""
SELECT {_meta("'nation-' || n_nationkey", eu("'region-' || n_regionkey"), "''", "n_name", "n_nationkey * 86400000")},
 CASE WHEN n_nationkey % 7 = 0 THEN 'Terminating' ELSE 'Active' END AS phase FROM nation""")

_norm("norm_node", "node", f"""
WITH f AS (SELECT uuid, name, pos, CASE WHEN type = 'Ready' AND status = 'Unknown' THEN 2 ELSE 4 END AS s,
  'Node ' || name || CASE type WHEN 'DiskPressure' THEN ' is running out of disk space' WHEN 'MemoryPressure' THEN ' is running out of available memory'
    WHEN 'PIDPressure' THEN ' is running out of process IDs' WHEN 'NetworkUnavailable' THEN ' network is not correctly configured'
    ELSE ' has ''NodeReady'' condition ''' || lower(status) || '''' END AS t
  FROM k_node_condition WHERE (type = 'Ready' AND status <> 'True') OR (type <> 'Ready' AND status = 'True')),
g AS (SELECT uuid, arg_max(s, pos) AS s, string_agg(t, '. ' ORDER BY pos) || '.' AS t FROM f GROUP BY uuid)
SELECT k.uuid, cluster_uuid, uid, '' AS namespace, name, '1' AS resource_version, nkey * 3600000 AS created,
 '10.' || (nkey % 256) || '.0.0/' || (22 + nkey % 4) AS pod_cidr, CAST(pow(2, 32 - (22 + nkey % 4)) - 2 AS BIGINT) AS num_ips, nkey % 11 = 0 AS unschedulable,
 nkey % 5 NOT IN (3, 4) AS ready, (nkey % 8 + 1) * 1000 AS cpu_capacity, (nkey % 8 + 1) * 900 AS cpu_allocatable,
 (nkey % 8 + 1) * 4 * 1073741824000 AS memory_capacity_milli, (nkey % 8 + 1) * 3 * 1073741824000 AS memory_allocatable_milli, CAST(110 AS BIGINT) AS pod_capacity,
 CASE WHEN nkey % 10 = 0 THEN 'control-plane, worker' ELSE 'worker' END AS roles, 'm-' || nkey AS machine_id, '' AS system_uuid, '' AS boot_id, '' AS kernel_version,
 '' AS os_image, '' AS operating_system, 'amd64' AS architecture, '' AS container_runtime_version, '' AS kubelet_version, '' AS kube_proxy_version,
 {STATES}[COALESCE(g.s, 0) + 1] AS health_state, COALESCE(g.t, 'Node ' || k.name || ' is ok.') AS health_reason
FROM k_node k LEFT JOIN g ON k.uuid = g.uuid""")

_norm("norm_pod", "pod", f"""
SELECT h.uuid, cluster_uuid, uid, namespace, name, '1' AS resource_version, {ms('created')} AS created, node_name, CAST(NULL AS VARCHAR) AS nominated_node_name,
 '10.1.0.' || (pkey % 250) AS ip, 'Always' AS restart_policy, r.cpu_limits, r.cpu_requests, r.memory_limits_milli, r.memory_requests_milli, phase,
 {STATES}[state_no + 1] AS health_state, health_reason, reason, message, qos FROM k_pod_health h LEFT JOIN k_pod_resources r ON h.uuid = r.pod_uuid""")

_DETAILS = """CASE WHEN NOT has_status THEN NULL WHEN flag = 'A' THEN '{"exitCode":' || (q % 3) || ',"signal":' || (q % 2) || ',"reason":"Error","message":" out of memory. ","finishedAt":"' || strftime(shipped, '%Y-%m-%dT%H:%M:%S.000Z') || '"}'
 WHEN flag = 'N' THEN '{"startedAt":"' || strftime(shipped, '%Y-%m-%dT%H:%M:%S.000Z') || '"}' ELSE '{"reason":"' || waiting_reason || '","message":"back-off. "}' END AS state_details"""
_CONTAINER = f"""uuid, pod_uuid, name, image, 'IfNotPresent' AS image_pull_policy, cpu_limits, cpu_requests, memory_limits_milli, memory_requests_milli,
 CASE WHEN has_status THEN CASE flag WHEN 'A' THEN 'Terminated' WHEN 'N' THEN 'Running' ELSE 'Waiting' END END AS state, {_DETAILS},
 {STATES}[state_no + 1] AS health_state, reason_text AS health_reason"""
_RESTART = "ready, started, CASE WHEN has_status THEN q % 6 ELSE 0 END AS restart_count"
_norm("norm_container", "pod", f"SELECT {_CONTAINER}, {_RESTART} FROM k_placed_container WHERE sort = 'main'", "container")
_norm("norm_sidecar", "pod", f"SELECT {_CONTAINER}, {_RESTART} FROM k_placed_container WHERE sort = 'sidecar'", "sidecar_container")
_norm("norm_init_container", "pod", f"SELECT {_CONTAINER} FROM k_placed_container WHERE sort = 'init'", "init_container")

_CM = "uuid, cluster_uuid, 'cust-' || ckey AS uid, namespace, name, '1' AS resource_version, ckey * 60000 AS created"
_W = "namespace || '/' || name"


def _workload(kind: str, columns: str, state: str, reason: str, number: int):
    from checks.registry import ORACLES
    base = ORACLES[f"health_{kind}"]
    _norm(f"norm_{kind}", kind, f"""
SELECT {_CM.replace('uuid, cluster_uuid', 'c.uuid, c.cluster_uuid', 1)}, {columns}, h.health_state, h.health_reason
FROM k_customer c JOIN ({base}) h ON c.uuid = h.uuid WHERE ckey % 4 = {number}""")


_workload("deployment", "'RollingUpdate' AS strategy, ckey % 4 AS min_ready_seconds, CAST(600 AS BIGINT) AS progress_deadline_seconds, ckey % 8 = 0 AS paused, "
          "desired AS desired_replicas, desired AS actual_replicas, available AS updated_replicas, available AS ready_replicas, "
          "available AS available_replicas, unavailable AS unavailable_replicas", "", "", 0)
_workload("replica_set", "desired AS desired_replicas, ckey % 4 AS min_ready_seconds, desired AS actual_replicas, available AS fully_labeled_replicas, "
          "available AS ready_replicas, available AS available_replicas", "", "", 1)
_workload("daemon_set", "'RollingUpdate' AS update_strategy, ckey % 4 AS min_ready_seconds, desired AS desired_number_scheduled, desired AS current_number_scheduled, "
          "CAST(0 AS BIGINT) AS number_misscheduled, available AS number_ready, available AS update_number_scheduled, available AS number_available, "
          "unavailable AS number_unavailable", "", "", 2)
_workload("stateful_set", "desired AS desired_replicas, 'svc-' || ckey AS service_name, 'OrderedReady' AS pod_management_policy, 'RollingUpdate' AS update_strategy, "
          "ckey % 4 AS min_ready_seconds, CASE WHEN ckey % 5 = 0 THEN 'Delete' ELSE 'Retain' END AS persistent_volume_claim_retention_policy_when_deleted, "
          "'Retain' AS persistent_volume_claim_retention_policy_when_scaled, CAST(0 AS BIGINT) AS ordinals, desired AS actual_replicas, available AS ready_replicas, "
          "desired AS current_replicas, available AS updated_replicas, available AS available_replicas", "", "", 3)


def _from_health(kind: str, sql: str):
    from checks.registry import ORACLES
    _norm(f"norm_{kind}", kind, sql.replace("HEALTH", f"({ORACLES[f'health_{kind}']})"))


_from_health("job", f"""
SELECT {_meta("'job-' || o_orderkey", "c.cluster_uuid", "c.namespace", "'job-' || o_orderkey", ms('o_orderdate'))}, o_orderkey % 4 AS parallelism,
 CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 5 END AS completions, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 1000 END AS active_deadline_seconds,
 CASE WHEN o_orderkey % 6 <> 0 THEN CAST(6 AS BIGINT) END AS backoff_limit, CASE WHEN o_orderkey % 8 = 0 THEN CAST(100 AS BIGINT) END AS ttl_seconds_after_finished,
 'NonIndexed' AS completion_mode, o_orderkey % 9 = 0 AS suspend, {ms('o_orderdate')} AS start_time,
 CASE WHEN o_orderkey % 7 = 1 THEN {ms('o_orderdate')} + 3600000 END AS completion_time, o_orderkey % 2 AS active, o_orderkey % 3 AS succeeded, o_orderkey % 4 AS failed,
 h.health_state, h.health_reason FROM orders JOIN k_customer c ON o_custkey = c.ckey JOIN HEALTH h ON h.uuid = {eu("'job-' || o_orderkey")}""")

_from_health("cron_job", f"""
SELECT {_meta("'cron-' || o_orderkey", "c.cluster_uuid", "c.namespace", "'cron-' || o_orderkey", ms('o_orderdate'))}, '0 * * * *' AS schedule,
 CASE WHEN o_orderkey % 2 = 0 THEN 'UTC' END AS timezone, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 5 + 1) * 86400 * 400 END AS starting_deadline_seconds,
 'Forbid' AS concurrency_policy, o_orderkey % 6 = 0 AS suspend, CAST(3 AS BIGINT) AS successful_jobs_history_limit, CAST(1 AS BIGINT) AS failed_jobs_history_limit,
 o_orderkey % 3 + 1 AS active, CASE WHEN o_orderkey % 13 <> 0 THEN {ms('o_orderdate')} END AS last_schedule_time,
 CASE WHEN o_orderkey % 7 <> 0 THEN {ms('o_orderdate')} + CASE WHEN o_orderkey % 5 = 0 THEN -3600000 ELSE 3600000 END END AS last_successful_time,
 h.health_state, h.health_reason FROM orders JOIN k_customer c ON o_custkey = c.ckey JOIN HEALTH h ON h.uuid = {eu("'cron-' || o_orderkey")}""")

_norm("norm_service", "service", """
SELECT uuid, cluster_uuid, uid, namespace, 'svc-' || segment AS name, '1' AS resource_version, CAST(nation_key AS BIGINT) * 60000 AS created,
 '10.2.0.' || nation_key AS cluster_ip, '10.2.0.' || nation_key || ', fd00::' || nation_key AS cluster_ips, 'ClusterIP' AS type, CAST(NULL AS VARCHAR) AS external_ips,
 'None' AS session_affinity, CAST(NULL AS VARCHAR) AS external_name, CAST(NULL AS VARCHAR) AS external_traffic_policy,
 CASE WHEN nation_key % 3 <> 0 THEN CAST(nation_key % 3 AS BIGINT) END AS health_check_node_port, FALSE AS publish_not_ready_addresses,
 CASE nation_key % 4 WHEN 0 THEN 'DualStack' WHEN 1 THEN 'IPv4' WHEN 2 THEN 'IPv6' END AS ip_families, CASE WHEN nation_key % 5 = 0 THEN 'SingleStack' END AS ip_family_policy,
 nation_key % 3 <> 0 AS allocate_load_balancer_node_ports, CAST(NULL AS VARCHAR) AS load_balancer_class,
 CASE WHEN nation_key % 3 = 1 THEN 'Local' ELSE 'Cluster' END AS internal_traffic_policy FROM k_service""")

_SLICE = eu("'slice-' || p_partkey")
_ENDPOINTS = f"""
SELECT {u5(_SLICE, "'p' || pt || '10.3.' || ep || '.' || ad || (9000 + pt)")} AS uuid, {_SLICE} AS endpoint_slice_uuid,
 CASE WHEN p_partkey % 2 = 0 THEN 'h-' || p_partkey ELSE '' END AS host_name, 'node-' || (p_partkey % 10) AS node_name, p_partkey % 3 <> 0 AS ready,
 CASE WHEN p_partkey % 4 = 0 THEN TRUE END AS serving, CAST(NULL AS BOOLEAN) AS terminating, '10.3.' || ep || '.' || ad AS address, 'TCP' AS protocol,
 9000 + pt AS port, 'p' || pt AS port_name, '' AS app_protocol
FROM part, LATERAL (SELECT unnest(generate_series(1, p_partkey % 3)) AS ep) e, LATERAL (SELECT unnest(generate_series(1, p_size % 2 + 1)) AS ad) a,
 LATERAL (SELECT unnest(generate_series(1, p_partkey % 2 + 1)) AS pt) p WHERE p_partkey % 4 > 0"""
_norm("norm_endpoints", "endpoint_slice", _ENDPOINTS, "endpoint")
check("endpoint_cross", f"SELECT endpoint_slice_uuid, COUNT(*) AS rows, COUNT(DISTINCT address) AS addresses FROM ({_ENDPOINTS}) GROUP BY 1")(
    lambda spark, sf: tables(spark, sf, "endpoint_slice")["endpoint"].groupBy("endpoint_slice_uuid").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("address").alias("addresses")))
_norm("latest_target_ref", "endpoint_slice", f"""
SELECT {_SLICE} AS endpoint_slice_uuid, CASE WHEN p_partkey % 5 <> 0 THEN 'Pod' END AS kind, CASE WHEN p_partkey % 5 <> 0 THEN 'NATION_0' ELSE '' END AS namespace,
 CASE WHEN p_partkey % 5 <> 0 THEN 'pod-' || (p_partkey % 3) ELSE '' END AS name, CASE WHEN p_partkey % 5 <> 0 THEN 'order-' || (p_partkey % 3) ELSE '' END AS uid,
 '' AS api_version, '' AS resource_version FROM part WHERE p_partkey % 3 > 0""", "endpoint_target_ref")

_ING = eu("'ing-' || p_partkey")
_HOST = "'h' || (p_partkey % 6) || '.example'"
_RS = u5(_ING, f"{_HOST} || '/a' || 'svc-' || (p_partkey % 9)")
_RR = u5(_ING, f"{_HOST} || 'bucket-' || (p_partkey % 7)")


@check("norm_ingress", f"""
WITH b AS (SELECT p_partkey, {_ING} AS ing, {_RS} AS rs, {_RR} AS rr, {_HOST} AS host, 'svc-' || (p_partkey % 9) AS svc, 'bucket-' || (p_partkey % 7) AS bucket FROM part)
SELECT 'tls' AS tbl, ing AS ingress_uuid, CAST(NULL AS VARCHAR) AS rule_uuid, 'a' || p_partkey || '.example' AS a, 'tls' AS b FROM b
UNION ALL SELECT 'tls', ing, NULL, 'b' || p_partkey || '.example', 'tls' FROM b
UNION ALL SELECT 'rule', ing, rs, host, '/a' FROM b UNION ALL SELECT 'rule', ing, rr, host, NULL FROM b
UNION ALL SELECT 'service', ing, rs, {u5('rs', 'svc')}, svc || ':web:80' FROM b
UNION ALL SELECT 'service', ing, NULL, {u5('ing', "svc || 'web'")}, svc || ':web:80' FROM b WHERE p_partkey % 3 = 0
UNION ALL SELECT 'resource', ing, rr, {u5('rr', 'bucket')}, bucket || ':' || CASE WHEN p_partkey % 2 = 0 THEN 'storage.k8s.io' ELSE '' END FROM b
UNION ALL SELECT 'resource', ing, NULL, {u5('ing', "'Bucket' || bucket")}, bucket || ':storage.k8s.io' FROM b WHERE p_partkey % 3 = 1 AND p_partkey % 2 = 0""")
def norm_ingress(spark, sf):
    t = tables(spark, sf, "ingress")
    none = F.lit(None).cast("string")
    return (
        t["ingress_tls"].select(F.lit("tls").alias("tbl"), "ingress_uuid", none.alias("rule_uuid"), F.col("tls_host").alias("a"), F.col("tls_secret").alias("b"))
        .unionByName(t["ingress_rule"].select(F.lit("rule").alias("tbl"), "ingress_uuid", F.col("uuid").alias("rule_uuid"), F.col("host").alias("a"), F.col("path").alias("b")))
        .unionByName(t["ingress_backend_service"].select(
            F.lit("service").alias("tbl"), "ingress_uuid", F.col("ingress_rule_uuid").alias("rule_uuid"), F.col("service_uuid").alias("a"),
            F.concat_ws(":", "service_name", "service_port_name", F.col("service_port_number").cast("string")).alias("b")))
        .unionByName(t["ingress_backend_resource"].select(
            F.lit("resource").alias("tbl"), "ingress_uuid", F.col("ingress_rule_uuid").alias("rule_uuid"), F.col("resource_uuid").alias("a"),
            F.concat("name", F.lit(":"), F.coalesce("api_group", F.lit(""))).alias("b"))))


_norm("norm_config_map", "config_map", f"""
SELECT {_meta("'cm-' || p_partkey", eu("'region-' || (p_partkey % 5)"), "'NATION_0'", "p_name", "p_partkey * 1000")}, p_partkey % 4 = 0 AS immutable FROM part""")
_norm("norm_secret", "secret", f"""
SELECT {_meta("'sec-' || p_partkey", eu("'region-' || (p_partkey % 5)"), "'NATION_0'", "p_name", "p_partkey * 1000")}, 'Opaque' AS type, p_partkey % 4 = 0 AS immutable FROM part""")

_E = f"""
SELECT event_id, ts, {ms('ts')} AS created, CASE event_id % 3 WHEN 1 THEN {ms('ts')} - 3600000 ELSE {ms('ts')} END AS first_seen,
 CASE WHEN event_id % 10 = 0 THEN {ms('ts')} + 7200000 WHEN event_id % 4 = 0 THEN {ms('ts')} + 3600000
  ELSE CASE event_id % 3 WHEN 1 THEN {ms('ts')} - 3600000 ELSE {ms('ts')} END END AS last_seen,
 greatest(CASE WHEN event_id % 5 = 0 THEN event_id % 17 ELSE 0 END, event_id % 3, 1) AS count, event_type, props FROM events"""
_norm("norm_event", "event", f"""
SELECT {_meta("'ev-' || event_id", eu("'region-' || (event_id % 5)"), "'NATION_0'", "'ev-' || event_id", "created")}, {eu("'order-' || event_id")} AS reference_uuid,
 'kubelet' AS reporting_controller, CAST(NULL AS VARCHAR) AS reporting_instance, CAST(NULL AS VARCHAR) AS action, event_type AS reason, props AS note,
 CASE WHEN event_type = 'error' THEN 'Warning' ELSE 'Normal' END AS type, 'Pod' AS reference_kind, CAST(NULL AS VARCHAR) AS reference_namespace,
 'pod-' || event_id AS reference_name, first_seen, last_seen, count FROM ({_E})""")
check("event_times", f"SELECT 'ev-' || event_id AS uid, first_seen, last_seen, count FROM ({_E})")(
    lambda spark, sf: flat(tables(spark, sf, "event")["event"].select("uid", "first_seen", "last_seen", "count")))

_norm("norm_pvc", "pvc", f"""
SELECT {_meta("'pvc-' || ckey", "cluster_uuid", "namespace", "'claim-' || ckey", "ckey * 1000")}, NULLIF(ckey % 16, 0) AS desired_access_modes,
 CAST(1 AS BIGINT) AS actual_access_modes, (ckey % 50 + 1) * 1073741824000 AS minimum_capacity_milli, CASE WHEN ckey % 3 <> 0 THEN (ckey % 50 + 1) * 1073741824000 END AS actual_capacity_milli,
 'Bound' AS phase, CASE WHEN ckey % 4 <> 0 THEN 'pv-' || ckey END AS volume_name, CASE WHEN ckey % 5 = 0 THEN 'Block' ELSE 'Filesystem' END AS volume_mode,
 'fast' AS storage_class FROM k_customer""")
check("access_modes", "SELECT ckey % 16 AS low_bits, NULLIF(ckey % 16, 0) AS mask, COUNT(*) AS claims FROM k_customer GROUP BY ALL")(
    lambda spark, sf: tables(spark, sf, "pvc")["pvc"].groupBy(
        (F.replace("uid", F.lit("pvc-"), F.lit("")).cast("bigint") % 16).alias("low_bits"), F.col("desired_access_modes").cast("bigint").alias("mask"))
    .agg(F.count(F.lit(1)).alias("claims")))


@check("norm_pv", f"""
SELECT {_meta("'pv-' || ckey", "cluster_uuid", "''", "'pv-' || ckey", "ckey * 1000")}, NULLIF(ckey % 16, 0) AS access_modes, (ckey % 50 + 1) * 1000000000000 AS capacity_milli,
 'Delete' AS reclaim_policy, CAST(NULL AS VARCHAR) AS storage_class, CASE WHEN ckey % 5 = 0 THEN 'Block' ELSE 'Filesystem' END AS volume_mode,
 CASE WHEN ckey % 2 = 0 THEN 'csi' ELSE '' END AS volume_source_type, CASE WHEN ckey % 2 = 0 THEN '{{"volumeHandle":"' || ckey || '"}}' ELSE '' END AS volume_source, 'Bound' AS phase,
 CAST(NULL AS VARCHAR) AS reason, 'ok' AS message, CASE WHEN ckey % 4 <> 0 THEN 'PersistentVolumeClaim:claim-' || ckey || ':pvc-' || ckey END AS claim FROM k_customer""")
def norm_pv(spark, sf):
    t = tables(spark, sf, "persistent_volume")
    claim = t["persistent_volume_claim_ref"].select(
        F.col("persistent_volume_uuid").alias("uuid"), F.concat_ws(":", "kind", "name", "uid").alias("claim"))
    return flat(t["persistent_volume"].join(claim, "uuid", "left"))


# --- children ---------------------------------------------------------------------------------------------------

_norm("owners", "pod", f"""SELECT uuid AS pod_uuid, {eu("'cust-' || owner_key")} AS owner_uuid, 'replica_set' AS kind, 'rs-' || owner_key AS name, 'cust-' || owner_key AS uid,
 TRUE AS controller, FALSE AS block_owner_deletion FROM k_pod""", "pod_owner", bare_tables)


def _entries(spark, sf, noun):
    t = bare_tables(spark, sf)
    links = t[f"resource_{noun}"].join(t[f"pod_{noun}"], [
        t[f"resource_{noun}"][f"{noun}_uuid"] == t[f"pod_{noun}"][f"{noun}_uuid"]]).select("resource_uuid", t[f"pod_{noun}"][f"{noun}_uuid"].alias("uuid"))
    return links.join(t[noun], "uuid")


check("labels", "SELECT resource_uuid, label_uuid AS uuid, name, value FROM k_pod_label")(lambda spark, sf: _entries(spark, sf, "label"))
check("annotations", f"""SELECT uuid AS resource_uuid, {u5('uuid', "lower('note:' || segment || ':' || priority)")} AS uuid, 'note' AS name,
 segment || ':' || priority AS value FROM k_pod""")(lambda spark, sf: _entries(spark, sf, "annotation"))


@check("selectors", f"""
WITH x AS (SELECT uuid AS service_uuid, 'segment' AS name, segment AS value FROM k_service UNION ALL SELECT uuid, 'nation', namespace FROM k_service WHERE nation_key % 2 = 0)
SELECT service_uuid, {u5('service_uuid', "lower(name || ':' || value)")} AS uuid, name, value FROM x""")
def selectors(spark, sf):
    t = tables(spark, sf, "service")
    return t["selector"].join(t["service_selector"].withColumnRenamed("selector_uuid", "uuid"), "uuid")


@check("conditions", f"""
SELECT 'node' AS kind, uuid, type, lower(status) AS status, nkey * 60000 AS last_transition, '' AS reason FROM k_node_condition
UNION ALL SELECT 'pod', uuid, t.type, CASE WHEN t.type = 'DisruptionTarget' THEN 'true' WHEN pkey % t.m = 0 THEN 'false' ELSE 'true' END, {ms('created')}, t.reason
 FROM k_pod, (VALUES ('PodScheduled', 29, 'Unschedulable'), ('PodReadyToStartContainers', 31, ''), ('Initialized', 17, ''), ('Ready', 5, ''), ('DisruptionTarget', 41, 'Preempted')) t(type, m, reason)
 WHERE t.type <> 'DisruptionTarget' OR pkey % 41 = 0
UNION ALL SELECT 'deployment', uuid, t.type, CASE WHEN t.type = 'Available' THEN CASE WHEN ckey % 3 = 0 THEN 'false' ELSE 'true' END ELSE CASE WHEN ckey % 7 = 0 THEN 'true' ELSE 'false' END END,
 ckey * 60000, t.reason FROM k_customer, (VALUES ('Available', 'MinimumReplicas'), ('ReplicaFailure', 'Quota')) t(type, reason) WHERE ckey % 4 = 0
UNION ALL SELECT 'pvc', {eu("'pvc-' || ckey")}, 'file_system_resize_pending', CASE WHEN ckey % 2 = 0 THEN 'false' ELSE 'true' END, ckey * 1000, 'r' FROM k_customer
UNION ALL SELECT 'service', uuid, 'LoadBalancerReady', CASE WHEN nation_key % 2 = 0 THEN 'false' ELSE 'true' END, CAST(nation_key AS BIGINT) * 60000, 'r' FROM k_service""")
def conditions(spark, sf):
    merged = None
    for kind in ("node", "pod", "deployment", "pvc", "service"):
        part = bare_tables(spark, sf, kind)[f"{kind}_condition"].select(
            F.lit(kind).alias("kind"), F.col(f"{kind}_uuid").alias("uuid"), "type", "status", "last_transition", "reason")
        merged = part if merged is None else merged.unionByName(part)
    return flat(merged)


@check("pod_volumes", """
SELECT uuid AS pod_uuid, 'data' AS volume_name, 'claim-' || owner_key AS claim_name, pkey % 2 = 0 AS read_only, CAST(NULL AS VARCHAR) AS type, CAST(NULL AS VARCHAR) AS source FROM k_pod WHERE pkey % 3 = 0
UNION ALL SELECT uuid, 'cfg', NULL, NULL, 'configMap', '{"name":"cm"}' FROM k_pod""")
def pod_volumes(spark, sf):
    t = bare_tables(spark, sf)
    return t["pod_pvc"].unionByName(t["pod_volume"], allowMissingColumns=True)


@check("mounts", """
SELECT uuid AS container_uuid, pod_uuid, 'mount' AS what, 'vol-' || pos AS name, '/data/' || pos AS path, CASE WHEN q % 4 <> 0 THEN 'sub' END AS sub_path, q % 2 = 0 AS read_only FROM k_placed_container
UNION ALL SELECT uuid, pod_uuid, 'device', 'dev-' || pos, '/dev/x' || pos, NULL, NULL FROM k_placed_container WHERE q % 9 = 0""")
def mounts(spark, sf):
    t = tables(spark, sf, "pod")
    return t["container_mount"].select("container_uuid", "pod_uuid", F.lit("mount").alias("what"), F.col("volume_name").alias("name"), "path", "sub_path", "read_only").unionByName(
        t["container_device"].select("container_uuid", "pod_uuid", F.lit("device").alias("what"), "name", "path"), allowMissingColumns=True)


_norm("node_volumes", "node", """SELECT uuid AS node_uuid, 'v-' || i AS name, '/dev/' || i AS device_path, nkey % 2 = i AS mounted FROM k_node, (VALUES (0), (1)) t(i)""", "node_volume")

check("resource_labels", f"""
SELECT 'pod' AS kind, resource_uuid, label_uuid FROM k_pod_label
UNION ALL SELECT 'service', uuid, {u5('uuid', "lower('segment:' || segment)")} FROM k_service
UNION ALL SELECT 'namespace', {eu("'nation-' || n_nationkey")}, {u5(eu("'nation-' || n_nationkey"), "'team:t' || (n_nationkey % 3)")} FROM nation""")(
    lambda spark, sf: __import__("fleetlens.operators.merge", fromlist=["fan_in"]).fan_in(
        {k: bare_tables(spark, sf, k)["resource_label"] for k in ("pod", "service", "namespace")}))


@check("pod_usage", """
SELECT namespace, name AS pod_name, 'c-3' AS container_name, ts_ms AS timestamp, v AS memory_usage FROM (
 SELECT p.namespace, p.name, (e.event_id % 200 + 1700000000) * 1000 AS ts_ms, CAST(CAST(ROUND(e.value * 100) AS BIGINT) * 1024 AS DOUBLE) AS v
 FROM events e JOIN k_pod p ON e.event_id = p.pkey WHERE e.event_type = 'error') u""")
def pod_usage(spark, sf):
    """Usage records keyed by namespace, pod, container and instant."""
    s = I.samples(spark, sf, "container_memory_usage_bytes")
    rows = s.select(F.col("labels.namespace").alias("namespace"), F.col("labels.pod").alias("pod_name"), F.col("labels.container").alias("container_name"),
                    F.col("ts").alias("timestamp"), F.col("value").alias("memory_usage"))
    return flat(dedup_last(rows, ["namespace", "pod_name", "container_name", "timestamp"], ["memory_usage"]))


check("favorites", f"""SELECT {eu("'cust-' || c_custkey")} AS resource_uuid, CASE WHEN c_custkey % 2 = 0 THEN 'pod' ELSE 'node' END AS kind,
 'user' || (c_custkey % 20) AS username, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 13 END AS priority FROM customer""")(
    lambda spark, sf: flat(rollup.favorites_of(I.favorites(spark, sf))))
