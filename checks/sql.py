"""The same facts as flat SQL views (DuckDB), written independently of the library: the expected side of each check."""

from __future__ import annotations

import re


def u5(space: str, text: str) -> str:
    """SQL for a name-based SHA-1 UUID."""
    d = f"sha1(unhex(replace({space}, '-', '')) || encode({text}))"
    return (f"(substr({d},1,8) || '-' || substr({d},9,4) || '-5' || substr({d},14,3) || '-' || "
            f"substr('89ab', ((strpos('0123456789abcdef', substr({d},17,1)) - 1) % 4) + 1, 1) || substr({d},18,3) || '-' || substr({d},21,12))")


def eu(text: str) -> str:
    """SQL for the uuid of an object whose uid is no UUID."""
    return u5("'3f249403-2bb0-428f-8e91-504d1fd7ddb6'", text)


def day(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S +0000 UTC')"


def rfc(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"


def ms(ts: str) -> str:
    return f"(epoch_us({ts}) // 1000)"


AS_OF = "TIMESTAMP '2000-06-01 00:00:00'"
STATES = "['ok', 'pending', 'unknown', 'warning', 'critical']"

VIEWS: dict[str, str] = {}

VIEWS["k_node"] = f"""
SELECT s_suppkey AS nkey, 'supp-' || s_suppkey AS uid, {eu("'supp-' || s_suppkey")} AS uuid,
       'region-' || n_regionkey AS cluster_uid, {eu("'region-' || n_regionkey")} AS cluster_uuid, 'node-' || s_suppkey AS name
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

VIEWS["k_node_condition"] = """
SELECT k.*, t.pos, t.type, CASE WHEN t.type = 'Ready' THEN CASE k.nkey % 5 WHEN 3 THEN 'False' WHEN 4 THEN 'Unknown' ELSE 'True' END
            WHEN (k.nkey + t.pos) % 9 = 0 THEN 'True' ELSE 'False' END AS status
FROM k_node k CROSS JOIN (VALUES (1,'DiskPressure'),(2,'Ready'),(3,'MemoryPressure'),(4,'PIDPressure'),(5,'NetworkUnavailable')) t(pos, type)"""

VIEWS["k_customer"] = f"""
SELECT c_custkey AS ckey, 'region-' || n_regionkey AS cluster_uid, {eu("'region-' || n_regionkey")} AS cluster_uuid,
       n_name AS namespace, n_nationkey AS nation_key, c_name AS name, c_mktsegment AS segment, c_custkey % 6 AS desired,
       LEAST(c_custkey % 6, c_custkey % 5) AS available, CASE WHEN c_custkey % 10 = 0 THEN c_custkey % 3 ELSE 0 END AS unavailable,
       {eu("'cust-' || c_custkey")} AS uuid
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

VIEWS["k_pod"] = f"""
SELECT o.o_orderkey AS pkey, 'order-' || o.o_orderkey AS uid, {eu("'order-' || o.o_orderkey")} AS uuid, k.cluster_uid, k.cluster_uuid,
       n.n_name AS namespace, 'pod-' || o.o_orderkey AS name, k.name AS node_name, k.nkey, o.o_custkey AS owner_key,
       CASE WHEN o.o_orderkey % 11 = 0 THEN 'Failed' WHEN o.o_orderstatus = 'F' THEN 'Succeeded'
            WHEN o.o_orderstatus = 'P' THEN 'Pending' ELSE 'Running' END AS phase,
       CASE WHEN o.o_orderkey % 97 = 0 THEN 'NodeLost' WHEN o.o_orderkey % 33 = 0 THEN 'Evicted' END AS reason,
       CASE WHEN o.o_orderkey % 33 = 0 THEN ' node was low on memory. ' END AS message,
       CASE o.o_orderkey % 3 WHEN 0 THEN 'Guaranteed' WHEN 1 THEN 'Burstable' ELSE 'BestEffort' END AS qos,
       c.c_mktsegment AS segment, o.o_orderpriority AS priority, o.o_orderdate AS created
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN k_node k ON k.nkey = o.o_orderkey % (SELECT COUNT(*) FROM supplier)"""

VIEWS["k_container_last"] = """
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC,
  l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn FROM lineitem) WHERE rn = 1"""

VIEWS["k_container_fact"] = f"""
SELECT l_orderkey AS pkey, {eu("'order-' || l_orderkey")} AS pod_uuid, 'c-' || l_linenumber AS name, CAST(l_linenumber AS BIGINT) AS pos,
       CASE l_linenumber WHEN 1 THEN 'init' WHEN 2 THEN 'sidecar' ELSE 'main' END AS sort, CAST(l_quantity AS BIGINT) AS q,
       'img/' || (l_partkey % 50) || ':1' AS image, l_shipdate AS shipped, CAST(l_quantity AS BIGINT) % 13 <> 0 AS has_status,
       l_returnflag AS flag, COALESCE(l_linestatus = 'F' AND CAST(l_quantity AS BIGINT) % 13 <> 0, FALSE) AS ready,
       CAST(l_quantity AS BIGINT) % 4 <> 0 AND CAST(l_quantity AS BIGINT) % 13 <> 0 AS started,
       l_suppkey % 2 = 0 AND l_suppkey % 4 = 0 AS readiness, l_partkey % 3 = 0 AND l_suppkey % 4 = 0 AS startup,
       l_suppkey % 4 = 0 AS ended_before, CASE WHEN l_partkey % 2 = 0 THEN 'ImagePullBackOff' ELSE 'Error' END AS last_reason,
       CASE CAST(l_quantity AS BIGINT) % 5 WHEN 0 THEN 'PodInitializing' WHEN 1 THEN 'ContainerCreating' WHEN 2 THEN 'ErrImagePull'
            WHEN 3 THEN 'CrashLoopBackOff' ELSE '' END AS waiting_reason,
       CASE WHEN CAST(l_quantity AS BIGINT) % 7 <> 0 THEN CAST(l_quantity AS BIGINT) * 20 END AS cpu_limits,
       CASE WHEN CAST(l_quantity AS BIGINT) % 10 <> 0 THEN CAST(l_quantity AS BIGINT) * 10 END AS cpu_requests,
       CASE WHEN CAST(l_quantity AS BIGINT) % 8 <> 0 THEN CAST(l_quantity AS BIGINT) * 2097152000 END AS memory_limits_milli,
       CASE WHEN CAST(l_quantity AS BIGINT) % 6 <> 0 THEN CAST(l_quantity AS BIGINT) * 1048576000 END AS memory_requests_milli
FROM k_container_last"""

_PROBE = ("'Container ' || name || ' is critical as it''s not ready due to failing {} probes. Last terminal with non-zero exit code 1 and signal 9 was at ' || "
          + day("shipped") + " || '. ' || last_reason || ': gone.'")

VIEWS["k_container"] = f"""
SELECT f.*, {u5("pod_uuid", "name")} AS uuid,
  CASE WHEN NOT has_status THEN 2
       WHEN flag = 'A' THEN CASE WHEN NOT ready AND readiness THEN 4 WHEN q % 3 = 0 THEN 0 ELSE 4 END
       WHEN flag = 'N' THEN CASE WHEN NOT started AND startup THEN 4 WHEN NOT started THEN 1 WHEN NOT ready AND readiness THEN 4 WHEN NOT ready THEN 1 ELSE 0 END
       ELSE CASE WHEN waiting_reason IN ('', 'PodInitializing', 'ContainerCreating') THEN 1
                 WHEN waiting_reason = 'ErrImagePull' AND ended_before AND last_reason = 'ImagePullBackOff' THEN 4
                 WHEN waiting_reason = 'ErrImagePull' THEN 3 ELSE 4 END END AS state_no,
  CASE WHEN NOT has_status THEN 'Container ' || name || ' is unknown as its state could not be obtained: No state provided.'
       WHEN flag = 'A' THEN CASE WHEN NOT ready AND readiness THEN {_PROBE.format('readiness')}
            WHEN q % 3 = 0 THEN 'Container ' || name || ' terminated successfully at ' || {day("shipped")} || '.'
            WHEN q % 2 <> 0 THEN 'Container ' || name || ' terminated with signal ' || (q % 2) || ' at ' || {day("shipped")} || '. Error: out of memory.'
            ELSE 'Container ' || name || ' terminated with non-zero exit code ' || (q % 3) || ' at ' || {day("shipped")} || '. Error: out of memory.' END
       WHEN flag = 'N' THEN CASE WHEN NOT started AND startup THEN {_PROBE.format('startup')}
            WHEN NOT started THEN 'Container ' || name || ' is pending.' WHEN NOT ready AND readiness THEN {_PROBE.format('readiness')}
            WHEN NOT ready THEN 'Container ' || name || ' is pending.' ELSE 'Container ' || name || ' is running since ' || {day("shipped")} || '.' END
       ELSE CASE WHEN waiting_reason = '' THEN 'Container ' || name || ' is pending as it''s waiting to be started.'
            WHEN waiting_reason = 'PodInitializing' THEN 'Container ' || name || ' is pending as the Pod it''s running on is initializing.'
            WHEN waiting_reason = 'ContainerCreating' THEN 'Container ' || name || ' is pending as it''s still being created.'
            WHEN waiting_reason = 'ErrImagePull' AND ended_before AND last_reason = 'ImagePullBackOff' THEN 'Container ' || name || ' cannot start. ImagePullBackOff: gone.'
            WHEN waiting_reason = 'ErrImagePull' THEN 'Container ' || name || ' is waiting to start as its image cannot be pulled: back-off. .'
            ELSE 'Container ' || name || ' cannot start. CrashLoopBackOff: back-off.' END END AS reason_text
FROM k_container_fact f"""

VIEWS["k_placed_container"] = "SELECT c.* FROM k_container c SEMI JOIN k_pod p ON c.pkey = p.pkey"

VIEWS["k_rollup"] = f"""
SELECT pod_uuid, MAX(state_no) AS state_no, COUNT(*) FILTER (state_no <> 0) AS not_ok, COUNT(*) FILTER (sort <> 'init') AS total,
       string_agg('[' || upper({STATES}[state_no + 1]) || '] ' || reason_text, chr(10) ORDER BY pos) AS reasons
FROM k_placed_container GROUP BY pod_uuid"""

_WHO = "'Pod ' || p.namespace || '/' || p.name || "
_COUNTS = "(COALESCE(r.total, 0) - COALESCE(r.not_ok, 0)) || ' out of ' || COALESCE(r.total, 0) || ' containers running.'"
VIEWS["k_pod_health"] = f"""
SELECT p.*, CASE WHEN p.pkey % 97 = 0 THEN 2
    WHEN p.pkey % 37 = 0 AND (p.pkey % 2 = 0 OR {AS_OF} > p.created + INTERVAL 1 DAY + INTERVAL 30 SECOND) THEN 0
    WHEN p.phase = 'Failed' AND p.reason = 'Evicted' THEN 4 WHEN p.pkey % 41 = 0 THEN 4 WHEN p.phase = 'Succeeded' THEN 0
    WHEN p.pkey % 29 = 0 THEN 4 WHEN p.phase = 'Failed' THEN COALESCE(r.state_no, 0) WHEN p.pkey % 31 = 0 THEN 4
    ELSE COALESCE(r.state_no, 0) END AS state_no,
  CASE WHEN p.pkey % 97 = 0 THEN {_WHO} ' is unknown as the node which was running the pod is unresponsive.'
    WHEN p.pkey % 37 = 0 AND (p.pkey % 2 = 0 OR {AS_OF} > p.created + INTERVAL 1 DAY + INTERVAL 30 SECOND)
      THEN {_WHO} ' is being deleted at ' || {day("(p.created + INTERVAL 1 DAY)")} || '.'
    WHEN p.phase = 'Failed' AND p.reason = 'Evicted' THEN {_WHO} ' is terminal: Evicted: node was low on memory.'
    WHEN p.pkey % 41 = 0 THEN {_WHO} ' is terminal: Preempted: by scheduler.'
    WHEN p.phase = 'Succeeded' THEN {_WHO} ' is succeeded as all its containers have been terminated successfully and will not be restarted.'
    WHEN p.pkey % 29 = 0 THEN {_WHO} ' cannot be scheduled: Unschedulable: 0/3 nodes.'
    WHEN p.phase = 'Failed' THEN {_WHO} ' has failed as all its containers have been terminated and will not be restarted.' || chr(10) || COALESCE(r.reasons, '')
    WHEN p.pkey % 31 = 0 THEN {_WHO} ' is not ready to start containers.'
    WHEN p.pkey % 17 = 0 OR p.pkey % 5 = 0 THEN {_WHO} ' is ' || {STATES}[COALESCE(r.state_no, 0) + 1] || '.' || chr(10) || COALESCE(r.reasons, '')
    ELSE {_WHO} ' is ' || {STATES}[COALESCE(r.state_no, 0) + 1] || ' with ' || {_COUNTS} || chr(10) || COALESCE(r.reasons, '') END AS health_reason
FROM k_pod p LEFT JOIN k_rollup r ON p.uuid = r.pod_uuid"""

_RES = ["cpu_limits", "cpu_requests", "memory_limits_milli", "memory_requests_milli"]
VIEWS["k_pod_resources"] = "SELECT pod_uuid, " + ", ".join(
    f"CAST(greatest(SUM({c}) FILTER (sort = 'main'), MAX({c}) FILTER (sort <> 'main')) AS BIGINT) AS {c}" for c in _RES
) + " FROM k_placed_container GROUP BY pod_uuid"

VIEWS["k_pod_label"] = f"""
SELECT uuid AS resource_uuid, cluster_uuid, name, value, {u5("uuid", "lower(name || ':' || value)")} AS label_uuid FROM (
  SELECT uuid, cluster_uuid, 'segment' AS name, segment AS value FROM k_pod UNION ALL
  SELECT uuid, cluster_uuid, 'priority', priority FROM k_pod UNION ALL SELECT uuid, cluster_uuid, 'nation', namespace FROM k_pod)"""

VIEWS["k_service"] = f"""
SELECT DISTINCT nation_key, segment, cluster_uid, cluster_uuid, namespace, 'svc-' || nation_key || '-' || segment AS uid,
       {eu("'svc-' || nation_key || '-' || segment")} AS uuid FROM k_customer"""

VIEWS["k_service_pod"] = """
SELECT s.uuid AS service_uuid, p.uuid AS pod_uuid FROM k_service s JOIN k_pod p
  ON s.cluster_uuid = p.cluster_uuid AND s.segment = p.segment AND (s.nation_key % 2 <> 0 OR s.namespace = p.namespace)"""

VIEWS["k_change"] = f"""
SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'ADDED' WHEN 'error' THEN 'DELETED' ELSE 'UPDATED' END AS type,
       'obj-' || user_id AS uid, {eu("'obj-' || user_id")} AS uuid, 'NATION_0/obj-' || user_id AS key, ts, CAST(ROUND(value * 100) AS BIGINT) AS payload FROM events"""

VIEWS["k_incident"] = f"""
SELECT {eu("'order-' || (o_orderkey * 2)")} AS uuid, CASE WHEN o_orderkey % 2 = 0 THEN {eu("'region-1'")} ELSE '' END AS cluster_uuid,
       'pod' AS resource, 'pod-' || (o_orderkey * 2) AS name, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'NATION_0' END AS namespace
FROM orders"""

VIEWS["k_log"] = f"SELECT {eu("'conv-' || conv_id")} AS container_uuid, turn AS seq, conv_id * 1000 + turn AS at_s, text FROM conversations"

# --- metric samples: one row per sample with the labels as columns --------------------------------------------

VIEWS["k_counter"] = f"""
SELECT CASE e.event_type WHEN 'click' THEN 'node_cpu_seconds_total' WHEN 'view' THEN 'node_network_receive_bytes_total'
         WHEN 'purchase' THEN 'node_network_transmit_bytes_total' ELSE 'container_cpu_usage_seconds_total' END AS metric,
       CASE WHEN e.event_type IN ('click','view','purchase') THEN k.cluster_uuid ELSE p.cluster_uuid END AS cluster_uuid,
       k.name AS node, CASE WHEN e.event_type IN ('click','view','purchase') THEN '10.0.0.' || k.nkey || ':9100' ELSE k.name END AS instance,
       'cpu' || (user_id % 2) AS cpu, CASE user_id % 3 WHEN 0 THEN 'idle' WHEN 1 THEN 'user' ELSE 'system' END AS mode,
       CASE user_id % 3 WHEN 0 THEN 'veth1' ELSE 'eth' || (user_id % 2) END AS device, p.namespace, p.name AS pod, 'c-' || (user_id % 2) AS container,
       e.event_id * 20 AS ts_ms, CAST((e.event_id * 100 + CAST(ROUND(e.value * 100) AS BIGINT) % 100) % 20000 AS DOUBLE) AS value
FROM events e JOIN k_node k ON k.nkey = e.user_id % (SELECT COUNT(*) FROM supplier) JOIN k_pod p ON p.pkey = e.user_id WHERE e.event_type <> 'error'"""

_G = 1700000000
_GC = "CAST(NULL AS VARCHAR) AS"
VIEWS["k_gauge"] = f"""
SELECT 'kube_pod_status_phase' AS metric, cluster_uuid, {_GC} node, {_GC} instance, namespace, name AS pod, {_GC} container, {_GC} resource,
       {_GC} mountpoint, phase, {_GC} qos_class, (pkey % 240 + {_G} + d) * 1000 AS ts_ms, CAST(1 AS DOUBLE) AS value
FROM k_pod, (VALUES (0), (120)) t(d)
UNION ALL SELECT 'kube_pod_status_qos_class', cluster_uuid, NULL, NULL, namespace, name, NULL, NULL, NULL, NULL, qos, (pkey % 240 + {_G} + d) * 1000, 1
FROM k_pod, (VALUES (0), (120)) t(d)
UNION ALL SELECT m.metric, cluster_uuid, name, CASE WHEN m.exporter THEN '10.0.0.' || nkey || ':9100' END, NULL, NULL, NULL, NULL, m.mountpoint, NULL, NULL,
       (nkey % 200 + {_G} + d) * 1000, CASE m.metric WHEN 'kube_node_info' THEN 1 WHEN 'machine_cpu_cores' THEN nkey % 8 + 1
         WHEN 'machine_memory_bytes' THEN (nkey % 8 + 1) * 4294967296 WHEN 'node_memory_MemTotal_bytes' THEN (nkey % 8 + 1) * 4294967296
         WHEN 'node_memory_MemAvailable_bytes' THEN (nkey % 8 + 1) * 1073741824 + ((nkey % 200 + {_G} + d) % 7) * 1048576
         WHEN 'node_filesystem_size_bytes' THEN (nkey % 8 + 1) * 1000 ELSE (nkey % 8 + 1) * 250 + (nkey % 200 + {_G} + d) % 7 END
FROM k_node, (VALUES (0), (60)) t(d), (VALUES ('kube_node_info', FALSE, NULL), ('machine_cpu_cores', FALSE, NULL), ('machine_memory_bytes', FALSE, NULL),
  ('node_memory_MemTotal_bytes', TRUE, NULL), ('node_memory_MemAvailable_bytes', TRUE, NULL), ('node_filesystem_size_bytes', FALSE, '/'),
  ('node_filesystem_size_bytes', FALSE, '/var'), ('node_filesystem_avail_bytes', FALSE, '/'), ('node_filesystem_avail_bytes', FALSE, '/var')) m(metric, exporter, mountpoint)
UNION ALL SELECT 'kube_namespace_created', {eu("'region-' || n_regionkey")}, NULL, NULL, n_name, NULL, NULL, NULL, NULL, NULL, NULL, (CAST(n_nationkey AS BIGINT) + {_G}) * 1000, n_nationkey FROM nation
UNION ALL SELECT 'kube_pod_container_resource_' || x.part, p.cluster_uuid, p.node_name, NULL, p.namespace, p.name, c.name, x.resource, NULL, NULL, NULL,
       (p.pkey % 200 + {_G}) * 1000, x.v / 1000.0
FROM k_container_fact c JOIN k_pod p ON c.pkey = p.pkey, LATERAL (SELECT 'requests' AS part, 'cpu' AS resource, cpu_requests AS v UNION ALL
  SELECT 'requests', 'memory', memory_requests_milli UNION ALL SELECT 'limits', 'cpu', cpu_limits UNION ALL SELECT 'limits', 'memory', memory_limits_milli) x
WHERE x.v IS NOT NULL
UNION ALL SELECT 'container_memory_usage_bytes', p.cluster_uuid, NULL, p.node_name, p.namespace, p.name, 'c-3', NULL, NULL, NULL, NULL,
       (e.event_id % 200 + {_G}) * 1000, CAST(ROUND(e.value * 100) AS BIGINT) * 1024
FROM events e JOIN k_pod p ON e.event_id = p.pkey WHERE e.event_type = 'error'"""


def needed(sql: str) -> list[str]:
    """Views a text uses, directly or through others, in creation order."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                todo.append(VIEWS[name])
    return [name for name in VIEWS if name in found]


def with_views(sql: str) -> str:
    """Put the views a query needs in front of it."""
    views = ", ".join(f"{name} AS ({VIEWS[name]})" for name in needed(sql))
    if not views:
        return sql
    body = sql.lstrip()
    if body.upper().startswith("WITH "):
        return f"WITH {views}, {body[5:]}"
    return f"WITH {views} {body}"
