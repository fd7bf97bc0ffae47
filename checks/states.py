"""Health states, roll-ups and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import check, flat
from checks.sql import AS_OF, STATES, day, eu, rfc
from fleetlens.functions.ids import ensure_uuid
from fleetlens.functions.states import severity, state_ordinal
from fleetlens.operators import health, rollup
from fleetlens.operators import normalize as N


def parent(spark, sf, kind):
    return N.normalize(kind, I.RAW[kind](spark, sf), I.AS_OF)[kind]


def container_rows(spark, sf):
    """All containers with their state as ordinal."""
    return N.container_rows(I.objects(spark, sf, "pod")).withColumn("state_no", state_ordinal(F.col("health_state")))


def _health(kind: str, key: str, sql: str):
    check(key, sql)(lambda spark, sf: parent(spark, sf, kind).select("uuid", "health_state", "health_reason"))


check("health_container", f"SELECT uuid, {STATES}[state_no + 1] AS health_state, reason_text AS health_reason FROM k_placed_container")(
    lambda spark, sf: container_rows(spark, sf).select("uuid", "health_state", "health_reason"))

_health("pod", "health_pod", f"SELECT uuid, {STATES}[state_no + 1] AS health_state, health_reason FROM k_pod_health")

_health("node", "health_node", f"""
WITH f AS (SELECT uuid, name, pos, CASE WHEN type = 'Ready' AND status = 'Unknown' THEN 2 ELSE 4 END AS s,
  'Node ' || name || CASE type WHEN 'DiskPressure' THEN ' is running out of disk space' WHEN 'MemoryPressure' THEN ' is running out of available memory'
    WHEN 'PIDPressure' THEN ' is running out of process IDs' WHEN 'NetworkUnavailable' THEN ' network is not correctly configured'
    ELSE ' has ''NodeReady'' condition ''' || lower(status) || '''' END AS t
  FROM k_node_condition WHERE (type = 'Ready' AND status <> 'True') OR (type <> 'Ready' AND status = 'True')),
g AS (SELECT uuid, arg_max(s, pos) AS s, string_agg(t, '. ' ORDER BY pos) || '.' AS t FROM f GROUP BY uuid)
SELECT k.uuid, {STATES}[COALESCE(g.s, 0) + 1] AS health_state, COALESCE(g.t, 'Node ' || k.name || ' is ok.') AS health_reason
FROM k_node k LEFT JOIN g ON k.uuid = g.uuid""")

check("node_ready", "SELECT uuid, nkey % 5 NOT IN (3, 4) AS ready FROM k_node")(
    lambda spark, sf: I.objects(spark, sf, "node").select("uuid", health.node_ready(F.col("status.conditions")).alias("ready")))

check("pods_evicted", "SELECT uuid, name FROM k_pod WHERE phase = 'Failed' AND reason = 'Evicted'")(
    lambda spark, sf: I.objects(spark, sf, "pod").filter(health.pod_evicted(F.col("status.phase"), F.col("status.reason")))
    .select("uuid", F.col("meta.name").alias("name")))

_W = "namespace || '/' || name"
_health("deployment", "health_deployment", f"""
SELECT uuid, CASE WHEN unavailable > 0 THEN 'critical' WHEN available < desired THEN 'warning' ELSE 'ok' END AS health_state,
 CASE WHEN unavailable > 0 THEN 'Deployment ' || {_W} || ' has ' || unavailable || ' unavailable replicas.'
  WHEN available < desired THEN 'Deployment ' || {_W} || ' only has ' || available || ' out of ' || desired || ' desired replicas available.'
  ELSE 'Deployment ' || {_W} || ' has all ' || desired || ' desired replicas available.' END AS health_reason FROM k_customer WHERE ckey % 4 = 0""")
_health("replica_set", "health_replica_set", f"""
SELECT uuid, CASE WHEN available < 1 AND desired > 0 THEN 'critical' WHEN available < desired THEN 'warning' ELSE 'ok' END AS health_state,
 CASE WHEN available < 1 AND desired > 0 THEN 'ReplicaSet ' || {_W} || ' has no replica available from ' || desired || ' desired.'
  WHEN available < desired THEN 'ReplicaSet ' || {_W} || ' only has ' || available || ' out of ' || desired || ' desired replicas available.'
  ELSE 'ReplicaSet ' || {_W} || ' has all ' || desired || ' desired replicas available.' END AS health_reason FROM k_customer WHERE ckey % 4 = 1""")
_health("daemon_set", "health_daemon_set", f"""
SELECT uuid, CASE WHEN desired < 1 THEN 'unknown' WHEN available = 0 THEN 'critical' WHEN available < desired THEN 'warning' ELSE 'ok' END AS health_state,
 CASE WHEN desired < 1 THEN 'DaemonSet ' || {_W} || ' has an invalid desired node count: ' || desired || '.'
  WHEN available = 0 THEN 'DaemonSet ' || {_W} || ' does not have a single pod available which should run on ' || desired || ' desired nodes.'
  WHEN available < desired THEN 'DaemonSet ' || {_W} || ' pods are only available on ' || available || ' out of ' || desired || ' desired nodes.'
  ELSE 'DaemonSet ' || {_W} || ' has pods available on all ' || desired || ' desired nodes.' END AS health_reason FROM k_customer WHERE ckey % 4 = 2""")
_health("stateful_set", "health_stateful_set", f"""
SELECT uuid, CASE WHEN available = 0 THEN 'critical' WHEN available < desired THEN 'warning' ELSE 'ok' END AS health_state,
 CASE WHEN available = 0 THEN 'StatefulSet ' || {_W} || ' has no replica available from ' || desired || ' desired.'
  WHEN available < desired THEN 'StatefulSet ' || {_W} || ' only has ' || available || ' out of ' || desired || ' desired replicas available.'
  ELSE 'StatefulSet ' || {_W} || ' has all ' || desired || ' desired replicas available.' END AS health_reason FROM k_customer WHERE ckey % 4 = 3""")

_J = "'Job ' || c.namespace || '/job-' || o_orderkey || "
_health("job", "health_job", f"""
SELECT {eu("'job-' || o_orderkey")} AS uuid,
 CASE o_orderkey % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'critical' WHEN 3 THEN 'warning' WHEN 4 THEN 'ok' ELSE 'pending' END AS health_state,
 CASE o_orderkey % 7 WHEN 0 THEN {_J} ' met its sucess criteria.'
  WHEN 1 THEN {_J} ' has completed its execution successfully with ' || CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 5) || ' necessary pod completions.' ELSE 'any pod completion.' END
  WHEN 2 THEN {_J} ' has failed its execution. BackoffLimit: too many retries.'
  WHEN 3 THEN {_J} ' is about to fail its execution. BackoffLimit: too many retries.'
  WHEN 4 THEN {_J} ' is suspended.'
  ELSE {_J} ' is running since ' || {day('o_orderdate')} || ' with currently ' || (o_orderkey % 2) || ' active, ' || (o_orderkey % 3) || ' completed and ' || (o_orderkey % 4)
   || ' failed pods. Successful termination requires ' || CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 5) || ' pod completions' ELSE 'any pod completion' END || '.'
   || CASE WHEN o_orderkey % 6 <> 0 THEN ' The back-off limit is 6.' ELSE '' END
   || CASE WHEN o_orderkey % 2 = 0 THEN ' Deadline for completion is ' || (o_orderkey % 1000) || '.' ELSE '' END END AS health_reason
FROM orders JOIN k_customer c ON o_custkey = c.ckey""")

_health("cron_job", "health_cron_job", f"""
WITH c AS (SELECT o_orderkey AS k, 'cron-' || o_orderkey AS name, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS sched,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + CASE WHEN o_orderkey % 5 = 0 THEN INTERVAL (-1) HOUR ELSE INTERVAL 1 HOUR END END AS succ,
  CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 5 + 1) * 400 END AS deadline_days, o_orderdate FROM orders),
d AS (SELECT *, sched + to_days(CAST(deadline_days AS INTEGER)) AS deadline FROM c)
SELECT {eu("name")} AS uuid,
 CASE WHEN sched IS NULL THEN 'warning' WHEN succ IS NULL THEN 'critical' WHEN {AS_OF} > deadline THEN 'critical' WHEN sched > succ THEN 'warning'
  WHEN k % 6 = 0 THEN 'warning' ELSE 'ok' END AS health_state,
 'CronJob ' || name || CASE WHEN sched IS NULL THEN ' has never been scheduled.' WHEN succ IS NULL THEN ' has never completed successfully.'
  WHEN {AS_OF} > deadline THEN ' missed its starting deadline. Last scheduled at ' || {rfc('sched')} || ', deadline was ' || {rfc('deadline')} || '.'
  WHEN sched > succ THEN ' has recent schedules without success. Last successful run: ' || {rfc('succ')} || ', last scheduled: ' || {rfc('sched')} || '.'
  WHEN k % 6 = 0 THEN ' is currently suspended.' ELSE ' is operating normally. Last successful run: ' || {rfc('succ')} || '.' END AS health_reason FROM d""")

check("severity", f"""SELECT {STATES}[state_no + 1] AS state, ['ok','info','err','warning','crit'][state_no + 1] AS severity, COUNT(*) AS n
FROM k_placed_container GROUP BY state_no""")(
    lambda spark, sf: container_rows(spark, sf).groupBy("state_no").agg(F.count(F.lit(1)).alias("n")).select(
        health.state_name(F.col("state_no")).alias("state"), severity(F.col("state_no")).alias("severity"), "n"))

RESOURCES = list(N.RESOURCE_COLUMNS)
check("pod_resources", "SELECT * FROM k_pod_resources")(
    lambda spark, sf: rollup.pod_resources(container_rows(spark, sf), RESOURCES))


def _rolled(spark, sf):
    rows = container_rows(spark, sf).select("pod_uuid", "sort", "position", F.col("state_no").alias("state"), F.col("health_reason").alias("reason"))
    return rollup.container_rollup(rows)


check("container_rollup", f"SELECT pod_uuid, {STATES}[state_no + 1] AS health_state, not_ok, reasons FROM k_rollup")(
    lambda spark, sf: _rolled(spark, sf).select("pod_uuid", health.state_name(F.col("state")).alias("health_state"), "not_ok", "reasons"))
check("pod_running_count", "SELECT pod_uuid, total - not_ok AS running, total FROM k_rollup")(
    lambda spark, sf: _rolled(spark, sf).select("pod_uuid", "running", "total"))

check("container_status", """SELECT pod_uuid, name, CASE WHEN has_status THEN CASE flag WHEN 'A' THEN 'Terminated' WHEN 'N' THEN 'Running' ELSE 'Waiting' END END AS state,
 ready, started, CASE WHEN has_status THEN q % 6 ELSE 0 END AS restart_count FROM k_placed_container""")(
    lambda spark, sf: flat(N.container_rows(I.objects(spark, sf, "pod")).select("pod_uuid", "name", "state", "ready", "started", "restart_count")))


@check("state_summary", f"""
WITH t AS (SELECT cluster_uuid, namespace, 'pod' AS kind, {STATES}[state_no + 1] AS s FROM k_pod_health
 UNION ALL SELECT cluster_uuid, namespace, 'deployment', CASE WHEN unavailable > 0 THEN 'critical' WHEN available < desired THEN 'warning' ELSE 'ok' END FROM k_customer WHERE ckey % 4 = 0
 UNION ALL SELECT cluster_uuid, namespace, 'service', NULL FROM k_service)
SELECT cluster_uuid, namespace, kind, s AS health_state, COUNT(*) AS objects, CAST(GROUPING(cluster_uuid, namespace, kind, s) AS BIGINT) AS level
FROM t GROUP BY ROLLUP (cluster_uuid, namespace, kind, s)""")
def state_summary(spark, sf):
    return health.summarize_states({k: parent(spark, sf, k) for k in ("pod", "deployment", "service")})


check("container_union", """SELECT sort, COUNT(*) AS containers, COUNT(DISTINCT pod_uuid) AS pods FROM k_placed_container GROUP BY sort""")(
    lambda spark, sf: rollup.union_containers({
        sort: df for sort, df in zip(("main", "sidecar", "init"), N.container_tables(N.with_meta(I.landed_pods(spark, sf))).values())
    }).groupBy("sort").agg(F.count(F.lit(1)).alias("containers"), F.count_distinct("pod_uuid").alias("pods")))
