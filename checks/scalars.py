"""Column functions over whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import check, flat
from checks.sql import day, eu, ms, rfc, u5
from fleetlens.functions import flags, ids, network, objects, quantity, text
from fleetlens.operators import samples as S

T = I.table


@check("ensure_uuid", f"""SELECT o_orderkey AS k, {eu("'order-' || o_orderkey")} AS hashed, {eu("'order-' || o_orderkey")} AS kept FROM orders""")
def ensure_uuid(spark, sf):
    hashed = ids.ensure_uuid(I.text("order-", F.col("o_orderkey")))
    braced = F.upper(F.concat(F.lit("{"), F.col("hashed"), F.lit("}")))
    return T(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), hashed.alias("hashed")).select("k", "hashed", ids.ensure_uuid(braced).alias("kept"))


check("uuid5", f"""SELECT conv_id, turn, {u5("'6ba7b810-9dad-11d1-80b4-00c04fd430c8'", "text")} AS id FROM conversations""")(
    lambda spark, sf: T(spark, sf, "conversations").select("conv_id", "turn", ids.uuid5(F.lit("6ba7b810-9dad-11d1-80b4-00c04fd430c8"), F.col("text")).alias("id")))
check("null_if_empty", "SELECT doc_id, NULLIF(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, '') AS source FROM documents")(
    lambda spark, sf: T(spark, sf, "documents").select("doc_id", text.null_if_empty(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))).alias("source")))
_KINDS = ["Pod", "ReplicaSet", "DaemonSet", "StatefulSet", "PersistentVolumeClaim", "CronJob"]
check("snake_kind", f"SELECT p_partkey, ['pod','replica_set','daemon_set','stateful_set','persistent_volume_claim','cron_job'][p_partkey % 6 + 1] AS kind FROM part")(
    lambda spark, sf: T(spark, sf, "part").select("p_partkey", text.snake(F.get(F.array(*[F.lit(k) for k in _KINDS]), (F.col("p_partkey") % 6).cast("int"))).alias("kind")))


@check("quantity", """
WITH q AS (SELECT p_partkey AS k, p_partkey % 4000 AS n FROM part)
SELECT k, n AS milli_m, n * 1000 AS milli_plain, n * 1048576000 AS milli_mi, n * 1000000 AS milli_k, n * 1073741824000 AS milli_gi,
 n * 1000000000000 AS milli_g, CAST(ceil(n / 1000000.0) AS BIGINT) AS milli_n, n * 100 AS milli_tenths, n * 1000000 AS milli_exponent,
 CAST(ceil(n / 1000.0) AS BIGINT) AS value_m, n * 1048576 AS value_mi, CAST(NULL AS BIGINT) AS bad FROM q""")
def quantities(spark, sf):
    n = F.col("p_partkey") % 4000
    milli = lambda *parts: quantity.quantity_milli(I.text(n, *parts))
    tenths = I.text(F.floor(n / 10), ".", n % 10)
    return T(spark, sf, "part").select(
        F.col("p_partkey").alias("k"), milli("m").alias("milli_m"), milli().alias("milli_plain"), milli("Mi").alias("milli_mi"), milli("k").alias("milli_k"),
        milli("Gi").alias("milli_gi"), milli("G").alias("milli_g"), milli("n").alias("milli_n"), quantity.quantity_milli(tenths).alias("milli_tenths"),
        milli("e3").alias("milli_exponent"), quantity.quantity_value(I.text(n, "m")).alias("value_m"), quantity.quantity_value(I.text(n, "Mi")).alias("value_mi"),
        milli("Q").alias("bad"))


@check("host_of", """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '10.0.0.' || s_suppkey WHEN 1 THEN 'fd00::' || s_suppkey WHEN 2 THEN 'node-' || s_suppkey WHEN 3 THEN NULL ELSE '' END AS host FROM supplier""")
def host_of(spark, sf):
    k = F.col("s_suppkey")
    given = F.when(k % 5 == 0, I.text("10.0.0.", k, ":9100")).when(k % 5 == 1, I.text("[fd00::", k, "]:9100")).when(k % 5 == 2, I.text("node-", k)).when(
        k % 5 == 3, I.text("fd00::", k)).otherwise(":9100")
    return T(spark, sf, "supplier").select("s_suppkey", network.host_of(given).alias("host"))


@check("cidr_ips", """SELECT p_partkey, CASE WHEN p_partkey % 33 <= 1 THEN -2 ELSE CAST(pow(2, 32 - p_partkey % 33) AS BIGINT) - 2 END AS v4,
 CASE WHEN p_partkey % 129 <= 1 THEN -2 WHEN p_partkey % 129 <= 65 THEN 9223372036854775805 ELSE CAST(pow(2, 128 - p_partkey % 129) AS BIGINT) - 2 END AS v6, CAST(0 AS BIGINT) AS none FROM part""")
def cidr_ips(spark, sf):
    k = F.col("p_partkey")
    return T(spark, sf, "part").select("p_partkey", network.cidr_ips(I.text("10.0.0.0/", k % 33)).alias("v4"), network.cidr_ips(I.text("fd00::/", k % 129)).alias("v6"),
                                       network.cidr_ips(F.lit("")).alias("none"))


check("node_roles", "SELECT name, CASE WHEN nkey % 10 = 0 THEN 'control-plane, worker' ELSE 'worker' END AS roles FROM k_node")(
    lambda spark, sf: I.nodes(spark, sf).select("meta.name", objects.node_roles(F.col("meta.labels")).alias("roles")))


@check("bit_ops", "SELECT p_partkey, (p_partkey & 4) <> 0 AS has, p_partkey | 4 AS set_, p_partkey & ~4 AS cleared, xor(p_partkey, 4) AS toggled, NULLIF(p_partkey % 4, 0) AS stored FROM part")
def bit_ops(spark, sf):
    k = F.col("p_partkey")
    return T(spark, sf, "part").select("p_partkey", flags.has_flag(k, 4).alias("has"), flags.set_flag(k, 4).alias("set_"), flags.clear_flag(k, 4).alias("cleared"),
                                       flags.toggle_flag(k, 4).alias("toggled"), flags.null_if_zero(k % 4).alias("stored"))


check("ip_families", """SELECT nation_key, segment, CASE nation_key % 4 WHEN 0 THEN 'DualStack' WHEN 1 THEN 'IPv4' WHEN 2 THEN 'IPv6' END AS families FROM k_service""")(
    lambda spark, sf: I.services(spark, sf).select(
        F.regexp_extract("meta.uid", "svc-([0-9]+)-", 1).cast("bigint").alias("nation_key"), F.col("meta.labels.segment").alias("segment"),
        network.ip_families(F.col("spec.ipFamilies")).alias("families")))


@check("first_member", """SELECT pod_uuid, name, CASE WHEN has_status THEN CASE flag WHEN 'A' THEN 'Terminated' WHEN 'N' THEN 'Running' ELSE 'Waiting' END END AS member,
 CASE WHEN has_status AND flag NOT IN ('A', 'N') THEN '{"reason":"' || waiting_reason || '","message":"back-off. "}' END AS waiting_json FROM k_container_fact""")
def first_member(spark, sf):
    s = F.col("status.state")
    name, json = objects.first_set_member([("Waiting", s["waiting"]), ("Running", s["running"]), ("Terminated", s["terminated"])])
    return I.container_facts(spark, sf).select(ids.ensure_uuid(I.text("order-", F.col("pkey"))).alias("pod_uuid"), F.col("spec.name").alias("name"),
                                               name.alias("member"), F.when(name == "Waiting", json).alias("waiting_json"))


_TRIM = "regexp_replace(regexp_replace({}, '^\\s+|\\s+$', '', 'g'), '\\.$', '')"
check("trim_stop", f"SELECT conv_id, turn, {_TRIM.format('text')} AS text FROM conversations")(
    lambda spark, sf: T(spark, sf, "conversations").select("conv_id", "turn", text.trim_stop(F.col("text")).alias("text")))
check("reason_message", f"""SELECT conv_id, turn, role || CASE WHEN turn % 3 = 0 THEN '' ELSE COALESCE(': ' || NULLIF({_TRIM.format('text')}, ''), '') END AS told FROM conversations""")(
    lambda spark, sf: T(spark, sf, "conversations").select("conv_id", "turn", text.reason_message(F.col("role"), F.when(F.col("turn") % 3 == 0, " . ").otherwise(F.col("text"))).alias("told")))


def tail_sql(column: str, size: int) -> str:
    """The last bytes of a text through its hexadecimal form."""
    h = f"hex(encode({column}))"
    cut = f"regexp_replace(right({h}, {2 * size}), '^([89AB][0-9A-F]){{0,3}}', '')"
    body = f"decode(unhex({cut}))"
    return (f"CASE WHEN strlen({column}) <= {size} THEN {column} WHEN strpos({body}, chr(10)) > 0 THEN substr({body}, strpos({body}, chr(10)) + 1) ELSE {body} END")


check("log_tail", f"SELECT conv_id, turn, {tail_sql('text', 101)} AS short, {tail_sql('text', 700)} AS middle, text AS whole FROM conversations")(
    lambda spark, sf: T(spark, sf, "conversations").select("conv_id", "turn", text.log_tail(F.col("text"), 101).alias("short"),
                                                           text.log_tail(F.col("text"), 700).alias("middle"), text.log_tail(F.col("text")).alias("whole")))
check("join_list", "SELECT uid, '10.2.0.' || nation_key || ', fd00::' || nation_key AS ips, '' AS none FROM k_service")(
    lambda spark, sf: I.services(spark, sf).select("meta.uid", text.join_list(F.col("spec.clusterIPs")).alias("ips"), text.join_list(F.col("spec.externalIPs")).alias("none")))
check("alert_url", "SELECT uuid, 'https://web.example/fleet/statefulset?id=' || uuid AS url, 'https://web.example/fleet/x' AS rel, 'http://a/b' AS abs FROM k_pod")(
    lambda spark, sf: I.bare_pod_objects(spark, sf).select("uuid", objects.alert_url("https://web.example/fleet", F.lit("stateful_set"), F.col("uuid")).alias("url"),
                                                         objects.resolve_url("https://web.example/fleet", F.lit("/x")).alias("rel"),
                                                         objects.resolve_url("https://web.example/fleet", F.lit("http://a/b")).alias("abs")))
check("object_name", "SELECT uuid, CASE WHEN namespace = '' THEN name ELSE namespace || '/' || name END AS full_name FROM k_incident")(
    lambda spark, sf: I.incidents(spark, sf).select("uuid", text.object_name(F.col("namespace"), F.col("name")).alias("full_name")))
check("defaults", """SELECT uid, nation_key % 3 <> 0 AS ports, CASE WHEN nation_key % 3 = 1 THEN 'Local' ELSE 'Cluster' END AS policy FROM k_service""")(
    lambda spark, sf: I.services(spark, sf).select(
        "meta.uid", flags.or_default(F.col("spec.allocateLoadBalancerNodePorts"), "allocate_load_balancer_node_ports").alias("ports"),
        flags.or_default(F.col("spec.internalTrafficPolicy"), "internal_traffic_policy").alias("policy")))
check("minute_bucket", f"SELECT event_id, {ms('ts')} - {ms('ts')} % 60000 AS minute_ms FROM events")(
    lambda spark, sf: T(spark, sf, "events").select("event_id", S.minute_bucket_ms(F.col("ts")).alias("minute_ms")))
check("metric_keys", """SELECT cluster_uuid AS entity_uuid, ts_ms - ts_ms % 60000 AS timestamp, metric AS category, mode AS name, COUNT(*) AS points FROM k_counter
 WHERE metric = 'node_cpu_seconds_total' GROUP BY ALL""")(
    lambda spark, sf: flat(I.samples(spark, sf, "node_cpu_seconds_total").groupBy(
        ids.metric_key(F.col("cluster_uuid"), S.minute_bucket(F.col("ts")), F.col("metric"), F.col("labels.mode")).alias("k")).agg(
            F.count(F.lit(1)).alias("points")).select("k.*", "points")))
