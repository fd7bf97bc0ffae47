"""Table maintenance as DataFrame operators; the stored tables apply the same operators to the buckets a batch touches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import inputs as I
from checks.inputs import landed_pods, landing
from checks.normalized import tables
from checks.registry import ORACLES, check, flat
from checks.sql import eu, ms
from fleetlens import schemas
from fleetlens.functions.ids import ensure_uuid
from fleetlens.operators import merge, rollup
from fleetlens.operators.normalize import normalize
from fleetlens.session import shared_folder
from fleetlens.sources.readers import read_snapshot, warm_keys
from fleetlens.sources.tables import Batch, TableStore

_KEYS = ["l_orderkey", "l_linenumber"]
_ORDER = ", ".join(f"{c} DESC" for c in I.VERSION_ORDER)


def _last(where: str = "TRUE") -> str:
    return f"SELECT * EXCLUDE (rn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ORDER}) AS rn FROM lineitem WHERE {where}) WHERE rn = 1"


_PICK = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_extendedprice, l_returnflag"


def versions(spark, sf, condition: str = "TRUE"):
    return merge.dedup_last(I.container_versions(spark, sf).filter(condition), _KEYS, I.VERSION_ORDER).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")


def scan_pods(spark, sf):
    """Pods landed as JSON lines and read as a snapshot."""
    landed = landing(spark, "pods")
    # Compressed text cannot be read in pieces, so files are bounded by rows.
    I.pods(spark, sf).write.option("maxRecordsPerFile", 100_000).json(landed, compression="gzip")
    read = read_snapshot(spark, landed, "pod")
    return flat(read.select("meta.uid", "meta.namespace", "meta.name", "status.phase", F.col("spec.nodeName").alias("node_name"),
                            F.col("meta.creationTimestamp").alias("created")))


check("scan_pods", f"SELECT uid, namespace, name, phase, node_name, {ms('created')} AS created FROM k_pod")(scan_pods)


def new_store(spark) -> TableStore:
    """An empty store in the shared folder."""
    return TableStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


@check("warm_keys", "SELECT namespace || '/' || name AS key, uuid FROM k_pod WHERE cluster_uid = 'region-1'")
def warm_keys_of_one_cluster(spark, sf):
    """Keys of one cluster from stored pods: its folder of the base, and what a second write left beside it."""
    store = new_store(spark)
    pods = I.bare_pod_objects(spark, sf).select("cluster_uuid", "uuid", "meta.namespace", "meta.name")
    store.write_upsert("pod", pods.withColumn("name", F.when(_every(5, "uuid"), "old").otherwise(F.col("name"))))
    store.write_upsert("pod", pods.filter(_every(5, "uuid")))
    return warm_keys(store.read("pod"), _region_uuid())


def _every(n: int, column: str):
    return F.pmod(F.xxhash64(column), F.lit(n)) == 0


_STORED = ["uuid", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"]


def stored_versions(spark, sf, condition: str):
    """Container versions as rows of a stored table."""
    rows = I.container_versions(spark, sf).filter(condition)
    return rows.withColumn("uuid", ensure_uuid(I.text("line-", F.col("l_orderkey"), "-", F.col("l_linenumber")))).select(
        *_STORED, *[F.col(c).alias(f"_{c}") for c in I.VERSION_ORDER])


def store_upsert(spark, sf, update_columns=None):
    """Two batches through the store, the second one repeated as after a lost acknowledgement, and folded."""
    store, order = new_store(spark), [f"_{c}" for c in I.VERSION_ORDER]
    for i, condition in ((0, "l_quantity <= 25"), (1, "l_quantity > 25"), (1, "l_quantity > 25")):
        store.write_upsert("container", stored_versions(spark, sf, condition), order, update_columns, batch=Batch(i, "containers", "check"))
        if i:
            store.compact()
    return flat(store.read("container").select(*_STORED[1:]))


def _region_uuid() -> str:
    return str(uuid.uuid5(uuid.UUID("3f249403-2bb0-428f-8e91-504d1fd7ddb6"), "region-1"))


check("upsert_containers", f"""SELECT {_PICK} FROM ({_last('l_quantity > 25')}) UNION ALL
 SELECT {_PICK} FROM ({_last('l_quantity <= 25')}) o WHERE NOT EXISTS (SELECT 1 FROM lineitem n WHERE n.l_quantity > 25 AND n.l_orderkey = o.l_orderkey AND n.l_linenumber = o.l_linenumber)""")(
    lambda spark, sf: flat(merge.merge_rows(versions(spark, sf, "l_quantity <= 25"), versions(spark, sf, "l_quantity > 25"), _KEYS)))
check("store_upsert", ORACLES["upsert_containers"])(store_upsert)
check("upsert_partial", f"""WITH o AS (SELECT {_PICK} FROM ({_last('l_quantity <= 25')})), n AS (SELECT {_PICK} FROM ({_last('l_quantity > 25')}))
SELECT l_orderkey, l_linenumber, COALESCE(n.l_quantity, o.l_quantity) AS l_quantity, COALESCE(o.l_extendedprice, n.l_extendedprice) AS l_extendedprice,
 COALESCE(o.l_returnflag, n.l_returnflag) AS l_returnflag FROM o FULL JOIN n USING (l_orderkey, l_linenumber)""")(
    lambda spark, sf: flat(merge.merge_columns(versions(spark, sf, "l_quantity <= 25"), versions(spark, sf, "l_quantity > 25"), _KEYS, ["l_quantity"])))


check("store_upsert_partial", ORACLES["upsert_partial"])(lambda spark, sf: store_upsert(spark, sf, ["l_quantity"]))


def _gone(spark, sf):
    return I.table(spark, sf, "events").filter(F.col("event_type") == "error").select(ensure_uuid(I.text("order-", F.col("event_id"))).alias("uuid"))


_GONE = f"SELECT {eu("'order-' || event_id")} FROM events WHERE event_type = 'error'"
check("delete_keys", f"SELECT uuid, name FROM k_pod WHERE uuid NOT IN ({_GONE})")(
    lambda spark, sf: merge.without_keys(I.bare_pod_objects(spark, sf).select("uuid", "meta.name"), _gone(spark, sf), "uuid"))


def _counts(parts):
    merged = None
    for name, df in parts.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("tbl"), "rows")
        merged = part if merged is None else merged.unionByName(part)
    return merged


def _count_sql(extra: str, label_extra: str) -> str:
    c = "SELECT * FROM k_placed_container WHERE " + extra.replace("uuid", "pod_uuid")
    return f"""
SELECT 'pod' AS tbl, COUNT(*) AS rows FROM k_pod WHERE {extra} UNION ALL SELECT 'pod_condition', COALESCE(CAST(SUM(4 + CASE WHEN pkey % 41 = 0 THEN 1 ELSE 0 END) AS BIGINT), 0) FROM k_pod WHERE {extra}
UNION ALL SELECT 'container', COUNT(*) FROM ({c}) WHERE sort = 'main' UNION ALL SELECT 'sidecar_container', COUNT(*) FROM ({c}) WHERE sort = 'sidecar'
UNION ALL SELECT 'init_container', COUNT(*) FROM ({c}) WHERE sort = 'init' UNION ALL SELECT 'container_mount', COUNT(*) FROM ({c})
UNION ALL SELECT 'container_device', COUNT(*) FROM ({c}) WHERE q % 9 = 0 UNION ALL SELECT 'pod_owner', COUNT(*) FROM k_pod WHERE {extra}
UNION ALL SELECT 'pod_pvc', COUNT(*) FROM k_pod WHERE pkey % 3 = 0 AND {extra} UNION ALL SELECT 'pod_volume', COUNT(*) FROM k_pod WHERE {extra}
UNION ALL SELECT 'label', 3 * COUNT(*) FROM k_pod WHERE {label_extra} UNION ALL SELECT 'pod_label', 3 * COUNT(*) FROM k_pod WHERE {extra}
UNION ALL SELECT 'resource_label', 3 * COUNT(*) FROM k_pod WHERE {extra} UNION ALL SELECT 'annotation', COUNT(*) FROM k_pod WHERE {label_extra}
UNION ALL SELECT 'pod_annotation', COUNT(*) FROM k_pod WHERE {extra} UNION ALL SELECT 'resource_annotation', COUNT(*) FROM k_pod WHERE {extra}"""


check("cascade_counts", _count_sql("uuid IS NOT NULL", "TRUE"))(lambda spark, sf: _counts(normalize("pod", landed_pods(spark, sf), I.AS_OF)))


@check("cascade_delete_pods", _count_sql(f"uuid NOT IN ({_GONE})", "TRUE"))
def cascade_delete_pods(spark, sf):
    """Rows left per table after deleting pods; labels and annotations have no foreign key and stay."""
    before = normalize("pod", landed_pods(spark, sf), I.AS_OF)
    after = merge.cascade_without(before, "pod", _gone(spark, sf), schemas.RELATIONS)
    return _counts({**{name: before[name] for name in before}, **after})


@check("store_cascade_delete", ORACLES["cascade_delete_pods"])
def store_cascade_delete(spark, sf):
    """Pods and all their child tables written to the store, then deleted in two batches, one of them repeated."""
    store, gone = new_store(spark), _gone(spark, sf)
    store.cascade_upsert("pod", I.pods(spark, sf), I.AS_OF, batch=Batch(0, "pods", "check"))
    for i in (1, 2, 2):
        store.cascade_delete("pod", gone.filter(_every(2, "uuid") == (i == 1)), batch=Batch(i, "pods", "check"))
    now = store.snapshot()
    return _counts({table: now.read(table) for table in now.tables()})


check("dedup_last", _last())(lambda spark, sf: merge.dedup_last(I.container_versions(spark, sf), _KEYS, I.VERSION_ORDER).select(*I.container_versions(spark, sf).columns))
check("dedup_rows", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")(
    lambda spark, sf: merge.dedup_rows(I.container_versions(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag")))

check("retention_events", "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-14 12:00:00'")(
    lambda spark, sf: merge.unexpired(I.table(spark, sf, "events"), "ts", "2024-01-15 12:00:00", 1).select("event_id", "event_type"))
check("retention_metrics", "SELECT metric, COUNT(*) AS points FROM k_counter WHERE ts_ms >= 10000 GROUP BY metric")(
    lambda spark, sf: merge.unexpired(I.counters(spark, sf), "ts", "1970-01-02 00:00:10", 1).groupBy("metric").agg(F.count(F.lit(1)).alias("points")))
check("retention_batch", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-14 12:00:00' ORDER BY ts, event_id LIMIT 5000")(
    lambda spark, sf: merge.expired_batch(I.table(spark, sf, "events"), "ts", "2024-01-15 12:00:00", 1, 5000, ["event_id"]).select("event_id"))

_CFG = f"""(SELECT {eu("'cluster-' || c_custkey")} AS cluster_uuid, t.key, 'v' || c_custkey || '-' || t.i AS value, c_custkey % (t.i + 2) = 0 AS locked FROM customer,
 (VALUES (0, 'prometheus.url'), (1, 'prometheus.username'), (2, 'notifications.url'), (3, 'notifications.username')) t(i, key))"""


def _cluster_uuid(n: int) -> str:
    return str(uuid.uuid5(uuid.UUID("3f249403-2bb0-428f-8e91-504d1fd7ddb6"), f"cluster-{n}"))


@check("replace_slice", f"""
SELECT * FROM {_CFG} WHERE NOT (cluster_uuid = '{_cluster_uuid(2)}' AND key LIKE 'prometheus.%') UNION ALL
SELECT cluster_uuid, key, value || '-new', TRUE FROM {_CFG} WHERE cluster_uuid = '{_cluster_uuid(2)}' AND key LIKE 'prometheus.%'""")
def replace_slice(spark, sf):
    config = I.config(spark, sf)
    new = config.filter((F.col("cluster_uuid") == _cluster_uuid(2)) & F.col("key").startswith("prometheus.")).withColumn(
        "value", F.concat("value", F.lit("-new"))).withColumn("locked", F.lit(True))
    return merge.replace_slice(config, _cluster_uuid(2), "prometheus.", new)


check("config_pivot", f"SELECT cluster_uuid, MAX(value) FILTER (key = 'notifications.url') AS url, MAX(value) FILTER (key = 'notifications.username') AS username FROM {_CFG} GROUP BY cluster_uuid")(
    lambda spark, sf: merge.config_pivot(I.config(spark, sf), "notifications.", ["url", "username"]))
check("instance_latest", f"""
WITH h AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events),
r AS (SELECT user_id, arg_max('v1.' || (event_id % 30), ts) AS v, MAX({ms('ts')}) AS t FROM events WHERE event_type <> 'error' GROUP BY user_id)
SELECT {eu("'inst-' || h.user_id")} AS uuid, {eu("'cluster-' || h.user_id")} AS cluster_uuid, '0.4.0' AS version, r.v AS kubernetes_version, r.t AS kubernetes_heartbeat,
 event_type <> 'error' AS kubernetes_api_reachable, CASE WHEN event_type = 'error' THEN 'timeout' END AS message, {ms('ts')} AS heartbeat
FROM h LEFT JOIN r ON h.user_id = r.user_id WHERE rn = 1""")(lambda spark, sf: flat(merge.instance_latest(I.heartbeats(spark, sf))))
check("fan_in_kinds", """SELECT CASE ckey % 4 WHEN 0 THEN 'deployment' WHEN 1 THEN 'replica_set' WHEN 2 THEN 'daemon_set' ELSE 'stateful_set' END AS kind, uuid, name FROM k_customer""")(
    lambda spark, sf: merge.fan_in({kind: tables(spark, sf, kind)[kind].select("uuid", "name") for kind in I.WORKLOADS}))
check("write_counts", """SELECT 'table-' || (user_id % 7) AS "table", COUNT(*) FILTER (event_type <> 'error') AS written, COUNT(*) FILTER (event_type = 'error') AS deleted FROM events GROUP BY 1""")(
    lambda spark, sf: rollup.write_counts(I.table(spark, sf, "events").select(
        I.text("table-", F.col("user_id") % 7).alias("table"), F.when(F.col("event_type") == "error", "DELETED").otherwise("UPDATED").alias("type"))))
check("latest_version", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 1")(
    lambda spark, sf: merge.latest_by(I.table(spark, sf, "events").select("event_id", "event_type"), "event_id"))
