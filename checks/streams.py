"""What the streaming functions do with one batch."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import ORACLES, check
from checks.scalars import tail_sql
from checks.sql import eu, u5
from checks.tables import landing, new_store
from fleetlens.functions.ids import ensure_uuid, uuid5
from fleetlens.schemas import feed_schema
from fleetlens.sources.readers import read_changes, read_logs
from fleetlens.sources.tables import Batch
from fleetlens.streaming import changes as C
from fleetlens.streaming.logs import LogKeeper, append_logs, lines_of_containers


def change_objects(spark, sf):
    """The change feed with each object as JSON; its payload is a label."""
    body = F.to_json(F.struct(F.struct(
        "uid", F.lit("NATION_0").alias("namespace"), F.col("uid").alias("name"), F.col("seq").cast("string").alias("resourceVersion"),
        F.create_map(F.lit("payload"), F.col("payload").cast("string")).alias("labels")).alias("meta")))
    return I.changes(spark, sf).withColumn("object", F.when(F.col("type") != "DELETED", body)).select(*feed_schema("change").names)


def landed_changes(spark, sf) -> str:
    """The feed as JSON files."""
    landed = landing(spark, "changes")
    change_objects(spark, sf).write.json(landed)
    return landed


check("changes_by_type", "SELECT type, COUNT(*) AS changes, COUNT(DISTINCT uid) AS objects FROM k_change GROUP BY type")(
    lambda spark, sf: read_changes(spark, landed_changes(spark, sf)).groupBy("type").agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("uid").alias("objects")))
check("changes_applied", "SELECT uuid, seq, payload FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY uid ORDER BY seq DESC) AS rn FROM k_change) WHERE rn = 1 AND type <> 'DELETED'")(
    lambda spark, sf: C.without_deletes(C.coalesce_changes(I.changes(spark, sf))).select(ensure_uuid(F.col("uid")).alias("uuid"), "seq", "payload"))


@check("store_changes", ORACLES["changes_applied"])
def store_changes(spark, sf):
    """The feed in three batches through the applier, the second one repeated; payloads come back through the label tables."""
    store, feed = new_store(spark), read_changes(spark, landed_changes(spark, sf))
    applier = C.ChangeApplier(store, kinds=["config_map"], as_of=lambda: datetime.datetime.fromisoformat(I.AS_OF), writer="check")
    third = feed.agg(F.max("seq")).first()[0] // 3 + 1
    for i in (0, 1, 1, 2):
        applier(feed.filter(F.floor(F.col("seq") / third) == i), i)
    now = store.snapshot()
    held = now.read("config_map_label").join(now.read("label").withColumnRenamed("uuid", "label_uuid"), "label_uuid")
    return now.read("config_map").join(held, F.col("uuid") == F.col("config_map_uuid")).select(
        "uuid", F.col("resource_version").cast("bigint").alias("seq"), F.col("value").cast("bigint").alias("payload"))


check("events_keep", "SELECT uuid, MAX(seq) AS seq, arg_max(payload, seq) AS payload FROM k_change WHERE type <> 'DELETED' GROUP BY uuid")(
    lambda spark, sf: C.coalesce_changes(C.without_deletes(I.changes(spark, sf))).select(ensure_uuid(F.col("uid")).alias("uuid"), "seq", "payload"))
check("delete_once", "SELECT DISTINCT uuid FROM k_change WHERE type = 'DELETED'")(lambda spark, sf: C.deleted_ids(I.changes(spark, sf)))
check("deleting_soon", "SELECT uid FROM k_pod WHERE NOT (pkey % 37 = 0 AND created + INTERVAL 1 DAY <= TIMESTAMP '1998-01-01 00:00:30')")(
    lambda spark, sf: C.not_deleting_soon(I.pods(spark, sf), "1998-01-01 00:00:00").select("meta.uid"))


def log_lines(spark, sf):
    """Conversation turns as log lines of a pod each; line numbers have wide gaps."""
    c = I.table(spark, sf, "conversations")
    return c.select(I.text("conv-", F.col("conv_id")).alias("pod_uid"), F.lit("main").alias("container"),
                    F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn")).alias("ts"),
                    (F.col("turn") * F.lit(1_000_003)).cast("bigint").alias("seq"), "text", (F.col("turn") >= 2).cast("int").alias("deal"))


def landed_logs(spark, sf) -> str:
    """Lines as Parquet files."""
    landed = landing(spark, "logs")
    log_lines(spark, sf).drop("deal").write.parquet(landed)
    return landed


_CONTAINER = u5(eu("'conv-' || conv_id"), "'main'")
check("scan_logs", f"""SELECT {_CONTAINER} AS container_uuid, COUNT(*) AS lines, CAST(SUM(strlen(text)) AS BIGINT) AS bytes
 FROM conversations WHERE conv_id * 1000 + turn > 5000 GROUP BY conv_id""")(
    lambda spark, sf: lines_of_containers(read_logs(spark, landed_logs(spark, sf), since="1970-01-01 01:23:20")).groupBy("container_uuid").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes")))

LOG_SIZE = 400
_FIRST = f"SELECT container_uuid, string_agg(text || chr(10), '' ORDER BY seq) AS t FROM k_log WHERE seq < 2 GROUP BY container_uuid"
_THEN = f"SELECT container_uuid, string_agg(text || chr(10), '' ORDER BY seq) AS t FROM k_log WHERE seq >= 2 GROUP BY container_uuid"


@check("container_logs", f"""
WITH a AS (SELECT container_uuid, {tail_sql('t', LOG_SIZE)} AS s FROM ({_FIRST})), b AS ({_THEN}),
j AS (SELECT a.container_uuid, a.s, b.t, COALESCE(a.s, '') || COALESCE(b.t, '') AS w FROM a LEFT JOIN b ON a.container_uuid = b.container_uuid),
k AS (SELECT container_uuid, CASE WHEN t IS NULL THEN s ELSE {tail_sql('w', LOG_SIZE)} END AS logs FROM j)
SELECT container_uuid, logs FROM k""")
def container_logs(spark, sf):
    """Two rounds: the first two turns of each conversation, then the rest."""
    lines = I.logs(spark, sf)
    empty = spark.createDataFrame([], "container_uuid string, logs string, last_update timestamp")
    stored = append_logs(empty, lines.filter("seq < 2"), LOG_SIZE)
    return append_logs(stored, lines.filter("seq >= 2"), LOG_SIZE).select("container_uuid", "logs")


def _rounds(where: str) -> str:
    return f"SELECT conv_id, string_agg(text || chr(10), '' ORDER BY turn) AS t FROM conversations WHERE {where} GROUP BY conv_id"


@check("store_logs", f"""
WITH a AS (SELECT conv_id, {tail_sql('t', LOG_SIZE)} AS s FROM ({_rounds('turn < 2')})), b AS ({_rounds('turn >= 2')}),
j AS (SELECT conv_id, s, t, COALESCE(s, '') || COALESCE(t, '') AS w FROM a FULL JOIN b USING (conv_id))
SELECT {_CONTAINER} AS container_uuid, CASE WHEN t IS NULL THEN s ELSE {tail_sql('w', LOG_SIZE)} END AS logs FROM j
WHERE conv_id % 3 <> 0 AND conv_id % 7 <> 0""")
def store_logs(spark, sf):
    """Lines in two batches, the second one repeated, appended to the stored logs of started containers; then some pods go."""
    store, lines = new_store(spark), log_lines(spark, sf)
    number = F.regexp_extract("pod_uid", "([0-9]+)$", 1).cast("bigint")
    pods = lines.select("pod_uid", number.alias("number"), ensure_uuid(F.col("pod_uid")).alias("pod_uuid")).distinct()
    store.write_upsert("container", pods.select(uuid5(F.col("pod_uuid"), F.lit("main")).alias("uuid"), "pod_uuid", (F.col("number") % 3 != 0).alias("started")))
    store.write_upsert("pod", pods.select(F.col("pod_uuid").alias("uuid")))
    keeper = LogKeeper(store, LOG_SIZE, writer="check")
    for i in (0, 1, 1):
        keeper(lines.filter(F.col("deal") == i).drop("deal"), i)
    store.cascade_delete("pod", pods.filter("number % 7 = 0").select("pod_uuid"), batch=Batch(2, "pods", "check"))
    return store.read("container_log").select("container_uuid", "logs")
