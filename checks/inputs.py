"""The driver's tables as raw cluster objects (Spark side). Row-by-row reshaping, no hidden filters or limits."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens import schemas
from fleetlens.functions.ids import ensure_uuid
from fleetlens.operators.merge import dedup_last
from fleetlens.operators.normalize import with_meta
from fleetlens.session import shared_folder

AS_OF = "2000-06-01 00:00:00"

OWNER = "STRUCT<uid: STRING, kind: STRING, name: STRING, controller: BOOLEAN, blockOwnerDeletion: BOOLEAN>"
VERSION_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
                 "l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table; its zone-less instants are read as UTC."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*[
        F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
        for f in df.schema.fields
    ])


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _fit(df: DataFrame, kind: str) -> DataFrame:
    """Bring generated columns to the kind's exact input schema; fields that were not generated are NULL."""
    def conform(column: Column, have: T.DataType, want: T.DataType) -> Column:
        if have.simpleString() == want.simpleString():
            return column
        if isinstance(want, T.StructType):
            names = set(have.names)
            fields = [
                conform(column[f.name], have[f.name].dataType, f.dataType).alias(f.name) if f.name in names
                else F.lit(None).cast(f.dataType).alias(f.name) for f in want.fields
            ]
            return F.when(column.isNotNull(), F.struct(*fields))
        if isinstance(want, T.ArrayType) and isinstance(want.elementType, T.StructType):
            return F.transform(column, lambda x: conform(x, have.elementType, want.elementType))
        return column.cast(want)

    schema = df.schema
    return df.select(*[
        conform(F.col(f.name), schema[f.name].dataType, f.dataType).alias(f.name) if f.name in schema.names
        else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.kind_schema(kind).fields
    ])


def obj(ddl: str, **fields: Column) -> Column:
    """A whole struct of the given type; fields not named are NULL."""
    type_ = T._parse_datatype_string(ddl)
    assert set(fields) <= set(type_.names), fields
    return F.struct(*[
        (fields[f.name] if f.name in fields else F.lit(None)).cast(f.dataType).alias(f.name) if f.name not in fields
        or not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else fields[f.name].alias(f.name)
        for f in type_.fields])


def meta(uid: Column, namespace: Column, name: Column, created: Column, **extra: Column) -> Column:
    return obj(schemas.META, uid=uid, namespace=namespace, name=name, resourceVersion=F.lit("1"), creationTimestamp=created,
               **extra).alias("meta")


def labels(*pairs: tuple[str, Column]) -> Column:
    return F.create_map(*[x for name, value in pairs for x in (F.lit(name), value)])


def condition(type_: str, status: Column | str, reason: str = "", message: str = "", at: Column | None = None) -> Column:
    status = F.lit(status) if isinstance(status, str) else status
    return obj(schemas.CONDITION, type=F.lit(type_), status=status, reason=F.lit(reason), message=F.lit(message),
               lastTransitionTime=F.lit(None) if at is None else at)


def true_unless(test: Column) -> Column:
    return F.when(test, "False").otherwise("True")


def nations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation")


def namespaces(spark: SparkSession, sf: str) -> DataFrame:
    df = nations(spark, sf)
    key = F.col("n_nationkey")
    made = F.timestamp_seconds(key * 86400)
    return _fit(df.select(
        text("region-", F.col("n_regionkey")).alias("cluster_uid"),
        meta(text("nation-", key), F.lit(""), F.col("n_name"), made,
             labels=labels(("team", text("t", key % 3))), annotations=labels(("Owner", text("O", key)))),
        F.when(key % 7 == 0, "Terminating").otherwise("Active").alias("phase"),
        F.array(condition("NamespaceDeletionContentFailure", true_unless(key % 2 == 0), "R", "m", made)).alias("conditions"),
    ), "namespace")


def node_facts(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").join(nations(spark, sf), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("s_suppkey").alias("nkey"), text("region-", F.col("n_regionkey")).alias("cluster_uid"),
                    text("supp-", F.col("s_suppkey")).alias("uid"), text("node-", F.col("s_suppkey")).alias("name"))


def node_count(spark: SparkSession, sf: str) -> Column:
    """Number of nodes as a scalar sub-query."""
    return table(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("nkey")
    pressure = lambda type_, pos: condition(
        type_, F.when((k + pos) % 9 == 0, "True").otherwise("False"), at=F.timestamp_seconds(k * 60))
    ready = condition("Ready", F.when(k % 5 == 3, "False").when(k % 5 == 4, "Unknown").otherwise("True"),
                      at=F.timestamp_seconds(k * 60))
    roles = F.when(k % 10 == 0, labels(("node-role/worker", F.lit("")), ("node-role/control-plane", F.lit("")),
                                       ("zone", text("z", k % 3)))).otherwise(
        labels(("node-role/worker", F.lit("")), ("zone", text("z", k % 3))))
    return _fit(node_facts(spark, sf).select(
        "cluster_uid", meta(F.col("uid"), F.lit(""), F.col("name"), F.timestamp_seconds(k * 3600), labels=roles),
        F.struct(text("10.", k % 256, ".0.0/", k % 4 + 22).alias("podCIDR"), (k % 11 == 0).alias("unschedulable")).alias("spec"),
        F.struct(
            labels(("cpu", text(k % 8 + 1)), ("memory", text((k % 8 + 1) * 4, "Gi"))).alias("capacity"),
            labels(("cpu", text((k % 8 + 1) * 900, "m")), ("memory", text((k % 8 + 1) * 3, "Gi")), ("pods", F.lit("110"))).alias("allocatable"),
            F.array(F.struct(F.lit("Hostname").alias("type"), F.col("name").alias("address")),
                    F.struct(F.lit("InternalIP").alias("type"), text("10.0.0.", k).alias("address"))).alias("addresses"),
            F.array(pressure("DiskPressure", 1), ready, pressure("MemoryPressure", 3), pressure("PIDPressure", 4),
                    pressure("NetworkUnavailable", 5)).alias("conditions"),
            F.array(text("v-", k % 2)).alias("volumesInUse"),
            F.array(*[F.struct(F.lit(f"v-{i}").alias("name"), F.lit(f"/dev/{i}").alias("devicePath")) for i in (0, 1)]).alias("volumesAttached"),
            F.struct(text("m-", k).alias("machineID"), F.lit("amd64").alias("architecture")).alias("nodeInfo"),
        ).alias("status"),
    ), "node")


def pod_facts(spark: SparkSession, sf: str) -> DataFrame:
    """One pod per order, on a node by order number; its cluster is the node's."""
    n_nodes = node_count(spark, sf)
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").join(nations(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("o_orderkey")
    placed = (
        o.join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("nkey", key % n_nodes)
        .join(node_facts(spark, sf).select("nkey", "cluster_uid", F.col("name").alias("node_name")), "nkey")
    )
    return placed.select(
        key.alias("pkey"), text("order-", key).alias("uid"), "cluster_uid", F.col("n_name").alias("namespace"),
        text("pod-", key).alias("name"), "node_name", "nkey", F.col("o_custkey").alias("owner_key"),
        F.when(key % 11 == 0, "Failed").when(F.col("o_orderstatus") == "F", "Succeeded")
        .when(F.col("o_orderstatus") == "P", "Pending").otherwise("Running").alias("phase"),
        F.when(key % 97 == 0, "NodeLost").when(key % 33 == 0, "Evicted").alias("reason"),
        F.when(key % 33 == 0, " node was low on memory. ").alias("message"),
        F.when(key % 3 == 0, "Guaranteed").when(key % 3 == 1, "Burstable").otherwise("BestEffort").alias("qos"),
        F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").alias("created"),
    )


def container_versions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


def last_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Last version of each container as it is in the table, and the pod it belongs to (``pkey``)."""
    last = dedup_last(container_versions(spark, sf), ["l_orderkey", "l_linenumber"], VERSION_ORDER)
    return last.withColumnRenamed("l_orderkey", "pkey")


def container_resources() -> Column:
    """Limits and requests of a container version."""
    q = F.col("l_quantity").cast("bigint")
    quantity = lambda test, value: F.when(test, value).otherwise("0")
    return F.struct(
        labels(("cpu", quantity(q % 7 != 0, text(q * 20, "m"))), ("memory", quantity(q % 8 != 0, text(q * 2, "Mi")))).alias("limits"),
        labels(("cpu", quantity(q % 10 != 0, text(q * 10, "m"))), ("memory", quantity(q % 6 != 0, text(q, "Mi")))).alias("requests"))


def container_name() -> Column:
    return text("c-", F.col("l_linenumber"))


def container_facts(spark: SparkSession, sf: str, by_pod: bool = False) -> DataFrame:
    """Last version of each container: its specification and status, and the pod it belongs to.

    ``by_pod`` deals the versions by pod and sorts them before specifications are made of them: what is dealt and sorted is a
    few numbers.
    """
    df = last_versions(spark, sf)
    if by_pod:
        df = df.repartition("pkey").sortWithinPartitions("pkey", "l_linenumber")
    q, n, at = F.col("l_quantity").cast("bigint"), F.col("l_linenumber"), F.col("l_shipdate")
    spec = obj(
        schemas.CONTAINER_SPEC, name=container_name(), image=text("img/", F.col("l_partkey") % 50, ":1"),
        imagePullPolicy=F.lit("IfNotPresent"), restartPolicy=F.when(n == 2, "Always"), resources=container_resources(),
        hasReadinessProbe=F.col("l_suppkey") % 2 == 0, hasStartupProbe=F.col("l_partkey") % 3 == 0,
        volumeDevices=F.when(q % 9 == 0, F.array(F.struct(text("dev-", n).alias("name"), text("/dev/x", n).alias("devicePath")))),
        volumeMounts=F.array(F.struct(text("vol-", n).alias("name"), text("/data/", n).alias("mountPath"),
                                      F.when(q % 4 == 0, "").otherwise("sub").alias("subPath"), (q % 2 == 0).alias("readOnly"))))
    ended_type = "STRUCT<exitCode: INT, signal: INT, reason: STRING, message: STRING, startedAt: TIMESTAMP, finishedAt: TIMESTAMP>"
    ended = obj(ended_type, exitCode=q % 3, signal=q % 2, reason=F.lit("Error"), message=F.lit(" out of memory. "), finishedAt=at)
    waiting = F.struct(
        F.element_at(F.array(*[F.lit(x) for x in ("PodInitializing", "ContainerCreating", "ErrImagePull", "CrashLoopBackOff", "")]),
                     (q % 5 + 1).cast("int")).alias("reason"), F.lit("back-off. ").alias("message"))
    flag = F.col("l_returnflag")
    state = obj(schemas.CONTAINER_STATE, waiting=F.when(~flag.isin("A", "N"), waiting),
                running=F.when(flag == "N", F.struct(at.alias("startedAt"))), terminated=F.when(flag == "A", ended))
    gone = obj(ended_type, exitCode=F.lit(1), signal=F.lit(9), message=F.lit("gone. "), finishedAt=at,
               reason=F.when(F.col("l_partkey") % 2 == 0, "ImagePullBackOff").otherwise("Error"))
    none = lambda type_: F.lit(None).cast(type_)
    before = obj(schemas.CONTAINER_STATE, waiting=none("struct<reason:string,message:string>"),
                 running=none("struct<startedAt:timestamp>"), terminated=F.when(F.col("l_suppkey") % 4 == 0, gone))
    status = F.when(q % 13 != 0, obj(
        schemas.CONTAINER_STATUS, name=text("c-", n), ready=F.col("l_linestatus") == "F", started=q % 4 != 0,
        restartCount=q % 6, state=state, lastTerminationState=before))
    return df.select("pkey", n.alias("pos"), spec.alias("spec"), status.alias("status"))


def bare_pods(spark: SparkSession, sf: str) -> DataFrame:
    """Raw pods without their containers, for queries that read none of them."""
    return pods(spark, sf, containers=False)


def pods(spark: SparkSession, sf: str, containers: bool = True) -> DataFrame:
    """Raw pods. Containers are gathered per pod after the last-version step, so a pod holds one per line number."""
    p = pod_facts(spark, sf)
    if containers:
        c = container_facts(spark, sf, by_pod=True)
        nested = c.groupBy("pkey").agg(F.array_sort(F.collect_list(F.struct("pos", "spec", "status")), lambda a, b: a["pos"] - b["pos"]).alias("cs")).select(
            "pkey", F.filter("cs", lambda x: x["pos"] <= 2).alias("inits"), F.filter("cs", lambda x: x["pos"] > 2).alias("mains"))
        p = p.join(nested, "pkey", "left")
    k = F.col("pkey")
    made = F.col("created")
    conditions = F.array_compact(F.array(
        condition("PodScheduled", true_unless(k % 29 == 0), "Unschedulable", "0/3 nodes", made),
        condition("PodReadyToStartContainers", true_unless(k % 31 == 0), "", "", made),
        condition("Initialized", true_unless(k % 17 == 0), "", "", made),
        condition("Ready", true_unless(k % 5 == 0), "", "", made),
        F.when(k % 41 == 0, condition("DisruptionTarget", "True", "Preempted", "by scheduler. ", made))))
    claim = F.struct(text("claim-", F.col("owner_key")).alias("claimName"), (k % 2 == 0).alias("readOnly"))
    no_claim = F.lit(None).cast("struct<claimName:string,readOnly:boolean>")
    volume = lambda name, claim_, source: F.struct(
        F.lit(name).alias("name"), claim_.alias("persistentVolumeClaim"), source.alias("source"))
    no_source = F.lit(None).cast("map<string,string>")
    config = volume("cfg", no_claim, labels(("configMap", F.lit('{"name":"cm"}'))))
    owner = obj(OWNER, uid=text("cust-", F.col("owner_key")), kind=F.lit("ReplicaSet"), name=text("rs-", F.col("owner_key")),
                controller=F.lit(True))
    held = {}
    if containers:
        held = {"containers": F.col("mains.spec"), "initContainers": F.col("inits.spec")}
    statuses = {}
    if containers:
        statuses = {"containerStatuses": F.array_compact("mains.status"), "initContainerStatuses": F.array_compact("inits.status")}
    return _fit(p.select(
        "cluster_uid",
        meta(F.col("uid"), F.col("namespace"), F.col("name"), made,
             deletionTimestamp=F.when(k % 37 == 0, made + F.expr("INTERVAL 1 DAY")),
             deletionGracePeriodSeconds=F.when(k % 37 == 0, F.when(k % 2 == 0, 0).otherwise(30)),
             labels=labels(("segment", F.col("segment")), ("priority", F.col("priority")), ("nation", F.col("namespace"))),
             annotations=labels(("note", text(F.col("segment"), ":", F.col("priority")))),
             ownerReferences=F.array(owner)),
        F.struct(F.col("node_name").alias("nodeName"), F.lit("Always").alias("restartPolicy"),
                 *[c.alias(n) for n, c in held.items()],
                 F.when(k % 3 == 0, F.array(volume("data", claim, no_source), config)).otherwise(F.array(config)).alias("volumes")).alias("spec"),
        F.struct(F.col("phase"), F.col("reason"), F.col("message"), text("10.1.0.", k % 250).alias("podIP"),
                 F.lit("").alias("nominatedNodeName"), F.col("qos").alias("qosClass"), conditions.alias("conditions"),
                 *[c.alias(n) for n, c in statuses.items()]).alias("status"),
    ), "pod")


def landing(spark: SparkSession, name: str) -> str:
    """A new folder for input files in the shared folder."""
    return f"{shared_folder(spark)}/landing-{name}-{uuid.uuid4().hex}"


def landed_pods(spark: SparkSession, sf: str) -> DataFrame:
    """Raw pods landed as Parquet files, for queries that make several tables of them: each reads the fields it needs."""
    landed, raw = landing(spark, "pods"), pods(spark, sf)
    raw.write.parquet(landed)
    return spark.read.schema(raw.schema).parquet(landed)


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(nations(spark, sf), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("ckey"), text("region-", F.col("n_regionkey")).alias("cluster_uid"),
        F.col("n_name").alias("namespace"), F.col("n_nationkey").alias("nation_key"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"), (F.col("c_custkey") % 6).cast("int").alias("desired"),
        F.least(F.col("c_custkey") % 6, F.col("c_custkey") % 5).cast("int").alias("available"),
        F.when(F.col("c_custkey") % 10 == 0, F.col("c_custkey") % 3).otherwise(0).cast("int").alias("unavailable"))


WORKLOADS = {"deployment": 0, "replica_set": 1, "daemon_set": 2, "stateful_set": 3}


def workloads(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Every fourth customer is a workload of each kind."""
    k = F.col("ckey")
    df = customers(spark, sf).filter(k % 4 == WORKLOADS[kind])
    made = F.timestamp_seconds(k * 60)
    owner = obj(OWNER, uid=text("nation-", F.col("nation_key")), kind=F.lit("Deployment"), name=F.col("namespace"),
                controller=F.lit(True), blockOwnerDeletion=F.lit(True))
    conditions = F.array(
        condition("Available", true_unless(k % 3 == 0), "MinimumReplicas", "few replicas", made),
        condition("ReplicaFailure", F.when(k % 7 == 0, "True").otherwise("False"), "Quota", "quota hit", made))
    return _fit(df.select(
        "cluster_uid", meta(text("cust-", k), F.col("namespace"), F.col("name"), made,
                            labels=labels(("segment", F.col("segment"))), annotations=labels(("rev", text(k % 9))),
                            ownerReferences=F.array(owner)),
        "desired", F.col("desired").alias("actual"), F.col("available").alias("updated"), F.col("available").alias("ready"),
        "available", "unavailable", F.lit("RollingUpdate").alias("strategy"), F.lit("RollingUpdate").alias("updateStrategy"),
        (k % 4).cast("int").alias("minReadySeconds"), F.lit(600).alias("progressDeadlineSeconds"), (k % 8 == 0).alias("paused"),
        F.col("desired").alias("current"), F.lit(0).alias("misscheduled"), F.col("available").alias("fullyLabeled"),
        text("svc-", k).alias("serviceName"), F.lit("OrderedReady").alias("podManagementPolicy"),
        F.when(k % 5 == 0, F.struct(F.lit("Delete").alias("whenDeleted"), F.lit("Retain").alias("whenScaled"))).alias("pvcRetention"),
        conditions.alias("conditions")), kind)


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    types = ["SuccessCriteriaMet", "Complete", "Failed", "FailureTarget", "Suspended"]
    pick = lambda type_, n: condition(
        type_, F.when(k % 7 == n, "True").otherwise("False"), "BackoffLimit", "too many retries", at)
    df = table(spark, sf, "orders").join(customers(spark, sf), F.col("o_custkey") == F.col("ckey"))
    return _fit(df.select(
        "cluster_uid", meta(text("job-", k), F.col("namespace"), text("job-", k), at,
                            labels=labels(("priority", F.col("o_orderpriority")))),
        (k % 4).cast("int").alias("parallelism"), F.when(k % 3 != 0, k % 5).cast("int").alias("completions"),
        F.when(k % 2 == 0, k % 1000).alias("activeDeadlineSeconds"), F.when(k % 6 != 0, F.lit(6)).alias("backoffLimit"),
        F.when(k % 8 == 0, F.lit(100)).alias("ttlSecondsAfterFinished"), F.lit("NonIndexed").alias("completionMode"),
        (k % 9 == 0).alias("suspend"), at.alias("startTime"), F.when(k % 7 == 1, at + F.expr("INTERVAL 1 HOUR")).alias("completionTime"),
        (k % 2).cast("int").alias("active"), (k % 3).cast("int").alias("succeeded"), (k % 4).cast("int").alias("failed"),
        F.array(*[pick(t, n) for n, t in enumerate(types)]).alias("conditions")), "job")


def cron_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """One per order; runs follow the order date."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    df = table(spark, sf, "orders").join(customers(spark, sf), F.col("o_custkey") == F.col("ckey"))
    return _fit(df.select(
        "cluster_uid", meta(text("cron-", k), F.col("namespace"), text("cron-", k), at,
                            labels=labels(("segment", F.col("segment")))),
        F.lit("0 * * * *").alias("schedule"), F.when(k % 2 == 0, "UTC").alias("timeZone"),
        F.when(k % 3 == 0, (k % 5 + 1) * 86400 * 400).alias("startingDeadlineSeconds"), F.lit("Forbid").alias("concurrencyPolicy"),
        (k % 6 == 0).alias("suspend"), F.lit(3).alias("successfulJobsHistoryLimit"), F.lit(1).alias("failedJobsHistoryLimit"),
        F.transform(F.sequence(F.lit(1), (k % 3 + 1).cast("int")), lambda i: F.concat(F.lit("job-"), i.cast("string"))).alias("active"),
        F.when(k % 13 != 0, at).alias("lastScheduleTime"),
        F.when(k % 7 != 0, at + F.when(k % 5 == 0, F.expr("INTERVAL -1 HOUR")).otherwise(F.expr("INTERVAL 1 HOUR"))).alias("lastSuccessfulTime"),
    ), "cron_job")


def services(spark: SparkSession, sf: str) -> DataFrame:
    """One service per nation and market segment that occurs; even nations select on the nation too."""
    df = customers(spark, sf).select("cluster_uid", "namespace", "nation_key", "segment").distinct()
    k, seg = F.col("nation_key"), F.col("segment")
    selector = F.when(k % 2 == 0, labels(("segment", seg), ("nation", F.col("namespace")))).otherwise(labels(("segment", seg)))
    families = F.when(k % 4 == 0, F.array(F.lit("IPv4"), F.lit("IPv6"))).when(k % 4 == 1, F.array(F.lit("IPv4"))).when(
        k % 4 == 2, F.array(F.lit("IPv6")))
    ports = F.transform(F.sequence(F.lit(1), (k % 2 + 1).cast("int")), lambda i: F.struct(
        F.concat(F.lit("p"), i.cast("string")).alias("name"), F.lit("TCP").alias("protocol"), (i + 8000).alias("port"),
        F.lit("http").alias("targetPort")))
    return _fit(df.select(
        "cluster_uid", meta(text("svc-", k, "-", seg), F.col("namespace"), text("svc-", seg), F.timestamp_seconds(k * 60),
                            labels=labels(("segment", seg)), annotations=labels(("a", F.lit("b")))),
        F.struct(
            text("10.2.0.", k).alias("clusterIP"), F.array(text("10.2.0.", k), text("fd00::", k)).alias("clusterIPs"),
            F.lit("ClusterIP").alias("type"), F.array().cast("array<string>").alias("externalIPs"), F.lit("None").alias("sessionAffinity"),
            F.lit("").alias("externalName"), (k % 3).cast("int").alias("healthCheckNodePort"), families.alias("ipFamilies"),
            F.when(k % 5 == 0, "SingleStack").alias("ipFamilyPolicy"), F.when(k % 3 == 0, F.lit(False)).alias("allocateLoadBalancerNodePorts"),
            F.when(k % 3 == 1, "Local").alias("internalTrafficPolicy"), selector.alias("selector"), ports.alias("ports")).alias("spec"),
        F.array(condition("LoadBalancerReady", true_unless(k % 2 == 0), "r", "m", F.timestamp_seconds(k * 60))).alias("conditions"),
    ), "service")


def endpoint_slices(spark: SparkSession, sf: str) -> DataFrame:
    """One slice per part: up to two endpoints of up to two addresses, and up to two ports."""
    k = F.col("p_partkey")
    endpoint = lambda i: F.struct(
        F.when(k % 2 == 0, text("h-", k)).alias("hostname"), text("node-", k % 10).alias("nodeName"),
        F.transform(F.sequence(F.lit(1), (F.col("p_size") % 2 + 1).cast("int")),
                    lambda a: F.concat(F.lit("10.3."), i.cast("string"), F.lit("."), a.cast("string"))).alias("addresses"),
        (k % 3 != 0).alias("ready"), F.when(k % 4 == 0, F.lit(True)).alias("serving"),
        F.when(k % 5 != 0, F.struct(F.lit("Pod").alias("kind"), F.lit("NATION_0").alias("namespace"),
                                    F.concat(F.lit("pod-"), i.cast("string")).alias("name"),
                                    F.concat(F.lit("order-"), i.cast("string")).alias("uid"))).alias("targetRef"))
    endpoints = F.when(k % 3 > 0, F.transform(F.sequence(F.lit(1), (k % 3).cast("int")), endpoint))
    ports = F.when(k % 4 > 0, F.transform(F.sequence(F.lit(1), (k % 2 + 1).cast("int")), lambda i: F.struct(
        F.concat(F.lit("p"), i.cast("string")).alias("name"), F.lit("TCP").alias("protocol"), (i + 9000).cast("int").alias("port"))))
    return _fit(table(spark, sf, "part").select(
        text("region-", k % 5).alias("cluster_uid"),
        meta(text("slice-", k), F.lit("NATION_0"), text("slice-", k), F.timestamp_seconds(k), labels=labels(("brand", F.col("p_brand")))),
        F.lit("IPv4").alias("addressType"), endpoints.alias("endpoints"), ports.alias("ports")), "endpoint_slice")


def ingresses(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    no_service = F.lit(None).cast("struct<name:string,portName:string,portNumber:int>")
    no_resource = F.lit(None).cast("struct<apiGroup:string,kind:string,name:string>")
    service = F.struct(text("svc-", k % 9).alias("name"), F.lit("web").alias("portName"), F.lit(80).alias("portNumber"))
    resource = F.struct(F.when(k % 2 == 0, "storage.k8s.io").alias("apiGroup"), F.lit("Bucket").alias("kind"),
                        text("bucket-", k % 7).alias("name"))
    backend = lambda s, r: F.struct(s.alias("service"), r.alias("resource"))
    path = lambda name, b: F.struct(F.lit(name).alias("path"), F.lit("Prefix").alias("pathType"), b.alias("backend"))
    rule = F.struct(text("h", k % 6, ".example").alias("host"), F.array(
        path("/a", backend(service, no_resource)), path("", backend(no_service, resource)),
        path("/n", backend(no_service, no_resource))).alias("paths"))
    return _fit(table(spark, sf, "part").select(
        text("region-", k % 5).alias("cluster_uid"),
        meta(text("ing-", k), F.lit("NATION_0"), text("ing-", k), F.timestamp_seconds(k), labels=labels(("brand", F.col("p_brand")))),
        F.array(F.struct(F.array(text("a", k, ".example"), text("b", k, ".example")).alias("hosts"), F.lit("tls").alias("secretName"))).alias("tls"),
        F.when(k % 3 == 0, backend(service, no_resource)).when(k % 3 == 1, backend(no_service, resource)).alias("defaultBackend"),
        F.array(rule).alias("rules")), "ingress")


def config_maps(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return _fit(table(spark, sf, "part").select(
        text("region-", k % 5).alias("cluster_uid"),
        meta(text("cm-", k), F.lit("NATION_0"), F.col("p_name"), F.timestamp_seconds(k), labels=labels(("brand", F.col("p_brand")))),
        F.when(k % 2 == 0, k % 4 == 0).alias("immutable")), "config_map")


def secrets(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return _fit(table(spark, sf, "part").select(
        text("region-", k % 5).alias("cluster_uid"),
        meta(text("sec-", k), F.lit("NATION_0"), F.col("p_name"), F.timestamp_seconds(k)),
        F.lit("Opaque").alias("type"), F.when(k % 2 == 0, k % 4 == 0).alias("immutable")), "secret")


MODES = ["ReadWriteOnce", "ReadOnlyMany", "ReadWriteMany", "ReadWriteOncePod"]


def modes(k: Column) -> Column:
    """Access modes by the low four bits of a key, so every mask occurs."""
    return F.array_compact(F.array(*[F.when(k.bitwiseAND(1 << i) != 0, m) for i, m in enumerate(MODES)]))


def pvcs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("ckey")
    return _fit(customers(spark, sf).select(
        "cluster_uid", meta(text("pvc-", k), F.col("namespace"), text("claim-", k), F.timestamp_seconds(k)),
        modes(k).alias("desiredAccessModes"), F.array(F.lit("ReadWriteOnce")).alias("actualAccessModes"),
        text(k % 50 + 1, "Gi").alias("storageRequest"), F.when(k % 3 != 0, text(k % 50 + 1, "Gi")).alias("actualStorage"),
        F.lit("Bound").alias("phase"), F.when(k % 4 != 0, text("pv-", k)).otherwise("").alias("volumeName"),
        F.when(k % 5 == 0, "Block").alias("volumeMode"), F.lit("fast").alias("storageClassName"),
        F.array(condition("FileSystemResizePending", true_unless(k % 2 == 0), "r", "m", F.timestamp_seconds(k))).alias("conditions"),
    ), "pvc")


def persistent_volumes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("ckey")
    claim = F.struct(F.lit("PersistentVolumeClaim").alias("kind"), text("claim-", k).alias("name"), text("pvc-", k).alias("uid"))
    return _fit(customers(spark, sf).select(
        "cluster_uid", meta(text("pv-", k), F.lit(""), text("pv-", k), F.timestamp_seconds(k)), modes(k).alias("accessModes"),
        text(k % 50 + 1, "G").alias("storage"), F.lit("Delete").alias("reclaimPolicy"), F.lit("").alias("storageClassName"),
        F.lit("Bound").alias("phase"), F.lit("").alias("reason"), F.lit("ok").alias("message"), F.when(k % 5 == 0, "Block").alias("volumeMode"),
        F.when(k % 2 == 0, labels(("csi", text('{"volumeHandle":"', k, '"}')))).alias("source"),
        F.when(k % 4 != 0, claim).alias("claimRef")), "persistent_volume")


def events(spark: SparkSession, sf: str) -> DataFrame:
    k, at = F.col("event_id"), F.col("ts")
    return _fit(table(spark, sf, "events").select(
        text("region-", k % 5).alias("cluster_uid"), meta(text("ev-", k), F.lit("NATION_0"), text("ev-", k), at),
        F.struct(text("order-", k).alias("uid"), F.lit("Pod").alias("kind"), F.lit("").alias("namespace"), text("pod-", k).alias("name")).alias("regarding"),
        F.lit("kubelet").alias("reportingController"), F.lit("").alias("reportingInstance"), F.col("event_type").alias("reason"),
        F.col("props").alias("note"), F.when(F.col("event_type") == "error", "Warning").otherwise("Normal").alias("type"),
        F.when(k % 3 == 0, at).alias("eventTime"), F.when(k % 3 == 1, at - F.expr("INTERVAL 1 HOUR")).alias("firstTimestamp"),
        F.when(k % 4 == 0, at + F.expr("INTERVAL 1 HOUR")).alias("lastTimestamp"), (k % 3).cast("int").alias("count"),
        F.when(k % 5 == 0, F.struct((k % 17).cast("int").alias("count"), F.when(k % 2 == 0, at + F.expr("INTERVAL 2 HOUR")).alias("lastObservedTime"))).alias("series"),
    ), "event")


RAW = {
    "namespace": namespaces, "node": nodes, "pod": pods, "job": jobs, "cron_job": cron_jobs, "service": services,
    "endpoint_slice": endpoint_slices, "ingress": ingresses, "config_map": config_maps, "secret": secrets, "pvc": pvcs,
    "persistent_volume": persistent_volumes, "event": events,
    **{kind: (lambda spark, sf, kind=kind: workloads(spark, sf, kind)) for kind in WORKLOADS},
}


def objects(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Raw objects of a kind with their uuids."""
    return with_meta(RAW[kind](spark, sf))


def bare_pod_objects(spark: SparkSession, sf: str) -> DataFrame:
    return with_meta(bare_pods(spark, sf))


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """Change feed of events' users: several changes per object, in order of event id."""
    k = F.col("event_id")
    return table(spark, sf, "events").select(
        k.alias("seq"), F.when(F.col("event_type") == "signup", "ADDED").when(F.col("event_type") == "error", "DELETED")
        .otherwise("UPDATED").alias("type"), F.lit("config_map").alias("kind"), text("region-", F.col("user_id") % 5).alias("cluster_uid"),
        text("obj-", F.col("user_id")).alias("uid"), text("NATION_0/obj-", F.col("user_id")).alias("key"), "ts",
        F.round(F.col("value") * 100).cast("bigint").alias("payload"))


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as log lines."""
    return table(spark, sf, "conversations").select(
        ensure_uuid(text("conv-", F.col("conv_id"))).alias("container_uuid"), F.col("turn").alias("seq"),
        F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn")).alias("ts"), "text")


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        ensure_uuid(text("order-", k * 2)).alias("uuid"), F.when(k % 2 == 0, ensure_uuid(F.lit("region-1"))).otherwise("").alias("cluster_uuid"),
        F.lit("pod").alias("resource"), text("pod-", k * 2).alias("name"),
        F.when(k % 3 == 0, "").otherwise("NATION_0").alias("namespace"))


def config(spark: SparkSession, sf: str) -> DataFrame:
    """Four configuration entries per customer, the customer standing for a cluster."""
    k = F.col("c_custkey")
    keys = ["prometheus.url", "prometheus.username", "notifications.url", "notifications.username"]
    entry = lambda i, key: F.struct(F.lit(key).alias("key"), text("v", k, "-", F.lit(i)).alias("value"), (k % (i + 2) == 0).alias("locked"))
    return table(spark, sf, "customer").select(
        ensure_uuid(text("cluster-", k)).alias("cluster_uuid"), F.inline(F.array(*[entry(i, key) for i, key in enumerate(keys)])))


def favorites(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        ensure_uuid(text("cust-", k)).alias("resource_uuid"), F.when(k % 2 == 0, "pod").otherwise("node").alias("kind"),
        text("user", k % 20).alias("username"), F.when(k % 9 != 0, k % 13).cast("int").alias("priority"))


def heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    down = F.col("event_type") == "error"
    return table(spark, sf, "events").select(
        ensure_uuid(text("inst-", F.col("user_id"))).alias("uuid"), ensure_uuid(text("cluster-", F.col("user_id"))).alias("cluster_uuid"),
        F.lit("0.4.0").alias("version"), F.when(~down, text("v1.", k % 30)).alias("kubernetes_version"), (~down).alias("reachable"),
        F.when(down, "timeout").alias("message"), F.col("ts").alias("heartbeat"))


# --- metric samples --------------------------------------------------------------------------------------------

GAUGE_START = 1700000000


def _sample(cluster_uid: Column, metric: str | Column, at_seconds: Column, value: Column, **label_columns: Column) -> list[Column]:
    return [
        cluster_uid.alias("cluster_uid"), (F.lit(metric) if isinstance(metric, str) else metric).alias("metric"),
        labels(*label_columns.items()).alias("labels"), F.timestamp_seconds(at_seconds.cast("bigint")).alias("ts"),
        value.cast("double").alias("value")]


def counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counter samples: one per event, fifty events a second, with a reset whenever the sawtooth falls."""
    u = F.col("user_id")
    e = table(spark, sf, "events").filter(F.col("event_type") != "error").withColumn("nkey", u % node_count(spark, sf))
    joined = e.join(node_facts(spark, sf).select("nkey", "cluster_uid", "name"), "nkey")
    placed = joined.join(
        pod_facts(spark, sf).select(F.col("pkey").alias("_p"), F.col("cluster_uid").alias("pod_cluster"), "namespace",
                                    F.col("name").alias("pod_name")), u == F.col("_p"))
    kind = F.col("event_type")
    metric = F.when(kind == "click", "node_cpu_seconds_total").when(kind == "view", "node_network_receive_bytes_total").when(
        kind == "purchase", "node_network_transmit_bytes_total").otherwise("container_cpu_usage_seconds_total")
    of_pod = ~kind.isin("click", "view", "purchase")
    node_labels = labels(
        ("node", F.col("name")), ("instance", text("10.0.0.", F.col("nkey"), ":9100")), ("cpu", text("cpu", u % 2)),
        ("mode", F.when(u % 3 == 0, "idle").when(u % 3 == 1, "user").otherwise("system")),
        ("device", F.when(u % 3 == 0, "veth1").otherwise(text("eth", u % 2))))
    pod_labels = labels(("instance", F.col("name")), ("namespace", F.col("namespace")), ("pod", F.col("pod_name")),
                        ("container", text("c-", u % 2)))
    rising = (F.col("event_id") * 100 + F.pmod(F.round(F.col("value") * 100).cast("bigint"), F.lit(100))) % 20000
    return placed.select(
        F.when(of_pod, F.col("pod_cluster")).otherwise(F.col("cluster_uid")).alias("cluster_uid"), metric.alias("metric"),
        F.when(of_pod, pod_labels).otherwise(node_labels).alias("labels"),
        F.timestamp_millis(F.col("event_id") * 20).alias("ts"), rising.cast("double").alias("value"))


def pod_gauges(spark: SparkSession, sf: str) -> DataFrame:
    """Phase and QoS class of each pod, two samples a few minutes apart."""
    p = pod_facts(spark, sf)
    k = F.col("pkey")
    at = F.explode(F.array(k % 240 + GAUGE_START, k % 240 + GAUGE_START + 120))
    timed = p.select("*", at.alias("_at"))
    who = {"namespace": F.col("namespace"), "pod": F.col("name")}
    phase = timed.select(*_sample(F.col("cluster_uid"), "kube_pod_status_phase", F.col("_at"), F.lit(1), phase=F.col("phase"), **who))
    qos = timed.select(*_sample(F.col("cluster_uid"), "kube_pod_status_qos_class", F.col("_at"), F.lit(1), qos_class=F.col("qos"), **who))
    return phase.unionByName(qos)


def node_gauges(spark: SparkSession, sf: str) -> DataFrame:
    n = node_facts(spark, sf)
    k = F.col("nkey")
    timed = n.select("*", F.explode(F.array(k % 200 + GAUGE_START, k % 200 + GAUGE_START + 60)).alias("_at"))
    late = F.col("_at") % 7
    units = k % 8 + 1
    gauge = lambda metric, value, **ls: timed.select(*_sample(F.col("cluster_uid"), metric, F.col("_at"), value, **ls))
    node = F.col("name")
    exporter = {"node": node, "instance": text("10.0.0.", k, ":9100")}
    parts = [
        gauge("kube_node_info", F.lit(1), node=node), gauge("machine_cpu_cores", units, node=node),
        gauge("machine_memory_bytes", units * 4294967296, node=node),
        gauge("node_memory_MemTotal_bytes", units * 4294967296, **exporter),
        gauge("node_memory_MemAvailable_bytes", units * 1073741824 + late * 1048576, **exporter),
    ]
    for mount in ("/", "/var"):
        parts.append(gauge("node_filesystem_size_bytes", units * 1000, node=node, mountpoint=F.lit(mount)))
        parts.append(gauge("node_filesystem_avail_bytes", units * 250 + late, node=node, mountpoint=F.lit(mount)))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def namespace_gauges(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    return nations(spark, sf).select(*_sample(
        text("region-", F.col("n_regionkey")), "kube_namespace_created", k + GAUGE_START, k, namespace=F.col("n_name")))


def container_gauges(spark: SparkSession, sf: str, metrics: tuple[str, ...] = ()) -> DataFrame:
    """Requests and limits of every container, one sample each; ``metrics`` leaves out others before amounts are parsed."""
    c = last_versions(spark, sf).join(
        pod_facts(spark, sf).select("pkey", "cluster_uid", "namespace", "name", "node_name"), "pkey").select(
        "pkey", "cluster_uid", "namespace", "name", "node_name", container_name().alias("container"), container_resources().alias("resources"))
    from fleetlens.functions.quantity import set_quantity_milli
    entry = lambda part, resource, scale: F.struct(
        F.lit(f"kube_pod_container_resource_{part}").alias("metric"), F.lit(resource).alias("resource"),
        (set_quantity_milli(F.col("resources")[part][resource]) / scale).alias("v"))
    parts = [part for part in ("requests", "limits") if not metrics or f"kube_pod_container_resource_{part}" in metrics]
    rows = c.select("*", F.inline(F.array(*[
        entry(part, resource, 1000.0) for part in parts for resource in ("cpu", "memory")]))).filter(F.col("v").isNotNull())
    return rows.select(*_sample(
        F.col("cluster_uid"), F.col("metric"), F.col("pkey") % 200 + GAUGE_START, F.col("v"), node=F.col("node_name"),
        namespace=F.col("namespace"), pod=F.col("name"), container=F.col("container"), resource=F.col("resource")))


def container_memory(spark: SparkSession, sf: str) -> DataFrame:
    """Memory use of the pods that error events point at, each on its node."""
    e = table(spark, sf, "events").filter(F.col("event_type") == "error")
    p = pod_facts(spark, sf).select("pkey", "cluster_uid", "namespace", "name", "node_name")
    joined = e.join(p, F.col("event_id") == F.col("pkey"))
    return joined.select(*_sample(
        F.col("cluster_uid"), "container_memory_usage_bytes", F.col("event_id") % 200 + GAUGE_START,
        F.round(F.col("value") * 100).cast("bigint") * 1024, instance=F.col("node_name"), namespace=F.col("namespace"),
        pod=F.col("name"), container=F.lit("c-3")))


SAMPLE_SOURCES = {
    "node_cpu_seconds_total": counters, "node_network_receive_bytes_total": counters,
    "node_network_transmit_bytes_total": counters, "container_cpu_usage_seconds_total": counters,
    "kube_pod_status_phase": pod_gauges, "kube_pod_status_qos_class": pod_gauges,
    "kube_namespace_created": namespace_gauges, "container_memory_usage_bytes": container_memory,
    "kube_pod_container_resource_requests": container_gauges, "kube_pod_container_resource_limits": container_gauges,
}


def samples(spark: SparkSession, sf: str, *metrics: str) -> DataFrame:
    """Samples of the given metrics with their cluster uuid."""
    sources = []
    for metric in metrics:
        source = SAMPLE_SOURCES.get(metric, node_gauges)
        if source not in sources:
            sources.append(source)
    merged = None
    for source in sources:
        part = source(spark, sf, metrics) if source is container_gauges else source(spark, sf)
        merged = part if merged is None else merged.unionByName(part)
    # Five clusters: their uuids are looked up, not hashed for each sample.
    clusters = table(spark, sf, "region").select(text("region-", F.col("r_regionkey")).alias("cluster_uid")).withColumn(
        "cluster_uuid", ensure_uuid(F.col("cluster_uid")))
    return merged.filter(F.col("metric").isin(*metrics)).join(clusters, "cluster_uid")
