"""Joins between kinds: selectors, owners, claims, lookups of metric samples, stale keys, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.network import host_of
from fleetlens.session import shared_folder


ENTRY = ["cluster_uuid", "name", "value"]


def selector_entries(services: DataFrame) -> DataFrame:
    """(cluster_uuid, service_uuid, namespace, selector map) -> one anchor candidate per selector entry."""
    return services.select(
        "cluster_uuid", "service_uuid", "namespace", F.map_entries("selector").alias("wanted"),
        F.explode("selector").alias("name", "value"))


def label_entries(pods: DataFrame) -> DataFrame:
    """One slim row per label of a pod; the label map itself stays behind."""
    return pods.select("cluster_uuid", "pod_uuid", F.explode("labels").alias("name", "value"))


def selector_anchors(services: DataFrame, entries: DataFrame) -> DataFrame:
    """The entry by which each service is looked up: the one that the fewest pods carry (``carriers``, also 0).

    ``entries``: cluster_uuid, pod_uuid, name, value. Services that select on nothing have no anchor.
    """
    wanted = selector_entries(services)
    # Counted before the shuffle on the map side, and only for texts that some selector mentions.
    carried = (
        entries.select(*ENTRY).join(wanted.select(*ENTRY).distinct(), ENTRY, "left_semi")
        .groupBy(*ENTRY).agg(F.count(F.lit(1)).alias("carriers"))
    )
    # An entry no pod carries is dropped by the inner join of its service's other entries: it must stay as count 0.
    counted = wanted.join(carried, ENTRY, "left").withColumn("carriers", F.coalesce("carriers", F.lit(0)))
    return (
        counted.groupBy("cluster_uuid", "service_uuid", "namespace", "wanted")
        .agg(F.min(F.struct("carriers", "name", "value")).alias("a"))
        .select("cluster_uuid", "service_uuid", F.col("namespace").alias("service_namespace"), "wanted", "a.*")
    )


def anchored_pairs(pods: DataFrame, anchors: DataFrame, same_namespace: bool = False) -> DataFrame:
    """Pods that carry a service's anchor, and the rest of its selector too; any entry of it serves as anchor.

    Only slim entries meet the anchors. Label maps join afterwards, to the hits.
    """
    hits = label_entries(pods).join(anchors.select(*ENTRY, "service_uuid", "service_namespace", "wanted"), ENTRY).select(
        "cluster_uuid", "pod_uuid", "service_uuid", "service_namespace", "wanted")
    held = F.forall("wanted", lambda e: F.coalesce(F.try_element_at("labels", e["key"]) == e["value"], F.lit(False)))
    matched = hits.join(pods.select("cluster_uuid", "pod_uuid", "namespace", "labels"), ["cluster_uuid", "pod_uuid"]).filter(held)
    if same_namespace:
        matched = matched.filter(F.col("namespace") == F.col("service_namespace"))
    return matched.select("service_uuid", "pod_uuid")


def service_pods(pods: DataFrame, services: DataFrame, same_namespace: bool = False) -> DataFrame:
    """Pairs where every selector entry of the service is among the labels of the pod.

    ``pods``: cluster_uuid, pod_uuid, namespace, labels (map), one row per pod; ``services``: cluster_uuid, service_uuid,
    namespace, selector (map). An empty selector matches nothing.

    Each service is looked up through one entry only, the one the fewest pods carry, by an equality join on (cluster,
    name, value); the rest of the selector is checked on the joined row. So a label that half of all pods carry is
    used as join key only by services that select on nothing rarer, and those pairs are all part of the result.
    """
    anchors = selector_anchors(services, label_entries(pods)).filter(F.col("carriers") > 0)
    return anchored_pairs(pods, anchors, same_namespace)


def remove_pods(pairs: DataFrame, deleted: DataFrame) -> DataFrame:
    return pairs.join(deleted.select("pod_uuid").distinct(), "pod_uuid", "left_anti").select(*pairs.columns)


def node_aliases(nodes: DataFrame) -> DataFrame:
    """Names a node goes by in metric labels: its name and its internal addresses (raw nodes with uuids)."""
    internal = F.transform(
        F.filter("status.addresses", lambda a: a["type"] == "InternalIP"), lambda a: a["address"])
    names = F.concat(F.array("meta.name"), F.coalesce(internal, F.array().cast("array<string>")))
    return (
        nodes.select("cluster_uuid", "uuid", F.explode(names).alias("alias"))
        .groupBy("cluster_uuid", "alias").agg(F.min("uuid").alias("node_uuid"))
    )


def lookup_nodes(points: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add ``node_uuid`` by the ``node`` label, else by the host part of ``instance``; unknown nodes drop the row."""
    node, instance = F.coalesce("node", F.lit("")), F.coalesce("instance", F.lit(""))
    alias = F.when(node != "", node).otherwise(host_of(instance))
    # Sides are sorted by their first key: names tell more rows apart than clusters do.
    found = points.withColumn("alias", alias).join(aliases, ["alias", "cluster_uuid"])
    return found.select("cluster_uuid", *[c for c in found.columns if c not in ("alias", "cluster_uuid")])


def lookup_pods(points: DataFrame, pods: DataFrame) -> DataFrame:
    """Add ``pod_uuid`` by (cluster, namespace, pod); no pod label or an unknown pod drops the row."""
    known = pods.select("cluster_uuid", "namespace", F.col("name").alias("pod"), F.col("uuid").alias("pod_uuid"))
    key = ["pod", "namespace", "cluster_uuid"]
    found = points.filter(F.coalesce("pod", F.lit("")) != "").join(known, key)
    return found.select(*reversed(key), *[c for c in found.columns if c not in key])


def stale_keys(warmed: DataFrame, current: DataFrame) -> DataFrame:
    """Stored (key, uuid) that are gone, or whose key now belongs to another uuid."""
    now = current.select("key", F.col("uuid").alias("now_uuid"))
    return warmed.join(now, "key", "left").filter(
        F.col("now_uuid").isNull() | (F.col("now_uuid") != F.col("uuid"))).select("key", "uuid")


def orphan_incidents(incidents: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Incidents whose object is in none of the tables; ``incidents`` has uuid and resource."""
    known = None
    for kind, df in tables.items():
        part = df.select(F.lit(kind).alias("resource"), "uuid")
        known = part if known is None else known.unionByName(part)
    return incidents.join(known, ["resource", "uuid"], "left_anti").select(*incidents.columns)


def containers_of(containers: DataFrame, pods: DataFrame) -> DataFrame:
    """Containers of the given pods (column ``pod_uuid``)."""
    return containers.join(pods.select("pod_uuid").distinct(), "pod_uuid", "left_semi")


def resources_by_label(resource_labels: DataFrame, labels: DataFrame, name: str, value: str) -> DataFrame:
    """Resources that carry a label: the filter runs on the labels before the join."""
    wanted = labels.filter((F.col("name") == name) & (F.col("value") == value)).select(F.col("uuid").alias("label_uuid"))
    return resource_labels.join(wanted, "label_uuid", "left_semi").select("resource_uuid")


def owner_roots(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Follow controlling owners upwards to the end of the chain, however long it is.

    ``objects``: uuid; ``edges``: child_uuid, owner_uuid, kind, with one controlling owner per child. Owners are resolved
    among themselves first, so that the many objects of one popular owner join only once: each round lets every owner
    point twice as far, until none can go on. Objects below a cycle have no root: ``root_uuid`` and ``hops`` are NULL.
    Rounds are checkpointed, for their number is only known at run time.
    """
    spark = edges.sparkSession
    spark.sparkContext.setCheckpointDir(shared_folder(spark))
    owners = edges.select(F.col("owner_uuid").alias("child_uuid")).distinct()
    far = edges.join(owners, "child_uuid", "left_semi").select(
        "child_uuid", F.col("owner_uuid").alias("root_uuid"), F.col("kind").alias("root_kind"), F.lit(1).cast("bigint").alias("hops")).checkpoint()
    longest = far.count()  # no chain without a cycle has more steps than there are owners with an owner
    reached = 1
    while True:
        up = far.select(F.col("child_uuid").alias("root_uuid"), F.col("root_uuid").alias("_up"), F.col("root_kind").alias("_kind"),
                        F.col("hops").alias("_hops"))
        going = far.join(up.select("root_uuid"), "root_uuid", "left_semi")
        if reached > longest or going.isEmpty():
            break
        far = far.join(up, "root_uuid", "left").select(
            "child_uuid", F.coalesce("_up", "root_uuid").alias("root_uuid"), F.coalesce("_kind", "root_kind").alias("root_kind"),
            (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops")).checkpoint()
        reached *= 2
    endless = going.select("child_uuid", F.lit(True).alias("_endless"))
    ends = far.join(endless, "child_uuid", "left").select(
        F.col("child_uuid").alias("owner_uuid"), "root_uuid", "root_kind", "hops", F.coalesce("_endless", F.lit(False)).alias("_endless"))
    own = objects.select(F.col("uuid").alias("child_uuid")).join(edges.select("child_uuid", "owner_uuid", "kind"), "child_uuid", "left")
    stop = F.coalesce("_endless", F.lit(False))
    return own.join(ends, "owner_uuid", "left").select(
        F.col("child_uuid").alias("uuid"),
        F.when(~stop, F.coalesce("root_uuid", "owner_uuid", "child_uuid")).alias("root_uuid"),
        F.when(~stop, F.coalesce("root_kind", "kind")).alias("root_kind"),
        F.when(~stop, F.coalesce("hops", F.lit(0)) + F.col("owner_uuid").isNotNull().cast("int")).cast("int").alias("hops"))


def claim_links(pod_pvcs: DataFrame, pods: DataFrame, claims: DataFrame, claim_refs: DataFrame) -> DataFrame:
    """Pod volume -> claim of the same namespace -> bound volume, with the volume's reference back to the claim."""
    placed = pod_pvcs.join(
        pods.select(F.col("uuid").alias("pod_uuid"), "cluster_uuid", "namespace"), "pod_uuid")
    bound = claims.select("cluster_uuid", "namespace", F.col("name").alias("claim_name"),
                          F.col("uuid").alias("pvc_uuid"), F.col("uid").alias("pvc_uid"), "volume_name")
    back = claim_refs.select(F.col("uid").alias("pvc_uid"), "persistent_volume_uuid")
    return (
        placed.join(bound.withColumnRenamed("volume_name", "bound_volume"), ["cluster_uuid", "namespace", "claim_name"])
        .join(back, "pvc_uid", "left")
        .select("pod_uuid", "volume_name", "claim_name", "pvc_uuid", "bound_volume", "persistent_volume_uuid")
    )


def events_with_reference(events: DataFrame, objects: DataFrame) -> DataFrame:
    """Events with the name of the object they are about, kept when that object is unknown."""
    about = objects.select(F.col("uuid").alias("reference_uuid"), F.col("name").alias("object_name"),
                           F.col("namespace").alias("object_namespace"))
    return events.join(about, "reference_uuid", "left")
