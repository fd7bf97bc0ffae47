"""The fixed catalogue of metric queries, as data, and the few shapes they are evaluated with."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.ids import uuid5
from fleetlens.operators import samples as S
from fleetlens.operators.links import lookup_nodes, lookup_pods

# Label patterns left out of processor and network queries.
IDLE_MODES = "idle|iowait|steal"
VIRTUAL_DEVICES = "(veth|azv|lxc).*"


@dataclass(frozen=True)
class MetricQuery:
    """One stored metric: which samples it reads, how they are shaped, and under which name it is stored."""

    scope: str
    category: str
    shape: str
    metric: str
    by: tuple[str, ...] = ()
    equal: dict[str, str] = field(default_factory=dict)
    not_regex: dict[str, str] = field(default_factory=dict)
    window_minutes: int = 0
    sign: int = 1
    other: str = ""
    inner_by: tuple[str, ...] = ()
    name_label: str = ""

    @property
    def key(self) -> str:
        return f"m_{self.scope}_{self.category.replace('.', '_')}"


def _queries() -> list[MetricQuery]:
    q = MetricQuery
    phase, request, limit = "kube_pod_status_phase", "kube_pod_container_resource_requests", "kube_pod_container_resource_limits"
    total, available = "node_memory_MemTotal_bytes", "node_memory_MemAvailable_bytes"
    receive, transmit = "node_network_receive_bytes_total", "node_network_transmit_bytes_total"
    node_cpu, pod_cpu, pod_memory = (
        "node_cpu_seconds_total", "container_cpu_usage_seconds_total", "container_memory_usage_bytes")
    busy, physical = {"mode": IDLE_MODES}, {"device": VIRTUAL_DEVICES}
    found = [
        q("cluster", "node.count", "count_groups", "kube_node_info", inner_by=("node",)),
        q("cluster", "namespace.count", "count", "kube_namespace_created"),
        *[q("cluster", f"pod.{name.lower()}", "sum", phase, equal={"phase": name})
          for name in ("Running", "Pending", "Failed", "Succeeded")],
        q("cluster", "cpu.usage", "rate_avg", node_cpu, not_regex=busy, window_minutes=1, inner_by=("instance", "cpu")),
        q("cluster", "memory.usage", "used_share", total, other=available),
        q("cluster", "qos_by_class", "sum", "kube_pod_status_qos_class", by=("qos_class",)),
        q("cluster", "network.received.bytes", "rate", receive, by=("device",), not_regex=physical, window_minutes=2),
        q("cluster", "network.transmitted.bytes", "rate", transmit, by=("device",), not_regex=physical,
          window_minutes=2, sign=-1),
        q("cluster", "network.received.bytes.bydevice", "rate", receive, by=("device",), not_regex=physical,
          window_minutes=2, name_label="device"),
        q("node", "cpu.usage", "rate_avg", node_cpu, by=("node",), not_regex=busy, window_minutes=2,
          inner_by=("node", "cpu")),
        q("node", "memory.usage", "used_share", total, by=("instance",), other=available),
        q("node", "network.received.bytes", "rate", receive, by=("node",), window_minutes=2),
        q("node", "network.transmitted.bytes", "rate", transmit, by=("node",), window_minutes=2, sign=-1),
        q("node", "filesystem.usage", "filled_share", "node_filesystem_avail_bytes", by=("node", "mountpoint"),
          other="node_filesystem_size_bytes", name_label="mountpoint"),
        q("pod", "cpu.usage", "rate", pod_cpu, by=("instance", "namespace", "pod"), window_minutes=2),
        q("pod", "memory.usage", "share_of_node", pod_memory, by=("instance", "namespace", "pod"), other=total),
        q("pod", "cpu.usage.cores", "rate", pod_cpu, by=("namespace", "pod"), window_minutes=2),
        q("pod", "memory.usage.bytes", "sum", pod_memory, by=("namespace", "pod")),
    ]
    levels = {
        "node": ("node",), "pod": ("node", "namespace", "pod"), "container": ("node", "namespace", "pod", "container"),
    }
    for scope, by in levels.items():
        for resource, capacity in (("cpu", "machine_cpu_cores"), ("memory", "machine_memory_bytes")):
            for what, metric in (("request", request), ("limit", limit)):
                found.append(q(scope, f"{resource}.{what}", "sum", metric, by=by, equal={"resource": resource}))
                found.append(q(scope, f"{resource}.{what}.percentage", "share_of_capacity", metric, by=by,
                               equal={"resource": resource}, other=capacity))
    return found


QUERIES: dict[str, MetricQuery] = {query.key: query for query in _queries()}


# --- evaluation: samples -> sums by labels, once for all queries -> (cluster_uuid, block, labels.., points) ---------

@dataclass(frozen=True)
class Sums:
    """Series values of a metric added up by labels; several queries can be made from the same one.

    ``measure`` says what is added: the newest "value", a "rate", what is "used" of a total (with the total beside it), or
    the "filled" share, the last two of series that two metrics share.
    """

    metric: str
    by: tuple[str, ...]
    measure: str = "value"
    other: str = ""
    equal: tuple[tuple[str, str], ...] = ()
    not_regex: tuple[tuple[str, str], ...] = ()
    window: int = 0

    @property
    def key(self) -> int:
        """A number that stands for these sums in rows."""
        return zlib.crc32(repr(self).encode())

    @property
    def labels(self) -> set[str]:
        return {*self.by, *(n for n, _ in self.equal), *(n for n, _ in self.not_regex)}

    def accepts(self, label) -> Column:
        """Whether a series' labels (``label(name)`` gives one) are those asked for."""
        found = F.lit(True)
        for name, text in self.equal:
            found = found & (label(name) == text)
        for name, pattern in self.not_regex:
            found = found & ~label(name).rlike(f"^(?:{pattern})$")
        return found


RATED = {"rate", "rate_avg"}
SHARES = {"share_of_capacity", "share_of_node"}


def sums_of(query: MetricQuery) -> list[Sums]:
    """What a query is made from; for shares the numerator first, then what it is a share of, by node."""
    matchers = {"equal": tuple(query.equal.items()), "not_regex": tuple(query.not_regex.items())}
    if query.shape in RATED:
        return [Sums(query.metric, query.inner_by or query.by, "rate", window=query.window_minutes, **matchers)]
    if query.shape in ("used_share", "filled_share"):
        return [Sums(query.metric, query.by, query.shape.partition("_")[0], query.other, **matchers)]
    first = Sums(query.metric, query.inner_by or query.by, **matchers)
    return [first, Sums(query.other, ("node",))] if query.shape in SHARES else [first]


def sums(queries: Sequence[MetricQuery], samples: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """All sums that queries need from one scan of the samples: cluster_uuid, block, sums (its key), by (label values), meet, and
    points (minute, x: the sum, total: of "used", n: series), those of one block of ``BLOCK`` minutes at most.

    Every value of a series is handed to the sums it belongs to, the levels of a roll-up among them, with the minutes it is
    visible at. Values travel as such spans and become minutes only where they are added; sums over many entities are
    added on the map side first, by equal spans. ``meet`` is the node by which a share meets what it is a share of: both
    are dealt by it, so that they are added in the partition they meet in. ``series`` is the dictionary of stored samples.
    Samples that come with their labels and are all for pods or containers are dealt by pod at once (:func:`of_pods`), added there
    and found with the pod's labels (``l_..``) beside the other columns.
    """
    wanted = list(dict.fromkeys(s for q in queries for s in sums_of(q)))
    if len({s.key for s in wanted}) < len(wanted):
        raise ValueError("two sums have one key")
    pairs = {s.other: s.metric for s in wanted if s.other}
    counters = sorted({s.metric for s in wanted if s.measure == "rate"})
    gauges = sorted({m for s in wanted if s.measure != "rate" for m in (s.metric, s.other) if m})
    windows = sorted({s.window for s in wanted if s.window})
    names = sorted({name for s in wanted for name in s.labels})
    picked = samples.filter(F.col("metric").isin([*counters, *gauges]))
    if series is None:
        asked = F.lit(False)
        for s in wanted:
            asked = asked | (F.col("metric").isin([m for m in (s.metric, s.other) if m]) & s.accepts(S.label_of))
        picked = picked.filter(asked)
    second = F.col("metric").isin(list(pairs))
    paired = F.col("metric").isin([*pairs, *pairs.values()]) if pairs else None
    by_pod = POD_LABELS if series is None and of_pods(queries) else ()
    spans = S.series_spans(picked, names, gauges, counters, windows, series=series, single=paired, dealt_by=by_pod)
    held = [S.label_column(name) for name in by_pod]
    rates = [f"rate{w}" for w in windows]
    if pairs:
        # Both metrics of a pair meet in the partition their series is in.
        family = F.coalesce(*[F.when(F.col("metric") == other, F.lit(metric)) for other, metric in pairs.items()], F.col("metric"))
        spans = spans.groupBy("series_id", "cluster_uuid", *map(S.label_column, names), family.alias("metric"), "first", "last").agg(
            F.max(F.when(~second, F.col("value"))).alias("value"), F.max(F.when(second, F.col("value"))).alias("other"),
            *[F.max(r).alias(r) for r in rates])

    def entry(s: Sums) -> Column:
        x, total, there = F.col("value"), F.lit(None).cast("double"), F.lit(True)
        if s.measure == "rate":
            x = F.col(f"rate{s.window}")
            there = x.isNotNull()
        elif s.measure == "used":
            x, total = F.col("value") - F.col("other"), F.col("value")
        elif s.measure == "filled":
            there = F.col("value").isNotNull() & F.col("other").isNotNull()
            x = F.lit(1.0) - S.divide(F.col("value"), F.col("other"))
        row = F.struct(F.lit(s.key).cast("bigint").alias("sums"), F.array(*[F.col(S.label_column(n)) for n in s.by]).cast("array<string>").alias("by"),
                       x.alias("x"), total.alias("total"))
        return F.when(there & s.accepts(lambda name: F.col(S.label_column(name))), row)

    shares: Column | None = None
    for metric in dict.fromkeys(s.metric for s in wanted):
        test, rows = F.col("metric") == metric, F.array_compact(F.array(*[entry(s) for s in wanted if s.metric == metric]))
        shares = F.when(test, rows) if shares is None else shares.when(test, rows)
    handed = spans.select("cluster_uuid", *held, "first", "last", F.explode(shares).alias("_s")).select(
        "cluster_uuid", *held, "first", "last", "_s.*", F.lit(1).cast("bigint").alias("n"))
    if not all(ENTITIES & set(s.by) for s in wanted):
        handed = handed.groupBy("cluster_uuid", "sums", "by", "first", "last").agg(
            F.sum("x").alias("x"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("n"))
    places = {sums_of(q)[part].key: sums_of(q)[part].by.index(node) for q in queries if q.shape in SHARES for part, node in enumerate((MET_BY[q.shape], "node"))}
    meet = F.get(F.col("by"), _of(places, "sums", "int", "bigint"))
    dealt = handed.withColumn("meet", F.coalesce(meet, F.array_join("by", "\u001f"), F.lit("")))
    dealt = dealt if by_pod else dealt.repartition("cluster_uuid", "meet")
    # A hash of the key leads it, so that sorting seldom compares texts.
    dealt = dealt.withColumn("_hash", F.xxhash64("cluster_uuid", "sums", "by"))
    key = ["_hash", "cluster_uuid", "meet", "sums", "by", *held]
    # Equal spans first: what is left of a block is bounded by its minutes, and becomes minutes inside one row.
    spans = dealt.groupBy(*key, "first", "last").agg(F.sum("x").alias("x"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    pieces = spans.withColumn("block", F.explode(F.sequence(block_of(F.col("first")), block_of(F.col("last")), F.lit(BLOCK).cast("bigint"))))
    # By a window, which sorts once and keeps the spans as they are; an aggregate would sort and copy them twice.
    of_block = Window.partitionBy(*key, "block").orderBy("first", "last")
    span = F.struct(F.greatest("first", "block").alias("first"), F.least("last", F.col("block") + BLOCK - 1).alias("last"), "x", "total", "n")
    gathered = pieces.select(
        *key, "block", F.collect_list(span).over(of_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_spans"),
        F.row_number().over(of_block).alias("_place")).filter("_place = 1")
    return gathered.select(*key[1:], "block", _added(F.col("_spans")).alias("points"))


def _added(spans: Column) -> Column:
    """Points of all minutes that spans hold: minute, and the sums over the spans that hold it."""
    def of_one(s: Column) -> Column:
        return F.transform(F.sequence(s["first"], s["last"]), lambda m: F.struct(
            m.alias("minute"), s["x"].alias("x"), s["total"].alias("total"), s["n"].alias("n")))

    def add(a: Column, b: Column) -> Column:
        return F.coalesce(a + b, a, b)

    def of_minute(m: Column) -> Column:
        none = F.struct(m.alias("minute"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("total"), F.lit(0).cast("bigint").alias("n"))
        inside = F.filter(spans, lambda s: (s["first"] <= m) & (m <= s["last"]))
        return F.aggregate(inside, none, lambda a, s: F.struct(
            a["minute"].alias("minute"), add(a["x"], s["x"]).alias("x"), add(a["total"], s["total"]).alias("total"), (a["n"] + s["n"]).alias("n")))

    minutes = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], s["last"]))))
    # Spans that share no minute need no adding: as many minutes as the spans are long.
    length = F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    several = F.transform(F.array(minutes), lambda found: F.when(
        F.size(found) == length, F.flatten(F.transform(spans, of_one))).otherwise(F.transform(found, of_minute)))[0]
    return F.when(F.size(spans) == 1, of_one(F.element_at(spans, 1))).otherwise(several)


#: Labels that tell a pod within its cluster, in the order it is looked up by.
POD_LABELS = ("pod", "namespace")
#: Labels that leave few series to a sum: adding on the map side first would hardly make fewer rows.
ENTITIES = {"node", "instance", "pod", "container"}
#: Label by which a share's numerator meets the sum of a node.
MET_BY = {"share_of_capacity": "node", "share_of_node": "instance"}
#: Minutes whose points make one row.
BLOCK = 60


def of_pods(queries: Sequence[MetricQuery]) -> bool:
    """Whether all that queries are made from is added within pods, and nothing of it meets the sum of a node."""
    return all(q.scope in ("pod", "container") and q.shape not in SHARES and set(POD_LABELS) <= set(sums_of(q)[0].by) for q in queries)


def block_of(minute: Column) -> Column:
    """First minute of the block a minute is in."""
    return minute - F.pmod(minute, F.lit(BLOCK))


def _literal(value) -> Column:
    return F.array(*map(_literal, value)) if isinstance(value, (list, tuple)) else F.lit(value)


def _of(table: dict, key: str, type_: str, key_type: str = "string") -> Column:
    """A constant table's entry for the row's ``key``, NULL if it has none."""
    if not table:
        return F.lit(None).cast(type_)
    entries = F.create_map(*[x for k, v in table.items() for x in (F.lit(k).cast(key_type), _literal(v).cast(type_))])
    return F.try_element_at(entries, F.col(key))


def _handed(queries: Sequence[MetricQuery], part: int = 0) -> Column:
    """Keys of the queries that a row of sums is for, NULL for none."""
    takers: dict[int, list[str]] = {}
    for query in queries:
        takers.setdefault(sums_of(query)[part].key, []).append(query.key)
    return F.try_element_at(F.create_map(*[x for k, v in takers.items() for x in (F.lit(k).cast("bigint"), _literal(v))]), F.col("sums"))


def values_of(queries: Sequence[MetricQuery], found: DataFrame) -> DataFrame:
    """Values of queries from :func:`sums`: cluster_uuid, block, query (key), by (its label values), points (minute, value), and the
    labels that the sums have as columns.

    Queries of like shape are made together, so the plan does not grow with their number.
    """
    of_shape = lambda *shapes: [q for q in queries if q.shape in shapes]
    places = lambda query, names: [sums_of(query)[0].by.index(name) for name in names]
    point = lambda p, value: F.struct(p["minute"].alias("minute"), value.alias("value"))
    columns, parts = ["cluster_uuid", "block", "query", "by", "points", *_labels_in(found)], []

    def own_by(some: list[MetricQuery]) -> Column:
        at = _of({q.key: places(q, q.by) for q in some if q.by}, "query", "array<int>")
        return F.coalesce(F.transform(at, lambda i: F.get(F.col("by"), i)), F.array().cast("array<string>"))

    plain = of_shape("sum", "rate", "count", "used_share", "filled_share")
    if plain:
        shape, sign = _of({q.key: q.shape for q in plain}, "query", "string"), _of({q.key: q.sign for q in plain}, "query", "int")

        def value(p: Column) -> Column:
            used = F.when(p["x"].isNotNull() & p["total"].isNotNull(), S.divide(p["x"], p["total"]))
            return F.when(F.col("_shape") == "count", p["n"].cast("double")).when(F.col("_shape") == "used_share", used).otherwise(p["x"] * F.col("_sign"))

        handed = found.select("*", F.explode(_handed(plain)).alias("query")).select("*", shape.alias("_shape"), sign.alias("_sign"))
        parts.append(handed.withColumn("points", F.transform("points", lambda p: point(p, value(p)))).select(*columns))

    twice = of_shape("count_groups", "rate_avg")
    if twice:
        counted = _of({q.key: q.shape == "count_groups" for q in twice}, "query", "boolean")
        handed = found.select("*", F.explode(_handed(twice)).alias("query")).withColumn("by", own_by(twice))
        added = handed.select("cluster_uuid", "block", "query", "by", F.inline("points")).groupBy("cluster_uuid", "block", "query", "by", "minute").agg(
            F.count(F.lit(1)).alias("_n"), F.avg("x").alias("_avg"))
        value_ = F.when(counted, F.col("_n").cast("double")).otherwise(F.col("_avg"))
        parts.append(added.withColumn("points", F.array(F.struct("minute", value_.alias("value")))).select(*columns))

    shares = of_shape(*SHARES)
    if shares:
        # Numerators and what they are a share of meet by node; the latter is one row for each.
        def tagged(part: int) -> Column:
            takers = F.coalesce(_handed(shares, part), F.array().cast("array<string>"))
            return F.transform(takers, lambda q: F.struct(q.alias("query"), F.lit(part == 0).alias("_own")))

        handed = found.select("*", F.explode(F.concat(tagged(0), tagged(1))).alias("_q")).select(
            "cluster_uuid", "meet", "block", "by", "points", "_q.query", "_q._own")
        met = Window.partitionBy("cluster_uuid", "meet", "block", "query")
        joined = handed.withColumn("_whole", F.max(F.when(~F.col("_own"), F.col("points"))).over(met)).filter(F.col("_own") & F.col("_whole").isNotNull())
        whole = F.map_from_entries(F.transform("_whole", lambda w: F.struct(w["minute"], w["x"])))
        # Inside a lambda, so that the map is made once and not once per point.
        share = F.transform(F.array(whole), lambda of: F.transform("points", lambda p: point(p, S.divide(p["x"], F.try_element_at(of, p["minute"])))))[0]
        parts.append(joined.withColumn("points", share).withColumn("by", own_by(shares)).select(*columns))

    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    known = F.filter("points", lambda p: p["value"].isNotNull() & ~F.isnan(p["value"]))
    return merged.withColumn("points", known)


def _labels_in(rows: DataFrame) -> list[str]:
    """Label columns that rows are dealt by: naming these and not the like texts in ``by`` keeps rows where they are."""
    return [c for c in map(S.label_column, POD_LABELS) if c in rows.columns]


def evaluate(query: MetricQuery, samples: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """Values of one query: cluster_uuid, block, grouping labels, points (minute, value)."""
    values = values_of([query], sums([query], samples, series))
    held = _labels_in(values)
    label = lambda i, name: F.col(S.label_column(name)) if S.label_column(name) in held else F.col("by")[i]
    return values.select("cluster_uuid", "block", *[label(i, name).alias(name) for i, name in enumerate(query.by)], "points")


# Grouping labels that are the entity's own identity leave one series per key: nothing can collide.
_ONE_SERIES_PER_ENTITY = {("cluster", ()), ("pod", ("namespace", "pod"))}


def to_points(
    query: MetricQuery, values: DataFrame, aliases: DataFrame | None = None, pods: DataFrame | None = None,
    keep_all: bool = False,
) -> DataFrame:
    """Resolve the values of one query to entities and give stored points: entity_uuid, timestamp, category, name, value."""
    label = lambda name: F.coalesce(F.col(name), F.lit(""))
    by = F.array(*map(label, query.by)).cast("array<string>")
    held = [label(name).alias(S.label_column(name)) for name in POD_LABELS if set(POD_LABELS) <= set(query.by)]
    long = values.select("cluster_uuid", "block", F.lit(query.key).alias("query"), by.alias("by"), "points", *held)
    return points_of([query], long, aliases, pods, keep_all)


def points_of(
    queries: Sequence[MetricQuery], values: DataFrame, aliases: DataFrame | None = None, pods: DataFrame | None = None,
    keep_all: bool = False,
) -> DataFrame:
    """Resolve :func:`values_of` queries of one scope to entities: entity_uuid, timestamp, category, name, value.

    Series that fall on the same key keep one value, that of the highest label text; ``keep_all`` puts the label text
    into the name instead.
    """
    scope, = {q.scope for q in queries}

    def label(name: str) -> Column:
        if S.label_column(name) in _labels_in(values):
            return F.col(S.label_column(name))
        return F.get(F.col("by"), _of({q.key: q.by.index(name) for q in queries if name in q.by}, "query", "int"))

    names = _of({q.key: q.by for q in queries if q.by}, "query", "array<string>")
    parts = F.zip_with(names, F.col("by"), lambda name, value: F.concat(name, F.lit("="), F.coalesce(value, F.lit(""))))
    text = F.coalesce(F.array_join(parts, ","), F.lit(""))
    at = _of({q.key: q.by.index(q.name_label) for q in queries if q.name_label}, "query", "int")
    stored_name = F.coalesce(F.get(F.col("by"), at), text if keep_all else F.lit(""))
    category = _of({q.key: q.category for q in queries}, "query", "string")
    rows = values.select("cluster_uuid", "block", category.alias("category"), stored_name.alias("name"), text.alias("_text"), "points",
                         *[label(name).alias(name) for name in ENTITY_LABELS[scope]])
    if scope == "cluster":
        placed = rows.withColumn("entity_uuid", F.col("cluster_uuid"))
    elif scope == "node":
        placed = lookup_nodes(rows, aliases).withColumnRenamed("node_uuid", "entity_uuid")
    else:
        placed = lookup_pods(rows, pods)
        if scope == "pod":
            placed = placed.withColumnRenamed("pod_uuid", "entity_uuid")
    keys = ["entity_uuid", "timestamp", "category", "name"]
    single = all((q.scope, q.by) in _ONE_SERIES_PER_ENTITY for q in queries)
    place = ["pod_uuid"] if scope == "container" else []
    if not single:
        # Blocks are dealt by entity, those of containers by pod, and their points are grouped where they are.
        placed = placed.repartition(*(place or ["entity_uuid"]), "block")
    if scope == "container":
        placed = placed.withColumn("entity_uuid", uuid5(F.col("pod_uuid"), F.col("container")))
    # The outer form, as Spark tests what an inner one takes apart beforehand and so makes all points twice.
    rows = placed.select(*place, "entity_uuid", "category", "name", "block", "_text", F.inline_outer("points")).filter(F.col("minute").isNotNull())
    points = rows.withColumn("timestamp", S.minute_time(F.col("minute")))
    if single:
        return points.select(*keys, "value")
    return points.groupBy(*place, *keys, "block").agg(F.max_by("value", "_text").alias("value")).select(*keys, "value")


#: Labels that tell a scope's entities.
ENTITY_LABELS = {"cluster": (), "node": ("node", "instance"), "pod": ("namespace", "pod"), "container": ("namespace", "pod", "container")}


def metric_points(
    scope: str, samples: DataFrame | None, aliases: DataFrame | None = None, pods: DataFrame | None = None,
    keep_all: bool = False, series: DataFrame | None = None, found: DataFrame | None = None,
) -> DataFrame:
    """All points of one scope, ready to be upserted into its metric table.

    ``found`` are the :func:`sums` of all queries where they are at hand (persisted, for several scopes).
    """
    queries = [q for q in QUERIES.values() if q.scope == scope]
    found = sums(queries, samples, series) if found is None else found
    return points_of(queries, values_of(queries, found), aliases, pods, keep_all).withColumnRenamed("entity_uuid", f"{scope}_uuid")
