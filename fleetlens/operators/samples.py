"""Metric samples on a minute grid: newest value per series, and rate of counters.

Samples have ``cluster_uuid, metric, labels (map), ts, value``, or ``series_id`` in the place of labels when they come
from the stored layout, whose dictionary (``cluster_uuid, series_id, labels``) is then given beside them. A series is a
set of labels of one metric in one cluster; its id has 128 bits whatever the labels, and is what samples are shuffled and
sorted by. A grid step ``t`` sees the samples of the half-open window before it, ``(t - window, t]``; time is first cut
into minute slices ``(e - 1m, e]``. Raw samples are shuffled once, by series; slices, the windows over them and the
match of two metrics of equal labels all follow in the same partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP_SECONDS = 60
#: How long a gauge value stays current.
LOOKBACK_MINUTES = 5


def minute_bucket(ts: Column) -> Column:
    """Start of the minute."""
    return F.date_trunc("minute", ts)


def minute_bucket_ms(ts: Column) -> Column:
    ms = F.unix_millis(ts)
    return ms - F.pmod(ms, F.lit(STEP_SECONDS * 1000))


def slice_end(ts: Column) -> Column:
    """First whole minute at or after an instant."""
    return F.timestamp_seconds(_minute_index(ts) * STEP_SECONDS)


def _minute_index(ts: Column) -> Column:
    """Number of the first whole minute at or after an instant; slices are handled as plain numbers."""
    return F.ceil(F.unix_micros(ts) / F.lit(STEP_SECONDS * 1000000).cast("bigint"))


def series_id(labels: Column) -> Column:
    """128 bits that tell label sets apart, the same on every engine: MD5 of the sorted entries."""
    entry = F.transform(F.sort_array(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("\u001f"), F.coalesce(e["value"], F.lit(""))))
    return F.unhex(F.md5(F.array_join(entry, "\u001e")))


def label_of(name: str) -> Column:
    """Value of a label, empty text when the sample does not have it."""
    return F.coalesce(F.try_element_at("labels", F.lit(name)), F.lit(""))


def matches(samples: DataFrame, metric: str | list[str], equal: dict[str, str] | None = None,
            not_regex: dict[str, str] | None = None) -> DataFrame:
    """Samples of a metric whose labels equal given texts and do not match given (fully anchored) patterns."""
    names = [metric] if isinstance(metric, str) else metric
    picked = samples.filter(F.col("metric").isin(names) if len(names) > 1 else F.col("metric") == names[0])
    for name, text in (equal or {}).items():
        picked = picked.filter(label_of(name) == text)
    for name, pattern in (not_regex or {}).items():
        picked = picked.filter(~label_of(name).rlike(f"^(?:{pattern})$"))
    return picked


def _rise(values: Column) -> Column:
    """Sum of increases over consecutive values; a fall means the counter began anew, so the new value is the rise."""
    before, after = F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values))
    rises = F.zip_with(before, after, lambda a, b: F.when(b < a, b).otherwise(b - a))
    return F.aggregate(rises, F.lit(0.0), lambda acc, x: acc + x)


def label_column(name: str) -> str:
    """Column of :func:`series_steps` that holds a label."""
    return f"l_{name}"


def _labelled(labels: Sequence[str]) -> list[Column]:
    return [label_of(name).alias(label_column(name)) for name in labels]


def _part() -> Column:
    """What a slice of a counter's points comes to: first and last point, their number, and the rise between them."""
    # Of several values at one instant the largest stays.
    single = F.filter("_points", lambda p, i: (i == F.size("_points") - 1) | (F.try_element_at("_points", i + 2)["t"] != p["t"]))
    return F.transform(F.array(single), lambda ps: F.struct(
        F.col("slice").alias("slice"), F.element_at(ps, 1).alias("first"), F.element_at(ps, -1).alias("last"), F.size(ps).alias("n"),
        _rise(F.transform(ps, lambda p: p["v"])).alias("rise")))[0]


def _rate(window_minutes: int) -> Column:
    """Per-second rise over the parts that the window of a step holds; NULL for fewer than two samples."""
    def over(parts: Column) -> Column:
        first, last = F.element_at(parts, 1)["first"], F.element_at(parts, -1)["last"]
        inside = F.aggregate(parts, F.lit(0.0), lambda acc, part: acc + part["rise"])
        # Rise from the last sample of each slice to the first of the next.
        heads, tails = F.slice(parts, 1, F.size(parts) - 1), F.slice(parts, 2, F.size(parts))
        between = F.aggregate(
            F.zip_with(heads, tails, lambda a, b: F.when(b["first"]["v"] < a["last"]["v"], b["first"]["v"])
                       .otherwise(b["first"]["v"] - a["last"]["v"])),
            F.lit(0.0), lambda acc, x: acc + x)
        n = F.aggregate(parts, F.lit(0), lambda acc, part: acc + part["n"])
        return F.when(n >= 2, (inside + between) / ((last["t"] - first["t"]) / F.lit(1000000.0)))

    held = F.filter("_parts", lambda p: p["slice"] > F.col("_minute") - window_minutes)
    return F.transform(F.array(held), lambda parts: F.when(F.size(parts) > 0, over(parts)))[0]


def series_spans(
    samples: DataFrame, labels: Sequence[str] = (), gauges: Sequence[str] = (), counters: Sequence[str] = (),
    windows: Sequence[int] = (), lookback_minutes: int = LOOKBACK_MINUTES, series: DataFrame | None = None,
    single: Column | None = None, dealt_by: Sequence[str] = (),
) -> DataFrame:
    """Values of every series with the minutes they are visible at: cluster_uuid, series_id, labels (``l_..``), metric, first and
    last (minute numbers), and for gauges ``value``, for counters ``rate1, rate2, ..`` by window in minutes (NULL for the other
    sort).

    A gauge's value is visible from the end of its minute until the next minute with a value, at most for the lookback; it
    stays one row, whatever the number of minutes. A counter's slice counts for the steps whose window holds it, and has a
    row for each; so have the series that ``single`` (a test of ``metric``) holds for. Of several values at one instant
    the largest counts. Counters' points are gathered per series and minute as a set, so repeats vanish.

    ``dealt_by`` names labels that samples are dealt by, with their cluster, in the place of the whole series, where what
    follows is added or looked up by these; not for stored samples, which have no labels yet.
    """
    counter = F.col("metric").isin(list(counters)) if counters else F.lit(False)
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    # The id leads: rows are sorted by the first bytes of their key, and those of a cluster's uuid tell few rows apart.
    key = ["series_id", "cluster_uuid"]
    names = [label_column(name) for name in labels]
    if series is None:
        carried = names
        tagged = samples.select("cluster_uuid", series_id(F.col("labels")).alias("series_id"), "metric", *_labelled(labels), "ts", "value")
    else:
        carried, tagged = [], samples.select(*key, "metric", "ts", "value")
    places = [label_column(name) for name in dealt_by]
    dealt = tagged.select(*key, "metric", *carried, _minute_index(F.col("ts")).alias("slice"), t.alias("t"), "value").repartition(
        *([*places, "cluster_uuid"] if places else key))
    history = Window.partitionBy(*key, *places, "metric").orderBy("slice")
    longest = max(windows, default=1)
    columns = [*key, *names, "metric", "slice"]
    if counters:
        found = [F.max(F.struct("t", "value")).alias("_newest")] if gauges else []
        points = F.collect_set(F.when(counter, F.struct(F.col("t"), F.col("value").alias("v"))))
        found.append(F.array_sort(points).alias("_points"))
        slices = dealt.groupBy(*key, "metric", "slice", *carried).agg(*found)
    else:
        # In the order of time the newest of a slice is what another slice, or nothing, follows.
        order = Window.partitionBy(*key, *places, "metric").orderBy("slice", "t", "value")
        followed = F.lead(F.lit(True)).over(order).alias("_followed")
        slices = dealt.select("*", F.lead("slice").over(order).alias("_next"), followed).filter(
            F.col("_followed").isNull() | ~F.col("_next").eqNullSafe(F.col("slice")))
    if series is not None:
        slices = slices.join(series.select(*key, *_labelled(labels)), key)
    if counters:
        slices = slices.withColumn("_part", F.when(counter, _part()))
        columns += [F.lead("slice").over(history).alias("_next"), F.collect_list("_part").over(history.rowsBetween(1 - longest, 0)).alias("_parts")]
        if gauges:
            columns.append(F.col("_newest.value").alias("_value"))
    else:
        columns += ["_next", F.col("value").alias("_value")]
    seen = F.when(counter, F.lit(longest)).otherwise(F.lit(lookback_minutes)) if counters and gauges else F.lit(longest if counters else lookback_minutes)
    spans = slices.select(*columns).withColumn("_until", F.least(F.col("slice") + seen - 1, F.col("_next") - 1))
    whole = F.struct(F.col("slice").alias("first"), F.col("_until").alias("last"))
    each = F.transform(F.sequence("slice", "_until"), lambda m: F.struct(m.alias("first"), m.alias("last")))
    if gauges and (counters or single is not None):
        spans = spans.select("*", F.inline(F.when(counter | (F.lit(False) if single is None else single), each).otherwise(F.array(whole))))
    else:
        spans = spans.select("*", F.inline(each)) if counters else spans.select("*", "slice", "_until").toDF(*spans.columns, "first", "last")
    spans = spans.withColumn("_minute", F.col("last"))
    value = [F.when(~counter, F.col("_value")).alias("value")] if gauges else []
    rates = [F.when(counter, _rate(w)).alias(f"rate{w}") for w in windows] if counters else []
    return spans.select("cluster_uuid", "series_id", *names, "metric", "first", "last", *value, *rates)


def minutes_of(first: str = "first", last: str = "last") -> Column:
    """The minutes of a span, as rows."""
    return F.explode(F.sequence(F.col(first), F.col(last)))


def minute_number(step: Column) -> Column:
    """Number of a grid step."""
    return _minute_index(step)


def minute_time(minute: Column) -> Column:
    """Instant of a minute number."""
    return F.timestamp_seconds(minute * STEP_SECONDS)


def series_steps(
    samples: DataFrame, labels: Sequence[str] = (), gauges: Sequence[str] = (), counters: Sequence[str] = (),
    windows: Sequence[int] = (), lookback_minutes: int = LOOKBACK_MINUTES, series: DataFrame | None = None,
) -> DataFrame:
    """:func:`series_spans` with a row for every grid step (``step``, an instant) instead of ``first`` and ``last``."""
    spans = series_spans(samples, labels, gauges, counters, windows, lookback_minutes, series)
    stepped = spans.withColumn("_minute", minutes_of())
    kept = [c for c in spans.columns if c not in ("first", "last")]
    at = kept.index("metric") + 1
    return stepped.select(*kept[:at], minute_time(F.col("_minute")).alias("step"), *kept[at:])


def instant(
    samples: DataFrame, metrics: list[str], labels: Sequence[str] = (), lookback_minutes: int = LOOKBACK_MINUTES
) -> DataFrame:
    """Newest value per series and grid step, one column ``v0, v1, ..`` per metric (NULL when it has none).

    Several metrics of equal label sets are matched by grouping instead of joining. ``labels`` become columns.
    """
    steps = series_steps(samples, labels, gauges=metrics, lookback_minutes=lookback_minutes)
    series = ["cluster_uuid", "series_id", *[F.col(label_column(name)).alias(name) for name in labels]]
    if len(metrics) == 1:
        return steps.select(*series, "step", F.col("value").alias("v0"))
    matched = steps.groupBy("cluster_uuid", "series_id", *map(label_column, labels), "step").agg(*[
        F.max(F.when(F.col("metric") == m, F.col("value"))).alias(f"v{i}") for i, m in enumerate(metrics)])
    return matched.select(*series, "step", *[f"v{i}" for i in range(len(metrics))])


def instant_at(samples: DataFrame, at, lookback_minutes: int = LOOKBACK_MINUTES) -> DataFrame:
    """Newest value per series at one point in time; the time bound reaches the scan."""
    end = F.lit(at).cast("timestamp")
    recent = samples.filter((F.col("ts") <= end) & (F.col("ts") > end - F.expr(f"INTERVAL {lookback_minutes} MINUTES")))
    return recent.groupBy("cluster_uuid", "metric", series_id(F.col("labels")).alias("series_id")).agg(
        F.max_by("value", F.struct("ts", "value")).alias("v0")).withColumn("step", end)


def counter_rate(samples: DataFrame, window_minutes: int, labels: Sequence[str] = ()) -> DataFrame:
    """Per-second rise of each counter series over the window before each grid step; all ``samples`` are of counters.

    Fewer than two samples in a window give no row.
    """
    names = samples.withColumn("metric", F.lit("counter"))
    steps = series_steps(names, labels, counters=["counter"], windows=[window_minutes])
    return steps.filter(F.col(f"rate{window_minutes}").isNotNull()).select(
        "cluster_uuid", "series_id", *[F.col(label_column(name)).alias(name) for name in labels], "step",
        F.col(f"rate{window_minutes}").alias("v0"))


def divide(left: Column, right: Column) -> Column:
    """Floating division that gives NaN or an infinity for a zero divisor instead of failing."""
    by_zero = F.when(left == 0, F.lit(float("nan"))).when(left > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(right == 0, by_zero).otherwise(F.try_divide(left, right))


def drop_nan(points: DataFrame, column: str = "value") -> DataFrame:
    return points.filter(F.col(column).isNotNull() & ~F.isnan(column))
