"""Alert records, rule matching and closing records of orphaned incidents."""

from __future__ import annotations

import contextlib
import itertools
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from fleetlens import schemas
from fleetlens.functions.objects import alert_url
from fleetlens.functions.states import severity_of_name
from fleetlens.functions.text import null_if_empty, object_name
from fleetlens.operators.links import orphan_incidents
from fleetlens.session import shared_folder

# Kinds that raise alerts, the rule format understood, how often matching starts again, and the closing message.
ALERT_KINDS = ["pod", "node", "deployment", "daemon_set", "replica_set", "stateful_set"]
RULE_VERSION = 1
RULE_TRIES = 3
CLOSING_MESSAGE = "Automatically resolving the incident because of an orphaned resource."

#: kind -> function(DataFrame) -> alert rows; users register their own kinds here.
MARSHALERS: dict = {}


def tags(uuid: Column, cluster_uuid: Column, name: Column, namespace: Column, resource: Column) -> Column:
    return F.create_map(
        F.lit("uuid"), uuid, F.lit("cluster_uuid"), cluster_uuid, F.lit("name"), name, F.lit("namespace"), namespace,
        F.lit("resource"), resource)


def to_alert(kind: str, df: DataFrame, base_url: str = "/") -> DataFrame:
    """Alert records of normalised rows with ``health_state`` and ``health_reason``."""
    if kind in MARSHALERS:
        return MARSHALERS[kind](df)
    namespace = F.coalesce(F.col("namespace"), F.lit(""))
    return df.select(
        "uuid", "cluster_uuid", F.lit(kind).alias("kind"),
        F.concat(namespace, F.lit("/"), F.col("name")).alias("name"),
        severity_of_name(F.col("health_state")).alias("severity"), F.col("health_reason").alias("message"),
        alert_url(base_url, F.lit(kind), F.col("uuid")).alias("url"),
        tags(F.col("uuid"), F.col("cluster_uuid"), F.col("name"), namespace, F.lit(kind)).alias("tags"),
        F.lit(None).cast("map<string,string>").alias("extra_tags"),
    )


def alert_stream(tables: dict[str, DataFrame], base_url: str = "/") -> DataFrame:
    """Alert records of every kind that raises alerts."""
    merged = None
    for kind in [*ALERT_KINDS, *MARSHALERS]:
        if kind in tables:
            part = to_alert(kind, tables[kind], base_url)
            merged = part if merged is None else merged.unionByName(part)
    return merged


def alert_records(alerts: DataFrame) -> DataFrame:
    """The columns an alert is sent with."""
    return alerts.select("name", "severity", "message", "url", "tags", "extra_tags")


def parse_rules(rules: DataFrame) -> DataFrame:
    """(id, filter JSON) -> id, always (empty filter), version, kind, query, args."""
    body = F.from_json(null_if_empty(F.col("filter")), schemas.RULE_FILTER)
    return rules.select("id", (F.coalesce("filter", F.lit("")) == "").alias("always"), body.alias("r")).select(
        "id", "always", "r.version", "r.kind", "r.query", "r.args")


OBJECT_ARGUMENTS = (":uuid", ":cluster_uuid")


def _bound(query: str, objects: dict[int, str]) -> tuple[str, int]:
    """A rule's query with columns in the place of its question marks (outside quoted text), and how many there were.

    ``objects`` names the object's argument by position; the others are the rule's own, a column each.
    """
    places = itertools.count()

    def column(_match) -> str:
        i = next(places)
        return f"_alert.{objects[i][1:]}" if i in objects else f"_rule.a{i}"

    quoted = re.split(r"('(?:[^'\\]|\\.)*')", query)
    text = "".join(part if i % 2 else re.sub(r"\?", column, part) for i, part in enumerate(quoted))
    return text, next(places)


@contextlib.contextmanager
def _views(spark: SparkSession, tables: dict[str, DataFrame]):
    """A WITH clause that gives tables their names inside one statement, whatever views of the user have these names."""
    made = {name: f"v_{uuid.uuid4().hex}" for name in tables}
    for name, view in made.items():
        tables[name].createOrReplaceTempView(view)
    try:
        yield "WITH " + ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in made.items())
    finally:
        for view in made.values():
            spark.catalog.dropTempView(view)


@contextlib.contextmanager
def _lenient(spark: SparkSession):
    """Expressions analysed meanwhile give NULL where a value cannot be cast or computed, instead of failing the job."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def match_rules(
    spark: SparkSession, alerts: DataFrame, rules: DataFrame, tables: dict[str, DataFrame], rules_version: str = ""
) -> DataFrame:
    """Add ``rule_ids`` and ``rules_version`` to alerts.

    A rule without filter matches every alert. Any other rule holds a SELECT with placeholders, for the object and for
    arguments of its own, and matches an object if it yields a row. Rules of one text are one branch: their arguments are a
    table, joined with the query and all alerts of the kind at once, so the plan grows with the distinct texts (which are
    what the driver sees of the rules) and not with the rules.

    A rule that cannot be read (or has another version) leaves all alerts without rules, a text that cannot be
    analysed or has too few arguments those of its kind. An argument that does not fit its place matches nothing and
    leaves the other rules as they are.
    """
    parsed = parse_rules(rules).withColumn("args", F.coalesce("args", F.array().cast("array<string>")))
    own = parsed.filter(~F.col("always"))
    none = F.array().cast("array<string>")
    objects = F.filter(F.transform("args", lambda a, i: F.when(a.isin(*OBJECT_ARGUMENTS), F.concat(i.cast("string"), a))), lambda a: a.isNotNull())
    shaped = own.withColumn("shape", F.struct("version", "kind", "query", objects.alias("objects"), F.size("args").alias("n")))
    shapes = [r["shape"] for r in shaped.select("shape").distinct().collect()]
    if any(r.version != RULE_VERSION for r in shapes):
        return alerts.withColumn("rule_ids", none).withColumn("rules_version", F.lit(rules_version))
    hit, failed = None, set()
    for shape in sorted(shapes, key=str):
        given = {int(i): f":{name}" for i, name in (x.split(":") for x in shape.objects)}
        try:
            text, n = _bound(shape.query or "", given)
            if n > shape.n:
                raise ValueError(f"{n} places, {shape.n} arguments")
            like = shaped.filter(F.col("shape") == F.struct(
                F.lit(shape.version).alias("version"), F.lit(shape.kind).alias("kind"), F.lit(shape.query).alias("query"),
                F.array(*map(F.lit, shape.objects)).cast("array<string>").alias("objects"), F.lit(shape.n).alias("n")))
            rule = like.select(F.col("id").alias("rule_id"), *[F.col("args")[i].alias(f"a{i}") for i in range(n) if i not in given])
            alone = len(rule.columns) == 1  # no arguments of their own: what one such rule matches they all match
            alert = alerts.filter(F.col("kind") == shape.kind).select("uuid", "cluster_uuid", "kind").distinct()
            with _lenient(spark), _views(spark, {**tables, "_alert": alert, "_rule": rule}) as named:
                # inner joins, which Catalyst puts in an order that follows the query's equalities
                found = spark.sql(
                    f"{named} SELECT uuid, kind FROM _alert WHERE EXISTS ({text})" if alone else
                    f"{named} SELECT _alert.uuid, _alert.kind, _rule.rule_id FROM _alert JOIN _rule JOIN LATERAL ({text})")
            if alone:
                ids = like.agg(F.collect_set("id")).scalar()
                found = found.withColumn("_ids", ids).select("uuid", "kind", F.explode("_ids").alias("rule_id"))
        except (AnalysisException, ValueError):
            failed.add(shape.kind)
            continue
        if shape.kind not in failed:
            hit = found if hit is None else hit.unionByName(found)
    always = F.coalesce(parsed.filter("always").agg(F.collect_set("id").alias("ids")).scalar(), none)
    result = alerts
    if hit is not None:
        gathered = hit.groupBy("uuid", "kind").agg(F.collect_set("rule_id").alias("_ids"))
        result = result.join(gathered, ["uuid", "kind"], "left")
    else:
        result = result.withColumn("_ids", none)
    ids = F.sort_array(F.concat(always, F.coalesce("_ids", none)))
    if failed:
        ids = F.when(F.col("kind").isin(list(failed)), none).otherwise(ids)
    return result.select(*alerts.columns, ids.alias("rule_ids"), F.lit(rules_version).alias("rules_version"))


def match_current_rules(
    spark: SparkSession, alerts: DataFrame, rules: Callable[[], tuple[DataFrame, dict[str, DataFrame], str]], tries: int = RULE_TRIES
) -> DataFrame:
    """:func:`match_rules` with the rules as they are when the matching is over.

    ``rules`` gives (rules, tables they query, rules version). The result is written to the checkpoint folder; if the
    version has changed meanwhile, matching starts again, ``tries`` times at most. What then is still outdated
    raises: no alert goes out with rules that no longer hold.
    """
    shared_folder(spark)
    for _ in range(1 + tries):
        found, tables, version = rules()
        matched = match_rules(spark, alerts, found, tables, version).checkpoint()
        if rules()[2] == version:
            return matched
    raise RuntimeError(f"the rules changed {1 + tries} times while they were matched")


def orphan_alerts(incidents: DataFrame, tables: dict[str, DataFrame], base_url: str = "/") -> DataFrame:
    """Closing records for incidents whose object is gone."""
    gone = orphan_incidents(incidents.dropDuplicates(["uuid"]), tables)
    cluster = null_if_empty(F.col("cluster_uuid"))
    pairs = [("uuid", F.col("uuid")), ("cluster_uuid", cluster), ("name", F.col("name")),
             ("namespace", F.col("namespace")), ("resource", F.col("resource"))]
    every = F.create_map(*[x for key, column in pairs for x in (F.lit(key), column)])
    kept = F.map_filter(every, lambda key, value: ~((key == "cluster_uuid") & value.isNull()))
    return gone.select(
        "uuid", cluster.alias("cluster_uuid"), F.col("resource").alias("kind"),
        object_name(F.col("namespace"), F.col("name")).alias("name"), F.lit("ok").alias("severity"),
        F.lit(CLOSING_MESSAGE).alias("message"), alert_url(base_url, F.col("resource"), F.col("uuid")).alias("url"),
        kept.alias("tags"), F.lit(None).cast("map<string,string>").alias("extra_tags"))
