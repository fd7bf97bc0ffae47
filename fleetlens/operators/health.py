"""Health rules: each is one ordered chain of conditions giving a state ordinal and a reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.states import CRITICAL, OK, PENDING, UNKNOWN, WARNING, state_name
from fleetlens.functions.text import reason_message, trim_stop

# Waiting reasons with a meaning of their own.
POD_INITIALIZING = "PodInitializing"
CONTAINER_CREATING = "ContainerCreating"
ERR_IMAGE_PULL = "ErrImagePull"
IMAGE_PULL_BACK_OFF = "ImagePullBackOff"

# How instants read inside reasons.
INSTANT_FORMAT = "yyyy-MM-dd HH:mm:ss '+0000 UTC'"
NO_INSTANT = "0001-01-01 00:00:00 +0000 UTC"
RFC3339_FORMAT = "yyyy-MM-dd'T'HH:mm:ssXXX"


class Verdict:
    """Outcome of a rule chain: one struct column, so that every rule is tested once per row."""

    def __init__(self, both: Column) -> None:
        self.both = both

    @property
    def state(self) -> Column:
        return self.both["state"]

    @property
    def reason(self) -> Column:
        return self.both["reason"]


class Rules:
    """Ordered rules; the first whose test holds decides."""

    def __init__(self) -> None:
        self._rules: list[tuple[Column, Column]] = []

    @staticmethod
    def _outcome(state: int | Column, template: str, args: tuple[Column, ...]) -> Column:
        ordinal = F.lit(state) if isinstance(state, int) else state
        return F.struct(ordinal.cast("int").alias("state"), message(template, *args).alias("reason"))

    def add(self, test: Column, state: int | Column, template: str, *args: Column) -> "Rules":
        self._rules.append((test, self._outcome(state, template, args)))
        return self

    def otherwise(self, state: int | Column, template: str, *args: Column) -> Verdict:
        last = self._outcome(state, template, args)
        if not self._rules:
            return Verdict(last)
        (test, outcome), *rest = self._rules
        chain = F.when(test, outcome)
        for test, outcome in rest:
            chain = chain.when(test, outcome)
        return Verdict(chain.otherwise(last))


def with_health(df: DataFrame, verdict: Verdict) -> DataFrame:
    """Add ``health_state`` and ``health_reason``."""
    return (
        df.withColumn("_verdict", verdict.both)
        .withColumn("health_state", state_name(F.col("_verdict.state")))
        .withColumn("health_reason", F.col("_verdict.reason"))
        .drop("_verdict")
    )


def message(template: str, *args: Column) -> Column:
    """Fill ``%s`` places; unlike ``format_string`` a NULL argument reads as empty text."""
    pieces = template.split("%s")
    parts = [F.lit(pieces[0])]
    for piece, arg in zip(pieces[1:], args, strict=True):
        parts += [arg, F.lit(piece)] if piece else [arg]
    return F.concat_ws("", *parts)


def _instant(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, INSTANT_FORMAT), F.lit(NO_INSTANT))


def _rfc3339(ts: Column) -> Column:
    return F.date_format(ts, RFC3339_FORMAT)


def container_verdict(spec: Column, status: Column) -> Verdict:
    """Health of one container from its specification and (possibly NULL) status."""
    name = spec["name"]
    state, last = status["state"], status["lastTerminationState"]["terminated"]
    ended, running, waiting = state["terminated"], state["running"], state["waiting"]
    ready, started = F.coalesce(status["ready"], F.lit(False)), F.coalesce(status["started"], F.lit(False))
    ended_before = last.isNotNull()
    readiness = F.coalesce(spec["hasReadinessProbe"], F.lit(False)) & ended_before
    startup = F.coalesce(spec["hasStartupProbe"], F.lit(False)) & ended_before
    probe_text = (
        "Container %s is critical as it's not ready due to failing {} probes."
        " Last terminal with non-zero exit code %s and signal %s was at %s. %s."
    )
    probe_args = (
        name, F.coalesce(last["exitCode"], F.lit(0)), F.coalesce(last["signal"], F.lit(0)), _instant(last["finishedAt"]),
        reason_message(last["reason"], last["message"]),
    )
    ended_why = reason_message(ended["reason"], ended["message"])
    is_ended, is_running, is_waiting = ended.isNotNull(), running.isNotNull(), waiting.isNotNull()
    exit_code, signal = F.coalesce(ended["exitCode"], F.lit(0)), F.coalesce(ended["signal"], F.lit(0))
    why = F.coalesce(waiting["reason"], F.lit(""))
    pulled_back = F.coalesce(last["reason"] == IMAGE_PULL_BACK_OFF, F.lit(False))
    return (
        Rules()
        .add(is_ended & ~ready & readiness, CRITICAL, probe_text.format("readiness"), *probe_args)
        .add(is_ended & (exit_code == 0), OK, "Container %s terminated successfully at %s.",
             name, _instant(ended["finishedAt"]))
        .add(is_ended & (signal != 0), CRITICAL, "Container %s terminated with signal %s at %s. %s.",
             name, signal, _instant(ended["finishedAt"]), ended_why)
        .add(is_ended, CRITICAL, "Container %s terminated with non-zero exit code %s at %s. %s.",
             name, exit_code, _instant(ended["finishedAt"]), ended_why)
        .add(is_running & ~started & startup, CRITICAL, probe_text.format("startup"), *probe_args)
        .add(is_running & ~started, PENDING, "Container %s is pending.", name)
        .add(is_running & ~ready & readiness, CRITICAL, probe_text.format("readiness"), *probe_args)
        .add(is_running & ~ready, PENDING, "Container %s is pending.", name)
        .add(is_running, OK, "Container %s is running since %s.", name, _instant(running["startedAt"]))
        .add(is_waiting & (why == ""), PENDING, "Container %s is pending as it's waiting to be started.", name)
        .add(is_waiting & (why == POD_INITIALIZING), PENDING,
             "Container %s is pending as the Pod it's running on is initializing.", name)
        .add(is_waiting & (why == CONTAINER_CREATING), PENDING,
             "Container %s is pending as it's still being created.", name)
        .add(is_waiting & (why == ERR_IMAGE_PULL) & pulled_back, CRITICAL, "Container %s cannot start. %s.",
             name, reason_message(last["reason"], trim_stop(last["message"])))
        .add(is_waiting & (why == ERR_IMAGE_PULL), WARNING,
             "Container %s is waiting to start as its image cannot be pulled: %s.", name, waiting["message"])
        .add(is_waiting, CRITICAL, "Container %s cannot start. %s.",
             name, reason_message(why, trim_stop(waiting["message"])))
        .otherwise(UNKNOWN, "Container %s is unknown as its state could not be obtained: No state provided.", name)
    )


@dataclass(frozen=True)
class RollUp:
    """Container states of one pod: worst ordinal, reasons, and how many of all count as running."""

    state: Column
    reasons: Column
    running: Column
    total: Column


def pod_shut_down(meta: Column, as_of: Column) -> Column:
    deleted, grace = meta["deletionTimestamp"], meta["deletionGracePeriodSeconds"]
    overdue = as_of > F.timestamp_micros(F.unix_micros(deleted) + grace * 1000000)
    return F.coalesce((grace == 0) | overdue, F.lit(False)) & deleted.isNotNull() & grace.isNotNull()


def pod_evicted(phase: Column, reason: Column) -> Column:
    return F.coalesce((phase == "Failed") & (reason == "Evicted"), F.lit(False))


def _condition(conditions: Column, type_: str) -> Column:
    """Last condition of a type, NULL when there is none."""
    return F.try_element_at(F.filter(conditions, lambda c: c["type"] == type_), F.lit(-1))


def _is_false(conditions: Column, type_: str) -> Column:
    return F.coalesce(_condition(conditions, type_)["status"] == "False", F.lit(False))


def pod_verdict(meta: Column, status: Column, roll: RollUp, as_of: Column) -> Verdict:
    who = (meta["namespace"], meta["name"])
    conditions = status["conditions"]
    disrupted, scheduled = _condition(conditions, "DisruptionTarget"), _condition(conditions, "PodScheduled")
    unready = (
        _is_false(conditions, "Initialized") | _is_false(conditions, "ContainersReady") | _is_false(conditions, "Ready")
    )
    return (
        Rules()
        .add(F.coalesce(status["reason"] == "NodeLost", F.lit(False)), UNKNOWN,
             "Pod %s/%s is unknown as the node which was running the pod is unresponsive.", *who)
        .add(pod_shut_down(meta, as_of), OK, "Pod %s/%s is being deleted at %s.", *who,
             _instant(meta["deletionTimestamp"]))
        .add(pod_evicted(status["phase"], status["reason"]), CRITICAL, "Pod %s/%s is terminal: %s: %s.", *who,
             status["reason"], trim_stop(status["message"]))
        .add(disrupted.isNotNull(), CRITICAL, "Pod %s/%s is terminal: %s: %s.", *who,
             disrupted["reason"], trim_stop(disrupted["message"]))
        .add(F.coalesce(status["phase"] == "Succeeded", F.lit(False)), OK,
             "Pod %s/%s is succeeded as all its containers have been terminated successfully and"
             " will not be restarted.", *who)
        .add(_is_false(conditions, "PodScheduled"), CRITICAL, "Pod %s/%s cannot be scheduled: %s: %s.", *who,
             scheduled["reason"], scheduled["message"])
        .add(F.coalesce(status["phase"] == "Failed", F.lit(False)), roll.state,
             "Pod %s/%s has failed as all its containers have been terminated and will not be restarted.\n%s", *who,
             roll.reasons)
        .add(_is_false(conditions, "PodReadyToStartContainers"), CRITICAL,
             "Pod %s/%s is not ready to start containers.", *who)
        .add(unready, roll.state, "Pod %s/%s is %s.\n%s", *who, state_name(roll.state), roll.reasons)
        .otherwise(roll.state, "Pod %s/%s is %s with %s out of %s containers running.\n%s", *who,
                   state_name(roll.state), roll.running, roll.total, roll.reasons)
    )


# What a node condition that holds says about the node.
NODE_PROBLEMS = {
    "DiskPressure": "is running out of disk space",
    "MemoryPressure": "is running out of available memory",
    "PIDPressure": "is running out of process IDs",
    "NetworkUnavailable": "network is not correctly configured",
}


def node_verdict(name: Column, conditions: Column, worst: bool = False) -> Verdict:
    """State set by the last condition that says anything (or the worst one); reasons of all in list order."""
    def finding(condition: Column) -> Column:
        type_, status = condition["type"], condition["status"]
        state, text = F.lit(None).cast("int"), F.lit(None).cast("string")
        for problem, words in NODE_PROBLEMS.items():
            holds = (type_ == problem) & (status == "True")
            state, text = F.when(holds, CRITICAL).otherwise(state), F.when(holds, f" {words}").otherwise(text)
        for value, ordinal in (("False", CRITICAL), ("Unknown", UNKNOWN)):
            holds = (type_ == "Ready") & (status == value)
            words = f" has 'NodeReady' condition '{value.lower()}'"
            state, text = F.when(holds, ordinal).otherwise(state), F.when(holds, words).otherwise(text)
        return F.struct(state.alias("state"), F.concat(F.lit("Node "), name, text).alias("text"))

    found = F.filter(F.transform(conditions, finding), lambda item: item["state"].isNotNull())
    states = F.transform(found, lambda item: item["state"])
    chosen = F.array_max(states) if worst else F.try_element_at(states, F.lit(-1))
    reasons = F.array_join(F.transform(found, lambda item: item["text"]), ". ")
    return (
        Rules()
        .add(chosen.isNotNull(), chosen, "%s.", reasons)
        .otherwise(OK, "Node %s is ok.", name)
    )


def node_ready(conditions: Column) -> Column:
    return F.coalesce(
        F.exists(conditions, lambda c: F.coalesce((c["type"] == "Ready") & (c["status"] == "True"), F.lit(False))),
        F.lit(False),
    )


def _first(conditions: Column, test) -> Column:
    return F.try_element_at(F.filter(conditions, lambda c: F.coalesce(test(c), F.lit(False))), F.lit(1))


def deployment_verdict(
    namespace: Column, name: Column, desired: Column, available: Column, unavailable: Column,
    conditions: Column | None = None, use_conditions: bool = False,
) -> Verdict:
    """Replica counts decide; ``use_conditions`` lets the Available and ReplicaFailure conditions speak first."""
    rules = Rules()
    if use_conditions:
        bad = _first(conditions, lambda c: ((c["type"] == "Available") & (c["status"] != "True"))
                     | ((c["type"] == "ReplicaFailure") & (c["status"] == "True")))
        rules.add(F.coalesce(bad["type"] == "Available", F.lit(False)), CRITICAL,
                  "Deployment %s/%s is not available: %s.", namespace, name, bad["message"])
        rules.add(bad.isNotNull(), CRITICAL, "Deployment %s/%s has replica failure: %s.", namespace, name, bad["message"])
    return (
        rules
        .add(unavailable > 0, CRITICAL, "Deployment %s/%s has %s unavailable replicas.", namespace, name, unavailable)
        .add(available < desired, WARNING, "Deployment %s/%s only has %s out of %s desired replicas available.",
             namespace, name, available, desired)
        .otherwise(OK, "Deployment %s/%s has all %s desired replicas available.", namespace, name, desired)
    )


def replica_set_verdict(
    namespace: Column, name: Column, desired: Column, available: Column,
    conditions: Column | None = None, use_conditions: bool = False,
) -> Verdict:
    rules = Rules()
    if use_conditions:
        bad = _first(conditions, lambda c: (c["type"] == "ReplicaFailure") & (c["status"] == "True"))
        rules.add(bad.isNotNull(), CRITICAL, "ReplicaSet %s/%s has a failure condition: %s.", namespace, name, bad["message"])
    return (
        rules
        .add((available < 1) & (desired > 0), CRITICAL, "ReplicaSet %s/%s has no replica available from %s desired.",
             namespace, name, desired)
        .add(available < desired, WARNING, "ReplicaSet %s/%s only has %s out of %s desired replicas available.",
             namespace, name, available, desired)
        .otherwise(OK, "ReplicaSet %s/%s has all %s desired replicas available.", namespace, name, desired)
    )


def daemon_set_verdict(namespace: Column, name: Column, desired: Column, available: Column) -> Verdict:
    return (
        Rules()
        .add(desired < 1, UNKNOWN, "DaemonSet %s/%s has an invalid desired node count: %s.", namespace, name, desired)
        .add(available == 0, CRITICAL,
             "DaemonSet %s/%s does not have a single pod available which should run on %s desired nodes.",
             namespace, name, desired)
        .add(available < desired, WARNING, "DaemonSet %s/%s pods are only available on %s out of %s desired nodes.",
             namespace, name, available, desired)
        .otherwise(OK, "DaemonSet %s/%s has pods available on all %s desired nodes.", namespace, name, desired)
    )


def stateful_set_verdict(namespace: Column, name: Column, desired: Column, available: Column) -> Verdict:
    """No replica available is critical even when none is desired."""
    return (
        Rules()
        .add(available == 0, CRITICAL, "StatefulSet %s/%s has no replica available from %s desired.",
             namespace, name, desired)
        .add(available < desired, WARNING, "StatefulSet %s/%s only has %s out of %s desired replicas available.",
             namespace, name, available, desired)
        .otherwise(OK, "StatefulSet %s/%s has all %s desired replicas available.", namespace, name, desired)
    )


JOB_CONDITIONS = ["SuccessCriteriaMet", "Complete", "Failed", "FailureTarget", "Suspended"]


def job_verdict(df_columns: dict[str, Column]) -> Verdict:
    """First true condition with a meaning decides, else the job is running; keys are the job's input fields."""
    c = df_columns
    who = (c["namespace"], c["name"])
    told = _first(c["conditions"], lambda x: (x["status"] == "True") & x["type"].isin(JOB_CONDITIONS))
    is_type = lambda type_: F.coalesce(told["type"] == type_, F.lit(False))
    wanted = F.when(c["completions"].isNotNull(), message("%s pod completions", c["completions"])).otherwise(
        "any pod completion")
    ended = F.when(c["completions"].isNotNull(), message("%s necessary pod completions.", c["completions"])).otherwise(
        "any pod completion.")
    limit = F.when(c["backoffLimit"].isNotNull(), message(" The back-off limit is %s.", c["backoffLimit"])).otherwise("")
    deadline = F.when(
        c["activeDeadlineSeconds"].isNotNull(),
        message(" Deadline for completion is %s.", c["activeDeadlineSeconds"])).otherwise("")
    return (
        Rules()
        # The missing letter below is part of the fixed text.
        .add(is_type("SuccessCriteriaMet"), OK, "Job %s/%s met its sucess criteria.", *who)
        .add(is_type("Complete"), OK, "Job %s/%s has completed its execution successfully with %s", *who, ended)
        .add(is_type("Failed"), CRITICAL, "Job %s/%s has failed its execution. %s: %s.", *who,
             told["reason"], told["message"])
        .add(is_type("FailureTarget"), WARNING, "Job %s/%s is about to fail its execution. %s: %s.", *who,
             told["reason"], told["message"])
        .add(is_type("Suspended"), OK, "Job %s/%s is suspended.", *who)
        .otherwise(PENDING,
                   "Job %s/%s is running since %s with currently %s active, %s completed and %s failed pods. "
                   "Successful termination requires %s.%s%s", *who, F.coalesce(F.date_format(c["startTime"], INSTANT_FORMAT), F.lit("<nil>")), c["active"],
                   c["succeeded"], c["failed"], wanted, limit, deadline)
    )


def cron_job_verdict(
    name: Column, last_schedule: Column, last_success: Column, deadline_seconds: Column, suspend: Column, as_of: Column
) -> Verdict:
    deadline = F.timestamp_micros(F.unix_micros(last_schedule) + deadline_seconds * 1000000)
    return (
        Rules()
        .add(last_schedule.isNull(), WARNING, "CronJob %s has never been scheduled.", name)
        .add(last_success.isNull(), CRITICAL, "CronJob %s has never completed successfully.", name)
        .add(F.coalesce(as_of > deadline, F.lit(False)), CRITICAL,
             "CronJob %s missed its starting deadline. Last scheduled at %s, deadline was %s.", name,
             _rfc3339(last_schedule), _rfc3339(deadline))
        .add(last_schedule > last_success, WARNING,
             "CronJob %s has recent schedules without success. Last successful run: %s, last scheduled: %s.", name,
             _rfc3339(last_success), _rfc3339(last_schedule))
        .add(F.coalesce(suspend, F.lit(False)), WARNING, "CronJob %s is currently suspended.", name)
        .otherwise(OK, "CronJob %s is operating normally. Last successful run: %s.", name, _rfc3339(last_success))
    )


def as_of_column(as_of) -> Column:
    """A point in time given as datetime, text or Column; the wall clock is never read."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def summarize_states(tables: dict[str, DataFrame], rollup: bool = True) -> DataFrame:
    """Object counts per cluster, namespace, kind and state, with sub-totals when ``rollup`` is set."""
    rows = None
    for kind, df in tables.items():
        state = F.col("health_state") if "health_state" in df.columns else F.lit(None).cast("string")
        part = df.select("cluster_uuid", "namespace", F.lit(kind).alias("kind"), state.alias("health_state"))
        rows = part if rows is None else rows.unionByName(part)
    keys = ["cluster_uuid", "namespace", "kind", "health_state"]
    grouped = rows.rollup(*keys) if rollup else rows.groupBy(*keys)
    aggs = [F.count(F.lit(1)).alias("objects")]
    return grouped.agg(*aggs, F.grouping_id().alias("level")) if rollup else grouped.agg(*aggs)
