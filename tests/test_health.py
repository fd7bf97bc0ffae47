"""Every branch of the health rules on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens import schemas
from fleetlens.operators import health
from fleetlens.operators.normalize import normalize

AT = dt.datetime(2024, 1, 1)
ENDED = {"exitCode": 1, "signal": 0, "reason": "Error", "message": "m. ", "finishedAt": AT}


def judge(spark, spec, status):
    df = spark.createDataFrame([({"name": "c", **spec}, status)], f"spec {schemas.CONTAINER_SPEC}, status {schemas.CONTAINER_STATUS}")
    row = health.with_health(df, health.container_verdict(F.col("spec"), F.col("status"))).first()
    return row.health_state, row.health_reason


CASES = [
    ({}, None, "unknown", "No state provided"),
    ({}, {"state": {}}, "unknown", "No state provided"),
    ({}, {"state": {"terminated": {**ENDED, "exitCode": 0}}}, "ok", "terminated successfully at 2024-01-01 00:00:00 +0000 UTC."),
    ({}, {"state": {"terminated": {**ENDED, "signal": 9}}}, "critical", "terminated with signal 9 at 2024-01-01 00:00:00 +0000 UTC. Error: m."),
    ({}, {"state": {"terminated": ENDED}}, "critical", "terminated with non-zero exit code 1"),
    ({"hasReadinessProbe": True}, {"ready": False, "state": {"terminated": {**ENDED, "exitCode": 0}}, "lastTerminationState": {"terminated": ENDED}},
     "critical", "failing readiness probes"),
    ({}, {"started": False, "state": {"running": {"startedAt": AT}}}, "pending", "Container c is pending."),
    ({"hasStartupProbe": True}, {"started": None, "state": {"running": {"startedAt": AT}}, "lastTerminationState": {"terminated": ENDED}},
     "critical", "failing startup probes"),
    ({}, {"started": True, "ready": False, "state": {"running": {"startedAt": AT}}}, "pending", "Container c is pending."),
    ({"hasReadinessProbe": True}, {"started": True, "ready": False, "state": {"running": {"startedAt": AT}}, "lastTerminationState": {"terminated": ENDED}},
     "critical", "failing readiness probes"),
    ({}, {"started": True, "ready": True, "state": {"running": {"startedAt": AT}}}, "ok", "is running since 2024-01-01 00:00:00 +0000 UTC."),
    ({}, {"state": {"waiting": {"reason": ""}}}, "pending", "waiting to be started"),
    ({}, {"state": {"waiting": {"reason": "PodInitializing"}}}, "pending", "is initializing"),
    ({}, {"state": {"waiting": {"reason": "ContainerCreating"}}}, "pending", "still being created"),
    ({}, {"state": {"waiting": {"reason": "ErrImagePull", "message": "no."}}}, "warning", "its image cannot be pulled: no.."),
    ({}, {"state": {"waiting": {"reason": "ErrImagePull"}}, "lastTerminationState": {"terminated": {**ENDED, "reason": "ImagePullBackOff"}}},
     "critical", "cannot start. ImagePullBackOff: m."),
    ({}, {"state": {"waiting": {"reason": "CrashLoopBackOff", "message": "back-off. "}}}, "critical", "cannot start. CrashLoopBackOff: back-off."),
]


@pytest.mark.parametrize("spec,status,state,words", CASES)
def test_container(spark, spec, status, state, words):
    got = judge(spark, spec, status)
    assert got[0] == state and words in got[1]


def node(spark, conditions, worst=False):
    df = spark.createDataFrame([([{"type": t, "status": s} for t, s in conditions],)], f"c ARRAY<{schemas.CONDITION}>")
    row = health.with_health(df, health.node_verdict(F.lit("n"), F.col("c"), worst)).first()
    return row.health_state, row.health_reason


def test_node_last_assignment_wins(spark):
    both = [("DiskPressure", "True"), ("Ready", "Unknown")]
    text = "Node n is running out of disk space. Node n has 'NodeReady' condition 'unknown'."
    assert node(spark, both) == ("unknown", text)
    assert node(spark, both, worst=True) == ("critical", text)
    assert node(spark, [("Ready", "True"), ("PIDPressure", "False")]) == ("ok", "Node n is ok.")
    assert node(spark, [("Ready", "False")])[0] == "critical"
    assert node(spark, []) == ("ok", "Node n is ok.")


def state(spark, verdict):
    return health.with_health(spark.range(1), verdict).first().health_state


def test_workloads(spark):
    n = F.lit("x")
    i = lambda v: F.lit(v)
    assert state(spark, health.stateful_set_verdict(n, n, i(0), i(0))) == "critical"
    assert state(spark, health.daemon_set_verdict(n, n, i(0), i(0))) == "unknown"
    assert state(spark, health.daemon_set_verdict(n, n, i(2), i(0))) == "critical"
    assert state(spark, health.replica_set_verdict(n, n, i(0), i(0))) == "ok"
    assert state(spark, health.replica_set_verdict(n, n, i(3), i(1))) == "warning"
    assert state(spark, health.deployment_verdict(n, n, i(1), i(1), i(1))) == "critical"


def test_conditions_only_speak_when_asked(spark):
    failing = spark.createDataFrame([([{"type": "ReplicaFailure", "status": "True", "message": "quota"}],)], f"c ARRAY<{schemas.CONDITION}>")
    for use, want in ((False, "ok"), (True, "critical")):
        for verdict in (health.deployment_verdict(F.lit("a"), F.lit("b"), F.lit(1), F.lit(1), F.lit(0), F.col("c"), use),
                        health.replica_set_verdict(F.lit("a"), F.lit("b"), F.lit(1), F.lit(1), F.col("c"), use)):
            assert health.with_health(failing, verdict).first().health_state == want


def pod(spark, as_of="2024-01-01 00:01:00", **parts):
    row = {"cluster_uid": "c", "meta": {"uid": "u", "namespace": "ns", "name": "p", **parts.get("meta", {})},
           "spec": parts.get("spec", {}), "status": parts.get("status", {})}
    df = spark.createDataFrame([row], schemas.kind_schema("pod"))
    got = normalize("pod", df, as_of)["pod"].first()
    return got.health_state, got.health_reason


def test_pod_branches(spark):
    cond = lambda t, s, **more: {"conditions": [{"type": t, "status": s, **more}]}
    assert pod(spark, status={"reason": "NodeLost", "phase": "Succeeded"})[0] == "unknown"
    gone = {"deletionTimestamp": AT, "deletionGracePeriodSeconds": 30}
    assert pod(spark, meta=gone, status={"phase": "Running"}) == ("ok", "Pod ns/p is being deleted at 2024-01-01 00:00:00 +0000 UTC.")
    assert "containers running" in pod(spark, "2024-01-01 00:00:10", meta=gone, status={"phase": "Running"})[1]
    assert pod(spark, "2023-01-01", meta={**gone, "deletionGracePeriodSeconds": 0})[0] == "ok"
    assert pod(spark, status={"phase": "Failed", "reason": "Evicted", "message": " low. "}) == ("critical", "Pod ns/p is terminal: Evicted: low.")
    assert pod(spark, status={"phase": "Succeeded", **cond("DisruptionTarget", "False", reason="R", message="m")}) == ("critical", "Pod ns/p is terminal: R: m.")
    assert pod(spark, status={"phase": "Succeeded"})[0] == "ok"
    assert pod(spark, status=cond("PodScheduled", "False", reason="R", message="m"))[1] == "Pod ns/p cannot be scheduled: R: m."
    assert pod(spark, status=cond("PodReadyToStartContainers", "False"))[0] == "critical"
    assert pod(spark, status=cond("Ready", "False"))[1] == "Pod ns/p is ok.\n"


def test_pod_roll_up_and_resources(spark):
    res = lambda cpu: {"requests": {"cpu": cpu}, "limits": {}}
    spec = {
        "containers": [{"name": "a", "resources": res("100m")}, {"name": "b", "resources": res("150m")}],
        "initContainers": [{"name": "i", "resources": res("1")}, {"name": "s", "restartPolicy": "Always"}]}
    run = {"ready": True, "started": True, "state": {"running": {"startedAt": AT}}}
    status = {"phase": "Running", "containerStatuses": [{"name": "a", **run}, {"name": "b", "state": {"waiting": {"reason": "X"}}}],
              "initContainerStatuses": [{"name": "i", "state": {"terminated": {**ENDED, "exitCode": 0}}}, {"name": "s", **run}]}
    row = {"cluster_uid": "c", "meta": {"uid": "u", "namespace": "ns", "name": "p"}, "spec": spec, "status": status}
    tables = normalize("pod", spark.createDataFrame([row], schemas.kind_schema("pod")), AT)
    got = tables["pod"].first()
    assert got.health_state == "critical"
    lines = got.health_reason.split("\n")
    assert lines[0] == "Pod ns/p is critical with 2 out of 3 containers running."
    assert [line.split("]")[0] for line in lines[1:]] == ["[OK", "[OK", "[OK", "[CRITICAL"]
    assert got.cpu_requests == 1000 and got.cpu_limits is None
    assert tables["init_container"].count() == 1 and tables["sidecar_container"].count() == 1 and tables["container"].count() == 2


def test_cron_job(spark):
    def run(sched, success, deadline=None, suspend=False):
        df = spark.createDataFrame([(sched, success, deadline, suspend)], "a timestamp, b timestamp, d bigint, s boolean")
        return health.with_health(df, health.cron_job_verdict(F.lit("j"), F.col("a"), F.col("b"), F.col("d"), F.col("s"), health.as_of_column(AT))).first().health_state
    old, new = AT - dt.timedelta(hours=2), AT - dt.timedelta(hours=1)
    assert run(None, None) == "warning" and run(old, None) == "critical" and run(old, new, 60) == "critical"
    assert run(new, old) == "warning" and run(old, new, 99999) == "ok" and run(old, new, None, True) == "warning"
