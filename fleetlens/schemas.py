"""Input schemas and the catalogue of produced tables (keys, links, domains, lengths)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

META = (
    "STRUCT<uid: STRING, namespace: STRING, name: STRING, resourceVersion: STRING, creationTimestamp: TIMESTAMP, "
    "deletionTimestamp: TIMESTAMP, deletionGracePeriodSeconds: BIGINT, labels: MAP<STRING,STRING>, "
    "annotations: MAP<STRING,STRING>, ownerReferences: ARRAY<STRUCT<uid: STRING, kind: STRING, name: STRING, "
    "controller: BOOLEAN, blockOwnerDeletion: BOOLEAN>>>"
)
CONDITION = (
    "STRUCT<type: STRING, status: STRING, reason: STRING, message: STRING, lastProbeTime: TIMESTAMP, "
    "lastHeartbeatTime: TIMESTAMP, lastUpdateTime: TIMESTAMP, lastTransitionTime: TIMESTAMP, "
    "observedGeneration: BIGINT>"
)
RESOURCES = "STRUCT<limits: MAP<STRING,STRING>, requests: MAP<STRING,STRING>>"
CONTAINER_STATE = (
    "STRUCT<waiting: STRUCT<reason: STRING, message: STRING>, running: STRUCT<startedAt: TIMESTAMP>, "
    "terminated: STRUCT<exitCode: INT, signal: INT, reason: STRING, message: STRING, startedAt: TIMESTAMP, "
    "finishedAt: TIMESTAMP>>"
)
CONTAINER_SPEC = (
    f"STRUCT<name: STRING, image: STRING, imagePullPolicy: STRING, restartPolicy: STRING, resources: {RESOURCES}, "
    "hasReadinessProbe: BOOLEAN, hasStartupProbe: BOOLEAN, "
    "volumeDevices: ARRAY<STRUCT<name: STRING, devicePath: STRING>>, "
    "volumeMounts: ARRAY<STRUCT<name: STRING, mountPath: STRING, subPath: STRING, readOnly: BOOLEAN>>>"
)
CONTAINER_STATUS = (
    f"STRUCT<name: STRING, ready: BOOLEAN, started: BOOLEAN, restartCount: INT, state: {CONTAINER_STATE}, "
    f"lastTerminationState: {CONTAINER_STATE}>"
)
BACKEND = (
    "STRUCT<service: STRUCT<name: STRING, portName: STRING, portNumber: INT>, "
    "resource: STRUCT<apiGroup: STRING, kind: STRING, name: STRING>>"
)

#: Fields of each kind after ``cluster_uid STRING, meta STRUCT<..>``.
_KIND_FIELDS = {
    "namespace": f"phase STRING, conditions ARRAY<{CONDITION}>",
    "node": (
        "spec STRUCT<podCIDR: STRING, unschedulable: BOOLEAN>, status STRUCT<capacity: MAP<STRING,STRING>, "
        "allocatable: MAP<STRING,STRING>, addresses: ARRAY<STRUCT<type: STRING, address: STRING>>, "
        f"conditions: ARRAY<{CONDITION}>, volumesInUse: ARRAY<STRING>, "
        "volumesAttached: ARRAY<STRUCT<name: STRING, devicePath: STRING>>, "
        "nodeInfo: STRUCT<machineID: STRING, systemUUID: STRING, bootID: STRING, kernelVersion: STRING, "
        "osImage: STRING, operatingSystem: STRING, architecture: STRING, containerRuntimeVersion: STRING, "
        "kubeletVersion: STRING, kubeProxyVersion: STRING>>"
    ),
    "pod": (
        f"spec STRUCT<nodeName: STRING, restartPolicy: STRING, containers: ARRAY<{CONTAINER_SPEC}>, "
        f"initContainers: ARRAY<{CONTAINER_SPEC}>, volumes: ARRAY<STRUCT<name: STRING, "
        "persistentVolumeClaim: STRUCT<claimName: STRING, readOnly: BOOLEAN>, source: MAP<STRING,STRING>>>>, "
        "status STRUCT<phase: STRING, reason: STRING, message: STRING, podIP: STRING, nominatedNodeName: STRING, "
        f"qosClass: STRING, conditions: ARRAY<{CONDITION}>, containerStatuses: ARRAY<{CONTAINER_STATUS}>, "
        f"initContainerStatuses: ARRAY<{CONTAINER_STATUS}>>"
    ),
    "deployment": (
        "desired INT, actual INT, updated INT, ready INT, available INT, unavailable INT, strategy STRING, "
        f"minReadySeconds INT, progressDeadlineSeconds INT, paused BOOLEAN, conditions ARRAY<{CONDITION}>"
    ),
    "replica_set": (
        "desired INT, actual INT, fullyLabeled INT, ready INT, available INT, minReadySeconds INT, "
        f"conditions ARRAY<{CONDITION}>"
    ),
    "daemon_set": (
        "updateStrategy STRING, minReadySeconds INT, desired INT, current INT, misscheduled INT, ready INT, "
        f"updated INT, available INT, unavailable INT, conditions ARRAY<{CONDITION}>"
    ),
    "stateful_set": (
        "desired INT, serviceName STRING, podManagementPolicy STRING, updateStrategy STRING, minReadySeconds INT, "
        "pvcRetention STRUCT<whenDeleted: STRING, whenScaled: STRING>, ordinalStart INT, actual INT, ready INT, "
        f"current INT, updated INT, available INT, conditions ARRAY<{CONDITION}>"
    ),
    "job": (
        "parallelism INT, completions INT, activeDeadlineSeconds BIGINT, backoffLimit INT, "
        "ttlSecondsAfterFinished INT, completionMode STRING, suspend BOOLEAN, startTime TIMESTAMP, "
        f"completionTime TIMESTAMP, active INT, succeeded INT, failed INT, conditions ARRAY<{CONDITION}>"
    ),
    "cron_job": (
        "schedule STRING, timeZone STRING, startingDeadlineSeconds BIGINT, concurrencyPolicy STRING, "
        "suspend BOOLEAN, successfulJobsHistoryLimit INT, failedJobsHistoryLimit INT, active ARRAY<STRING>, "
        "lastScheduleTime TIMESTAMP, lastSuccessfulTime TIMESTAMP"
    ),
    "service": (
        "spec STRUCT<clusterIP: STRING, clusterIPs: ARRAY<STRING>, type: STRING, externalIPs: ARRAY<STRING>, "
        "sessionAffinity: STRING, externalName: STRING, externalTrafficPolicy: STRING, healthCheckNodePort: INT, "
        "publishNotReadyAddresses: BOOLEAN, ipFamilies: ARRAY<STRING>, ipFamilyPolicy: STRING, "
        "allocateLoadBalancerNodePorts: BOOLEAN, loadBalancerClass: STRING, internalTrafficPolicy: STRING, "
        "selector: MAP<STRING,STRING>, ports: ARRAY<STRUCT<name: STRING, protocol: STRING, appProtocol: STRING, "
        f"port: INT, targetPort: STRING, nodePort: INT>>>, conditions ARRAY<{CONDITION}>"
    ),
    "endpoint_slice": (
        "addressType STRING, endpoints ARRAY<STRUCT<hostname: STRING, nodeName: STRING, addresses: ARRAY<STRING>, "
        "ready: BOOLEAN, serving: BOOLEAN, terminating: BOOLEAN, targetRef: STRUCT<kind: STRING, namespace: STRING, "
        "name: STRING, uid: STRING, apiVersion: STRING, resourceVersion: STRING>>>, "
        "ports ARRAY<STRUCT<name: STRING, protocol: STRING, port: INT, appProtocol: STRING>>"
    ),
    "ingress": (
        f"tls ARRAY<STRUCT<hosts: ARRAY<STRING>, secretName: STRING>>, defaultBackend {BACKEND}, "
        f"rules ARRAY<STRUCT<host: STRING, paths: ARRAY<STRUCT<path: STRING, pathType: STRING, backend: {BACKEND}>>>>"
    ),
    "config_map": "immutable BOOLEAN",
    "secret": "type STRING, immutable BOOLEAN",
    "pvc": (
        "desiredAccessModes ARRAY<STRING>, actualAccessModes ARRAY<STRING>, storageRequest STRING, "
        "actualStorage STRING, phase STRING, volumeName STRING, volumeMode STRING, storageClassName STRING, "
        f"conditions ARRAY<{CONDITION}>"
    ),
    "persistent_volume": (
        "accessModes ARRAY<STRING>, storage STRING, reclaimPolicy STRING, storageClassName STRING, phase STRING, "
        "reason STRING, message STRING, volumeMode STRING, source MAP<STRING,STRING>, "
        "claimRef STRUCT<kind: STRING, name: STRING, uid: STRING>"
    ),
    "event": (
        "regarding STRUCT<uid: STRING, kind: STRING, namespace: STRING, name: STRING>, reportingController STRING, "
        "reportingInstance STRING, action STRING, reason STRING, note STRING, type STRING, eventTime TIMESTAMP, "
        "firstTimestamp TIMESTAMP, lastTimestamp TIMESTAMP, count INT, "
        "series STRUCT<count: INT, lastObservedTime: TIMESTAMP>"
    ),
}

#: The 17 resource kinds with their input schema as DDL text.
KIND_SCHEMAS = {kind: f"cluster_uid STRING, meta {META}, {fields}" for kind, fields in _KIND_FIELDS.items()}

FEED_SCHEMAS = {
    "change": "seq BIGINT, type STRING, cluster_uid STRING, kind STRING, uid STRING, key STRING, ts TIMESTAMP, object STRING",
    "sample": "cluster_uid STRING, metric STRING, labels MAP<STRING,STRING>, ts TIMESTAMP, value DOUBLE",
    "log_line": "pod_uid STRING, container STRING, ts TIMESTAMP, seq BIGINT, text STRING",
    "incident": (
        "object_tags STRUCT<uuid: STRING, cluster_uuid: STRING, resource: STRING, name: STRING, namespace: STRING>"
    ),
    "rule": "id STRING, filter STRING",
    "config": "cluster_uid STRING, key STRING, value STRING, locked BOOLEAN",
}

#: A rule filter is JSON of this shape.
RULE_FILTER = "STRUCT<version: INT, kind: STRING, query: STRING, args: ARRAY<STRING>>"


def kind_schema(kind: str) -> T.StructType:
    return T.StructType.fromDDL(KIND_SCHEMAS[kind])


def feed_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(FEED_SCHEMAS[name])


# --- produced tables -------------------------------------------------------------------------------------------

#: Primary key of every table that does not follow a pattern.
TABLE_KEYS = {
    "cluster": ["uuid"], "annotation": ["uuid"], "label": ["uuid"], "selector": ["uuid"],
    "container": ["uuid"], "init_container": ["uuid"], "sidecar_container": ["uuid"],
    "container_device": ["container_uuid", "name"],
    "container_log": ["container_uuid"],
    "container_mount": ["container_uuid", "volume_name"],
    "endpoint": ["uuid"],
    "endpoint_target_ref": ["endpoint_slice_uuid"],
    "ingress_backend_resource": ["resource_uuid", "ingress_uuid"],
    "ingress_backend_service": ["service_uuid", "ingress_uuid"],
    "ingress_rule": ["uuid"],
    "ingress_tls": ["ingress_uuid", "tls_host"],
    "node_volume": ["node_uuid", "name"],
    "persistent_volume_claim_ref": ["persistent_volume_uuid", "uid"],
    "pod_metrics": ["namespace", "pod_name", "container_name", "timestamp"],
    "pod_pvc": ["pod_uuid", "volume_name", "claim_name"],
    "pod_volume": ["pod_uuid", "volume_name"],
    "service_pod": ["service_uuid", "pod_uuid"],
    "service_anchor": ["service_uuid"],
    "service_port": ["service_uuid", "name"],
    "service_selector": ["service_uuid", "selector_uuid"],
    "favorite": ["resource_uuid", "username"],
    "kubernetes_instance": ["uuid"],
    "config": ["key", "cluster_uuid"],
    "kubernetes_schema": ["id"],
    "resource_label": ["resource_uuid", "label_uuid"],
    "resource_annotation": ["resource_uuid", "annotation_uuid"],
}

LABELLED = [
    "config_map", "cron_job", "daemon_set", "deployment", "endpoint_slice", "ingress", "job", "namespace", "node",
    "persistent_volume", "pod", "pvc", "replica_set", "secret", "service", "stateful_set",
]
ANNOTATED = [kind for kind in LABELLED if kind != "endpoint_slice"]
CONDITIONED = [
    "daemon_set", "deployment", "job", "namespace", "node", "pod", "pvc", "replica_set", "service", "stateful_set",
]
OWNED = ["daemon_set", "deployment", "job", "pod", "replica_set", "stateful_set"]
FAVOURABLE = [kind for kind in ANNOTATED if kind not in ("config_map", "secret")]
METRIC_SCOPES = ["cluster", "container", "node", "pod"]

#: Metric samples as stored: the label sets once, and what was measured by their id.
TABLE_KEYS |= {"series": ["cluster_uuid", "series_id"], "sample": ["cluster_uuid", "series_id", "metric", "ts"]}
TABLE_KEYS |= {kind: ["uuid"] for kind in KIND_SCHEMAS}
TABLE_KEYS |= {f"{kind}_label": [f"{kind}_uuid", "label_uuid"] for kind in LABELLED}
TABLE_KEYS |= {f"{kind}_annotation": [f"{kind}_uuid", "annotation_uuid"] for kind in ANNOTATED}
TABLE_KEYS |= {f"{kind}_condition": [f"{kind}_uuid", "type"] for kind in CONDITIONED}
TABLE_KEYS |= {f"{kind}_owner": [f"{kind}_uuid", "owner_uuid"] for kind in OWNED}
TABLE_KEYS |= {
    f"prometheus_{scope}_metric": [f"{scope}_uuid", "timestamp", "category", "name"] for scope in METRIC_SCOPES
}


@dataclass(frozen=True)
class Relation:
    """A child table of a parent: its foreign key, and whether a deleted parent takes its rows along."""

    child: str
    foreign_key: str
    cascade: bool = True


@dataclass
class RelationRegistry:
    """Parent table -> child relations; users add a kind with :meth:`register`."""

    relations: dict[str, list[Relation]] = field(default_factory=dict)

    def register(self, parent: str, *relations: Relation) -> None:
        self.relations.setdefault(parent, []).extend(relations)

    def children(self, parent: str, cascade_only: bool = False) -> list[Relation]:
        return [r for r in self.relations.get(parent, []) if r.cascade or not cascade_only]


def default_relations() -> RelationRegistry:
    registry = RelationRegistry()
    for kind in KIND_SCHEMAS:
        fk = f"{kind}_uuid"
        links = []
        if kind in CONDITIONED:
            links.append(Relation(f"{kind}_condition", fk))
        if kind in OWNED:
            links.append(Relation(f"{kind}_owner", fk))
        if kind in LABELLED:
            links += [Relation(f"{kind}_label", fk), Relation("resource_label", "resource_uuid"),
                      Relation("label", "uuid", cascade=False)]
        if kind in ANNOTATED:
            links += [Relation(f"{kind}_annotation", fk), Relation("resource_annotation", "resource_uuid"),
                      Relation("annotation", "uuid", cascade=False)]
        if kind in FAVOURABLE:
            links.append(Relation("favorite", "resource_uuid"))
        registry.register(kind, *links)
    registry.register(
        "pod",
        Relation("pod_pvc", "pod_uuid"), Relation("pod_volume", "pod_uuid"), Relation("service_pod", "pod_uuid"),
        # Containers of all three sorts and what hangs on them carry the pod's uuid, so they go with the pod.
        Relation("container", "pod_uuid"), Relation("init_container", "pod_uuid"),
        Relation("sidecar_container", "pod_uuid"), Relation("container_device", "pod_uuid"),
        Relation("container_mount", "pod_uuid"), Relation("container_log", "pod_uuid"),
    )
    registry.register("node", Relation("node_volume", "node_uuid"))
    registry.register(
        "service", Relation("service_port", "service_uuid"), Relation("service_selector", "service_uuid"),
        Relation("service_pod", "service_uuid"), Relation("selector", "uuid", cascade=False),
    )
    registry.register(
        "endpoint_slice", Relation("endpoint", "endpoint_slice_uuid"),
        Relation("endpoint_target_ref", "endpoint_slice_uuid"),
    )
    registry.register(
        "ingress", Relation("ingress_tls", "ingress_uuid"), Relation("ingress_rule", "ingress_uuid"),
        Relation("ingress_backend_service", "ingress_uuid"), Relation("ingress_backend_resource", "ingress_uuid"),
    )
    registry.register("persistent_volume", Relation("persistent_volume_claim_ref", "persistent_volume_uuid"))
    for sort in ("container", "init_container", "sidecar_container"):
        registry.register(
            sort, Relation("container_device", "container_uuid"), Relation("container_mount", "container_uuid"),
            Relation("container_log", "container_uuid"),
        )
    return registry


RELATIONS = default_relations()

# Columns that must be set, value domains and longest texts of the produced tables.
NOT_NULL = {
    "pod": ["uuid", "cluster_uuid", "namespace", "name", "uid", "resource_version", "restart_policy", "phase",
            "health_state", "created"],
    "container": ["uuid", "pod_uuid", "name", "image", "ready", "started", "restart_count", "health_state"],
}
DOMAINS = {
    "pod": {
        "phase": ["Pending", "Running", "Succeeded", "Failed"],
        "qos": ["Guaranteed", "Burstable", "BestEffort"],
        "restart_policy": ["Always", "OnFailure", "Never"],
        "health_state": ["pending", "ok", "warning", "critical", "unknown"],
    },
    "container": {
        "image_pull_policy": ["Always", "Never", "IfNotPresent"],
        "state": ["Waiting", "Running", "Terminated"],
        "health_state": ["unknown", "pending", "ok", "warning", "critical"],
    },
    "namespace": {"phase": ["Active", "Terminating"]},
    "deployment": {"strategy": ["Recreate", "RollingUpdate"], "health_state": ["unknown", "ok", "warning", "critical"]},
    "endpoint": {"protocol": ["TCP", "UDP", "SCTP"]},
    "endpoint_slice": {"address_type": ["IPv4", "IPv6", "FQDN"]},
    "condition": {"status": ["true", "false", "unknown"]},
}
MAX_LENGTHS = {
    "annotation": {"name": 317},
    "label": {"name": 317, "value": 255},
    "pod": {"name": 253, "namespace": 255, "node_name": 253, "reason": 255},
    "container": {"name": 255, "image": 512},
    "container_mount": {"path": 255, "sub_path": 255},
    "event": {"name": 253},
}
