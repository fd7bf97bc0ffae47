"""Plans stay free of cross products, Python workers and needless scans; a few registered queries match their SQL."""

import pytest

import __spark_entry__ as entry
from checks import compare

SF = "/root/testdata/sf0.001"
KEYS = ["service_pods", "m_pod_cpu_request_percentage", "m_node_memory_usage", "counter_rate", "stale_keys", "orphan_incidents", "rule_matches",
        "metric_node_lookup", "container_logs", "norm_pod", "owner_roots", "claim_links"]


@pytest.mark.parametrize("key", KEYS)
def test_no_cross_products_and_no_python(spark, key):
    text = entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert banned not in text, key


def test_filters_and_columns_reach_the_scan(spark):
    text = entry.queries()["retention_events"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text and "props" not in text
    scan = entry.queries()["node_ready"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "s_acctbal" not in scan


@pytest.mark.parametrize("key", ["health_pod", "health_node", "pod_resources", "service_pods", "m_node_cpu_usage", "m_cluster_qos_by_class",
                                 "norm_endpoints", "norm_ingress", "changes_applied", "container_logs", "instance_latest"])
def test_registered_query_matches_sql(spark, key):
    good, told = compare.compare(spark, compare.connect(SF), SF, entry.queries()[key], entry.oracle_sql()[key])
    assert good, told


def test_registry(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 170
    assert entry.entry(spark).count() > 0


def test_resources_are_read_without_verdicts(spark):
    text = entry.queries()["pod_resources"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "back-off" not in text.split("RepartitionByExpression")[0].split("collect_list")[0] and "is running" not in text


def test_tables_of_pods_read_landed_files(spark):
    for key in ("container_union", "cascade_counts"):
        text = entry.queries()[key](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Relation" in text and "l_orderkey" not in text and "Window" not in text, key
