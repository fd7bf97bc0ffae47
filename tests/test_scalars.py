"""Hand-written cases for the column functions."""

import uuid

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import flags, ids, network, objects, quantity, states, text

NS = uuid.UUID("3f249403-2bb0-428f-8e91-504d1fd7ddb6")


def values(spark, rows, column, type_="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {type_}").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_uuid5_equals_python(spark):
    texts = ["order-1", "", "é√", "a" * 500]
    assert values(spark, texts, lambda x: ids.uuid5(F.lit(str(NS)), x)) == [str(uuid.uuid5(NS, t)) for t in texts]


def test_ensure_uuid(spark):
    given = str(uuid.uuid4())
    shapes = [given, given.upper(), "{" + given + "}", "urn:uuid:" + given, given.replace("-", ""), "order-1", given[:-1]]
    got = values(spark, shapes, ids.ensure_uuid)
    assert got[:5] == [given] * 5
    assert got[5] == "322dd879-7511-52db-9334-a778cf3f0cb7"
    assert got[6] == str(uuid.uuid5(NS, given[:-1]))


def test_text(spark):
    assert values(spark, ["ReplicaSet", "pod", "CronJob"], text.snake) == ["replica_set", "pod", "cron_job"]
    cases = [" node was low on memory. ", "x", ".", "", "a..", "a .", "\n a.\t", "..."]
    assert values(spark, cases, text.trim_stop) == ["node was low on memory", "x", "", "", "a.", "a ", "a", ".."]
    assert values(spark, [" m. ", "", None, "."], lambda x: text.reason_message(F.lit("R"), x)) == ["R: m", "R", "R", "R"]
    assert values(spark, ["", "ns"], lambda x: text.object_name(x, F.lit("n"))) == ["n", "ns/n"]


def tail_model(data: str, size: int) -> str:
    raw = data.encode()
    if len(raw) <= size:
        return data
    cut = len(raw) - size
    while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
        cut += 1
    left = raw[cut:]
    return (left[left.index(b"\n") + 1:] if b"\n" in left else left).decode()


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 7, 11, 40])
def test_log_tail_equals_byte_model(spark, size):
    texts = ["aé\nbçd\nxyz", "ééééé", "𝄞𝄞\n𝄞", "plain", "", "a\n", "\n\n\n", "x" * 12 + "\n" + "é" * 3]
    assert values(spark, texts, lambda x: text.log_tail(x, size)) == [tail_model(t, size) for t in texts]


def test_log_tail_default_size_and_invalid_bytes(spark):
    long = "line é\n" * 10000
    got = values(spark, [long], text.log_tail)[0]
    assert len(got.encode()) <= 65535 and got.startswith("line") and got == tail_model(long, 65535)
    df = spark.sql("SELECT CAST(X'61FF62EFBFBD' AS STRING) AS x")
    assert df.select(text.drop_invalid_utf8(F.col("x"))).first()[0] == "ab�"


def test_quantities(spark):
    cases = {"250m": 250, "0.5": 500, "512Mi": 536870912000, "1Gi": 1073741824000, "1e3": 1000000, "1E3": 1000000, "2": 2000,
             "100n": 1, "3u": 1, "1.5Ki": 1536000, "-5": -5000, ".5": 500, "5.": 5000, "1k": 1000000, "x": None, "": None,
             "1Q": None, "9223372036854775807": None, "1e-3": 1, "0.0001": 1, "2M": 2000000000}
    assert values(spark, list(cases), quantity.quantity_milli) == list(cases.values())
    assert values(spark, ["110", "1500m", "1Ki"], quantity.quantity_value) == [110, 2, 1024]
    assert values(spark, ["0", "0m", "1m"], quantity.set_quantity_milli) == [None, None, 1]


def test_network(spark):
    hosts = ["a:1", "a", "[::1]:9", "a:b:c", "[::1", "[::1]", ":9", ""]
    assert values(spark, hosts, network.host_of) == ["a", "a", "::1", None, None, None, "", ""]
    ranges = ["10.0.0.0/22", "", None, "10.0.0.0/32", "10.0.0.0/0", "10.0.0.0/1", "fd00::/64", "fd00::/66", "fd00::/128"]
    assert values(spark, ranges, network.cidr_ips) == [1022, 0, 0, -1, -2, -2, 2**63 - 3, 2**62 - 2, -1]
    assert values(spark, ["10.0.0.0/33", "10.0.0/8", "x"], lambda x: network.cidr_ips(x, strict=False)) == [None] * 3
    with pytest.raises(Exception, match="malformed address range"):
        values(spark, ["10.0.0/8"], network.cidr_ips)
    families = [["IPv4", "IPv6"], ["IPv4"], ["IPv6"], ["x"], [], None]
    assert values(spark, families, network.ip_families, "array<string>") == ["DualStack", "IPv4", "IPv6", "Unknown", None, None]


def test_flags(spark):
    modes = [["ReadWriteOnce", "ReadWriteMany"], [], None, ["ReadWriteOncePod", "x"], ["x"]]
    assert values(spark, modes, flags.access_modes, "array<string>") == [5, None, None, 8, None]
    assert values(spark, [6], lambda x: F.array(flags.set_flag(x, 1), flags.clear_flag(x, 2), flags.toggle_flag(x, 4)), "int") == [[7, 4, 2]]
    assert values(spark, [True, None], flags.yn, "boolean") == [True, False]


def test_objects(spark):
    labels = [{"node-role.kubernetes.io/worker": "", "node-role.kubernetes.io/control-plane": "", "zone": "a"}, {"x": "y"}, None]
    assert values(spark, labels, objects.node_roles, "map<string,string>") == ["control-plane, worker", "", ""]
    assert values(spark, ["/pod?id=1", "http://x/y"], lambda x: objects.resolve_url("https://w/base?q=1", x)) == ["https://w/base/pod?id=1", "http://x/y"]
    assert values(spark, ["u"], lambda x: objects.alert_url("https://w", F.lit("daemon_set"), x)) == ["https://w/daemonset?id=u"]
    assert values(spark, [0, 1, 2, 3, 4], states.severity, "int") == ["ok", "info", "err", "warning", "crit"]
    assert values(spark, ["critical", "ok"], states.severity_of_name) == ["crit", "ok"]


def test_event_chains(spark):
    at = F.lit("2024-01-01").cast("timestamp")
    none = F.lit(None).cast("timestamp")
    row = spark.range(1).select(
        objects.first_seen(none, none, at).alias("a"), objects.last_seen(none, none, at).alias("b"),
        objects.occurrence_count(F.lit(None).cast("int"), F.lit(None).cast("int")).alias("c"),
        objects.occurrence_count(F.lit(4), F.lit(7)).alias("d")).first()
    assert row.a == row.b and row.c == 1 and row.d == 7
