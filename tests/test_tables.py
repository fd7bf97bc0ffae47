"""Stored tables on disk."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetlens import schemas
from fleetlens.sources import tables as T
from fleetlens.sources.readers import read_config, read_incidents, read_logs, read_rules, read_samples, read_snapshot, warm_keys
from fleetlens.session import DROP_SHUFFLES, dropping_shuffles
from fleetlens.sources.sinks import fan_out, with_row_count


@pytest.fixture
def store(spark, tmp_path):
    return T.TableStore(spark, str(tmp_path / "store"))


def labels(spark, *rows):
    return spark.createDataFrame(list(rows), "uuid string, name string, value string")


def rows(store, table):
    return sorted(tuple(r) for r in store.read(table).collect())


def test_upsert_partial_and_delete(spark, store):
    assert store.read("label") is None
    store.write_upsert("label", labels(spark, ("a", "n", "1"), ("b", "n", "1")))
    store.write_upsert("label", labels(spark, ("b", "n", "2"), ("c", "n", "1")))
    assert rows(store, "label") == [("a", "n", "1"), ("b", "n", "2"), ("c", "n", "1")]
    store.write_upsert("label", labels(spark, ("a", "x", "9"), ("d", "x", "9")), update_columns=["value"])
    assert rows(store, "label") == [("a", "n", "9"), ("b", "n", "2"), ("c", "n", "1"), ("d", "x", "9")]
    store.delete_by_keys("label", spark.createDataFrame([("a",), ("zz",)], "uuid string"))
    store.delete_by_keys("label", spark.createDataFrame([("b",), ("c",), ("d",)], "uuid string"))
    assert rows(store, "label") == []
    store.write_upsert("label", labels(spark, ("b", "n", "3"), ("b", "n", "4")), order=["value"])
    assert rows(store, "label") == [("b", "n", "4")]


def test_repeated_batch_changes_nothing(spark, store):
    store.write_upsert("label", labels(spark, ("a", "n", "1")))
    for batch in (T.Batch(3, "s"), T.Batch(3, "s"), T.Batch(5, "s")):
        store.write_upsert("label", labels(spark, ("a", "n", str(batch.id))), batch=batch)
    assert rows(store, "label") == [("a", "n", "5")]
    # The staging of batch 5 is applied again although the rows offered differ: it is the same batch.
    store.write_upsert("label", labels(spark, ("a", "n", "other")), batch=T.Batch(5, "s"))
    assert rows(store, "label") == [("a", "n", "5")]


def test_feeds_with_equal_batch_numbers(spark, store):
    store.write_upsert("label", labels(spark, ("a0", "n", "1")), batch=T.Batch(0, "s", "one"))
    store.write_upsert("label", labels(spark, ("a1", "n", "1")), batch=T.Batch(1, "s", "one"))
    store.write_upsert("label", labels(spark, ("b0", "n", "1")), batch=T.Batch(0, "s", "two"))
    store.write_upsert("label", labels(spark, ("b1", "n", "1")), batch=T.Batch(1, "s", "two"))
    store.write_upsert("label", labels(spark, ("a1", "n", "1")), batch=T.Batch(1, "s", "one"))
    assert [r[0] for r in rows(store, "label")] == ["a0", "a1", "b0", "b1"]


def test_a_write_that_stops_before_its_manifest_takes_nothing_along(spark, store, monkeypatch):
    """Writer A stops in its batch 1, B writes, A starts again: nobody's rows are lost, none are half there."""
    store.write_upsert("label", labels(spark, ("base", "n", "1")))

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as broken:
        broken.setattr(T.TableStore, "publish", stop)
        with pytest.raises(KeyboardInterrupt), store.transaction(T.Batch(1, "s", "a")) as t:
            t.write_upsert("label", labels(spark, ("a1", "n", "1")))
            t.delete_by_keys("label", spark.createDataFrame([("base",)], "uuid string"))
    assert [r[0] for r in rows(store, "label")] == ["base"]
    store.write_upsert("label", labels(spark, ("b0", "n", "1")), batch=T.Batch(0, "s", "b"))
    for _ in range(2):
        store.write_upsert("label", labels(spark, ("a1", "n", "1")), batch=T.Batch(1, "s", "a"))
    assert [r[0] for r in rows(store, "label")] == ["a1", "b0", "base"]


def test_tables_of_one_write_become_visible_together(spark, store):
    with store.transaction() as t:
        t.write_upsert("label", labels(spark, ("a", "n", "1")))
        t.write_upsert("annotation", labels(spark, ("a", "n", "1")))
    before = store.snapshot()
    with store.transaction() as t:
        t.write_upsert("label", labels(spark, ("a", "n", "2")))
        t.write_upsert("label", labels(spark, ("b", "n", "2")))
        t.remove(spark.createDataFrame([("a",)], "uuid string"), [("annotation", ("uuid",))])
        assert rows(store, "label") == [("a", "n", "1")]
    assert [tuple(r) for r in before.read("label").collect()] == [("a", "n", "1")] and before.read("annotation").count() == 1
    assert rows(store, "label") == [("a", "n", "2"), ("b", "n", "2")] and store.read("annotation").count() == 0
    with pytest.raises(ValueError), store.transaction() as t:
        t.write_upsert("label", labels(spark, ("c", "n", "3")))
        raise ValueError
    assert store.read("label").count() == 2


def test_writers_that_meet(spark, store):
    """Two writers start from the same state, also from an empty one: both writes stay."""
    for n in range(2):
        with store.transaction() as one, store.transaction() as two:
            one.write_upsert("label", labels(spark, (f"x{n}", "n", "1")))
            two.write_upsert("label", labels(spark, (f"y{n}", "n", "1"), ("z", "n", str(n))))
    assert [r[0] for r in rows(store, "label")] == ["x0", "x1", "y0", "y1", "z"]
    store.compact(force=True)
    assert rows(store, "label")[-1] == ("z", "n", "1") and store.read("label").count() == 5


def test_compaction_changes_no_rows(spark, store):
    model = {}
    for i in range(6):
        new = {f"u{j}": str(i) for j in range(i, 20, i + 1)}
        gone = [f"u{j}" for j in range(0, 20, 4 + i)]
        with store.transaction() as t:
            t.delete_by_keys("label", spark.createDataFrame([(g,) for g in gone], "uuid string"))
            t.write_upsert("label", labels(spark, *[(u, "n", v) for u, v in new.items()]))
        model = {**{u: v for u, v in model.items() if u not in gone}, **new}
        if i == 3:
            written = store.snapshot()
            assert store.compact(force=True) == ["label"] and store.compact() == []
            assert len(store.snapshot().changes["label"]) == 1 and len(written.changes["label"]) > 4
            assert sorted(map(tuple, written.read("label").collect())) == rows(store, "label")
        assert rows(store, "label") == sorted((u, "n", v) for u, v in model.items())
    files = len(list(Path(store.root).rglob("*.parquet")))
    store.vacuum()
    assert len(store.snapshot().commits) == 1 and len(list(Path(store.root).rglob("*.parquet"))) < files
    assert rows(store, "label") == sorted((u, "n", v) for u, v in model.items())
    store.write_upsert("label", labels(spark, ("new", "n", "1")), batch=T.Batch(4, "s"))
    store.vacuum()
    store.write_upsert("label", labels(spark, ("other", "n", "1")), batch=T.Batch(4, "s"))
    assert store.read("label").count() == len(model) + 1


def test_a_compaction_meets_a_write(spark, store, monkeypatch):
    store.write_upsert("label", labels(spark, ("a", "n", "1"), ("b", "n", "1")))
    store.write_upsert("label", labels(spark, ("a", "n", "2")))
    publish = T.TableStore.publish

    def late(self, *given):
        monkeypatch.setattr(T.TableStore, "publish", publish)
        store.write_upsert("label", labels(spark, ("a", "n", "3"), ("c", "n", "3")))
        store.delete_by_keys("label", spark.createDataFrame([("b",)], "uuid string"))
        publish(self, *given)

    monkeypatch.setattr(T.TableStore, "publish", late)
    store.compact(force=True)
    assert rows(store, "label") == [("a", "n", "3"), ("c", "n", "3")]
    store.compact(force=True)
    assert rows(store, "label") == [("a", "n", "3"), ("c", "n", "3")]


def test_a_small_batch_writes_few_bytes(spark, store):
    wide = spark.range(20000).select(F.sha2(F.col("id").cast("string"), 256).alias("uuid"), F.lit("n").alias("name"), F.md5(F.col("id").cast("string")).alias("value"))
    store.write_upsert("label", wide)
    store.write_upsert("label", wide.limit(200).withColumn("value", F.lit("new")))
    store.delete_by_keys("label", wide.orderBy("uuid").limit(20).select("uuid"))
    first, *later = [x.bytes for x in store.snapshot().changes["label"]]
    assert 0 < sum(later) < 0.05 * first
    assert store.compact() == []


def test_rows_without_a_key_column_are_one_row(spark, store):
    store.write_upsert("label", labels(spark, (None, "n", "1"), ("a", "n", "1")))
    store.write_upsert("label", labels(spark, (None, "n", "2")))
    assert sorted(store.read("label").collect(), key=str) == sorted(labels(spark, (None, "n", "2"), ("a", "n", "1")).collect(), key=str)
    store.delete_by_keys("label", spark.createDataFrame([(None,)], "uuid string"))
    assert rows(store, "label") == [("a", "n", "1")]


def test_new_columns(spark, store):
    store.write_upsert("label", labels(spark, ("a", "n", "1"), ("b", "n", "1")))
    store.write_upsert("label", spark.createDataFrame([("a", "n", "1", 5)], "uuid string, name string, value string, more int"))
    assert sorted(map(tuple, store.read("label").collect())) == [("a", "n", "1", 5), ("b", "n", "1", None)]


def test_unreadable_manifest_is_an_error(spark, store):
    store.write_upsert("label", labels(spark, ("a", "n", "1")))
    (Path(store.root) / "commits" / "x.txt").write_text("not a manifest")
    with pytest.raises(ValueError):
        store.read("label")


def test_one_cluster_is_a_folder(spark, store):
    raw = spark.createDataFrame([{"cluster_uid": c, "meta": {"uid": f"{c}{i}", "name": f"n{i}", "namespace": "ns"}} for c in "ab" for i in range(3)], schemas.kind_schema("pod"))
    store.cascade_upsert("pod", raw, "2024-01-01")
    one = store.read("pod").filter("name = 'n0'").first().cluster_uuid
    keys = warm_keys(store.read("pod"), one)
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster_uuid" in plan and keys.count() == 3
    assert len(keys.inputFiles()) >= 1 and all(f"cluster_uuid={one}" in f for f in store.read("pod").filter(F.col("cluster_uuid") == one).select(F.input_file_name()).distinct().toPandas().iloc[:, 0])


def pods(spark, *names, containers=("a", "b"), version="1"):
    data = [{"cluster_uid": "c", "meta": {"uid": n, "namespace": "ns", "name": n, "resourceVersion": version, "labels": {"app": n}},
             "spec": {"containers": [{"name": x, "image": "i", "volumeMounts": [{"name": "v", "mountPath": "/"}]} for x in containers]}, "status": {"phase": "Running"}}
            for n in names]
    return spark.createDataFrame(data, schemas.kind_schema("pod"))


def test_cascade(spark, store):
    store.cascade_upsert("pod", pods(spark, "p1", "p2"), "2024-01-01")
    assert store.read("container").count() == 4 and store.read("container_mount").count() == 4
    store.cascade_upsert("pod", pods(spark, "p1", containers=("a",), version="2"), "2024-01-01")
    assert store.read("container").count() == 3 and store.read("container_mount").count() == 3
    store.cascade_upsert("pod", pods(spark, "p2", containers=("z",)), "2024-01-01", children="merge")
    assert store.read("container").count() == 4
    gone = store.read("pod").filter("name = 'p2'").select("uuid")
    store.cascade_delete("pod", spark.createDataFrame(gone.collect(), "uuid string"))
    assert [r.name for r in store.read("pod").collect()] == ["p1"]
    assert store.read("container").count() == 1 and store.read("resource_label").count() == 1
    assert store.read("label").count() == 2, "labels have no parent key and stay"
    keys = warm_keys(store.read("pod"), store.read("pod").first().cluster_uuid).collect()
    assert [k.key for k in keys] == ["ns/p1"]


def points(spark, *rows):
    return spark.createDataFrame([("n", dt.datetime.fromisoformat(t), "c", "", float(v)) for t, v in rows],
                                 "node_uuid string, timestamp timestamp, category string, name string, value double")


def test_retention_drops_days_and_filters_the_boundary(spark, store):
    table = "prometheus_node_metric"
    store.write_upsert(table, points(spark, ("2024-01-01 10:00:00", 1), ("2024-01-03 10:00:00", 2), ("2024-01-03 14:00:00", 3), ("2024-01-04 09:00:00", 4)))
    for _ in range(2):
        store.retention(table, "2024-01-04 12:00:00")
        assert [r.value for r in store.read(table).orderBy("timestamp").collect()] == [3.0, 4.0]
    days = lambda: {p.name for p in Path(store.root).rglob("_day=*")}
    assert "_day=2024-01-01" in days()
    store.vacuum()
    assert days() == {"_day=2024-01-03", "_day=2024-01-04"}
    plan = store.read(table)._jdf.queryExecution().executedPlan().toString()
    assert "_day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    store.write_upsert(table, points(spark, ("2024-01-03 14:00:00", 7)), update_columns=["value"])
    assert [r.value for r in store.read(table).orderBy("timestamp").collect()] == [7.0, 4.0]
    store.write_upsert(table, points(spark, ("2024-01-03 11:00:00", 8)))
    assert [r.value for r in store.read(table).orderBy("timestamp").collect()] == [8.0, 7.0, 4.0], "written after the retention"
    store.compact(force=True)
    assert [r.value for r in store.read(table).orderBy("timestamp").collect()] == [8.0, 7.0, 4.0]
    store.retention(table, "2024-01-04 12:00:00")
    assert [r.value for r in store.read(table).orderBy("timestamp").collect()] == [7.0, 4.0]
    with pytest.raises(ValueError):
        store.retention("label", "2024-01-04 12:00:00")


def test_config_and_instances(spark, store):
    schema = "cluster_uuid string, key string, value string, locked boolean"
    store.replace_slice("c1", "prometheus.", spark.createDataFrame([("c1", "prometheus.url", "u", True)], schema))
    store.write_upsert("config", spark.createDataFrame([("c1", "prometheus.token", "t", False), ("c2", "prometheus.url", "x", True)], schema))
    store.replace_slice("c1", "prometheus.", spark.createDataFrame([("c1", "prometheus.username", "n", True)], schema))
    assert {r.key for r in store.read("config").filter("cluster_uuid = 'c1'").collect()} == {"prometheus.token", "prometheus.username"}
    store.replace_slice("c1", "prometheus.", None)
    assert {(r.cluster_uuid, r.key) for r in store.read("config").collect()} == {("c1", "prometheus.token"), ("c2", "prometheus.url")}
    instance = lambda u, c: spark.createDataFrame([(u, c, "0.4.0")], "uuid string, cluster_uuid string, version string")
    for u, c in (("i1", "c1"), ("i2", "c2"), ("i3", "c1"), ("i3", "c1")):
        store.upsert_instance(instance(u, c))
    assert {r.uuid for r in store.read("kubernetes_instance").collect()} == {"i2", "i3"}


def test_readers(spark, tmp_path):
    raw = pods(spark, "p1", "p2")
    raw.write.json(str(tmp_path / "pods"))
    back = read_snapshot(spark, str(tmp_path / "pods"), "pod")
    assert back.schema == schemas.kind_schema("pod") and {r.meta.name for r in back.collect()} == {"p1", "p2"}
    write = lambda name, text: (tmp_path / name).write_text(text)
    write("i.json", '{"object_tags":{"uuid":"u","cluster_uuid":"c","resource":"pod","name":"n","namespace":"ns"},"severity":"crit"}\n')
    assert read_incidents(spark, str(tmp_path / "i.json")).first().asDict() == {"uuid": "u", "cluster_uuid": "c", "resource": "pod", "name": "n", "namespace": "ns"}
    write("r.json", '{"id":"1","filter":""}\n{"id":"2","filter":"{\\"version\\":1,\\"kind\\":\\"pod\\",\\"query\\":\\"q\\",\\"args\\":[\\":uuid\\"]}"}\n')
    rules = read_rules(spark, str(tmp_path / "r.json")).orderBy("id").collect()
    assert rules[0].always and rules[1].version == 1 and rules[1].args == [":uuid"]
    write("c.json", '{"cluster_uid":"c","key":"prometheus.url","value":"u","locked":true}\n')
    assert read_config(spark, str(tmp_path / "c.json")).first().cluster_uuid is not None
    spark.createDataFrame([("p", "c", dt.datetime(2024, 1, 1, h), h, "t") for h in (1, 2)], schemas.FEED_SCHEMAS["log_line"]).write.parquet(str(tmp_path / "logs"))
    assert [r.seq for r in read_logs(spark, str(tmp_path / "logs"), since="2024-01-01 01:30:00").collect()] == [2]
    spark.createDataFrame([("c", "m", {"a": "b"}, dt.datetime(2024, 1, 1), 1.0)], schemas.FEED_SCHEMAS["sample"]).write.parquet(str(tmp_path / "s"))
    assert read_samples(spark, str(tmp_path / "s")).first().labels == {"a": "b"}


def test_fan_out_and_counts(spark, tmp_path):
    df, seen = spark.range(5), []
    fan_out(df, [lambda d: seen.append(d.count()), lambda d: d.write.parquet(str(tmp_path / "o"))])
    assert seen == [5] and spark.read.parquet(str(tmp_path / "o")).count() == 5
    with pytest.raises(ValueError):
        fan_out(df, [lambda d: (_ for _ in ()).throw(ValueError()), lambda d: seen.append("never")])
    assert seen == [5]
    counted, observation = with_row_count(df, "written")
    counted.write.parquet(str(tmp_path / "c"))
    assert observation.get["rows"] == 5


def test_every_table_has_a_key():
    assert all(schemas.TABLE_KEYS.values()) and len(schemas.TABLE_KEYS) >= 97


def test_cascade_deals_no_rows_whose_keys_differ(spark, store, monkeypatch):
    """Unique keys are written as they are; an object that comes twice is settled as before. Staged files do not stay."""
    dealt, whole = [], T.merge.dedup_last
    monkeypatch.setattr(T.merge, "dedup_last", lambda *a: dealt.append(a[1]) or whole(*a))
    given = store.cascade_upsert("pod", pods(spark, "p1", "p2"), "2024-01-01")
    assert not dealt and store.read("pod").count() == 2 and given["pod"].count() == 2
    store.cascade_upsert("pod", pods(spark, "p3").union(pods(spark, "p3")), "2024-01-01")
    assert dealt and store.read("pod").count() == 3 and store.read("container").count() == given["container"].count() * 3 // 2
    assert not list(Path(store.root, "staged").glob("*"))


def test_the_rows_of_one_write_are_not_dealt_by_key(spark, store):
    """One write beside the base holds each key once already; only a second one can hold it again."""
    def plan():
        return store.read("label")._jdf.queryExecution().executedPlan().toString()

    store.write_upsert("label", labels(spark, ("a", "n", "1"), ("b", "n", "1"), (None, "n", "1")))
    store.write_upsert("label", labels(spark, ("b", "n", "2"), ("c", "n", "1"), ("c", "n", "3"), (None, "n", "2")))
    assert "Window" not in plan()
    assert sorted((tuple(r) for r in store.read("label").collect()), key=str) == [("a", "n", "1"), ("b", "n", "2"), ("c", "n", "3"), (None, "n", "2")]
    store.write_upsert("label", labels(spark, ("c", "n", "4")))
    assert "Window" in plan() and ("c", "n", "4") in store.read("label").collect()


def test_shuffle_files_go_with_the_write(spark, store, monkeypatch):
    """Writes and compaction run with Spark's clean-up of shuffle files; the session's own setting comes back, also after an error."""
    seen, before, write = [], spark.conf.get(DROP_SHUFFLES), T.TableStore.write_part

    def watched(self, *given, **more):
        seen.append(spark.conf.get(DROP_SHUFFLES))
        return write(self, *given, **more)

    monkeypatch.setattr(T.TableStore, "write_part", watched)
    store.write_upsert("label", labels(spark, ("a", "n", "1"), ("b", "n", "1"), ("a", "n", "2")))
    store.write_upsert("label", labels(spark, ("a", "n", "3")))
    assert store.compact(force=True) == ["label"] and seen == ["true"] * 3 and spark.conf.get(DROP_SHUFFLES) == before
    assert rows(store, "label") == [("a", "n", "3"), ("b", "n", "1")]
    with pytest.raises(ZeroDivisionError), dropping_shuffles(spark):
        1 / 0
    assert spark.conf.get(DROP_SHUFFLES) == before


def test_compacted_samples_come_before_the_next_write(spark, store):
    """A retention after compaction finds the folded rows before it, whatever the random ending of its name."""
    rows = spark.createDataFrame([("c", b"s", "m", dt.datetime(2024, 1, day), 1.0) for day in (1, 2, 3, 4)],
                                 "cluster_uuid string, series_id binary, metric string, ts timestamp, value double")
    for _ in range(2):
        with store.transaction() as t:
            t.append("sample", rows)
    for _ in range(2):
        store.compact(["sample"], force=True)
        found, = store.snapshot().parts("sample", "rows")
        folder = found.path.partition("_commit=")[2]
        assert found.commit < folder < f"{store.snapshot().number + 1:012d}-"
        with store.transaction() as t:
            t.append("sample", rows)
    store.compact(["sample"], force=True)
    store.retention("sample", "2024-01-04 00:00:00")
    assert [r.ts.day for r in store.read("sample").sort("ts").collect()] == [3] * 4 + [4] * 4
