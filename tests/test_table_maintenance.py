"""K1-K3 on stored tables: null partitions, names as written, broken-off commits."""

import os

from pyspark.sql import functions as F

from autokpi.sinks import tables as sinks

KPI = "kpi string, dept string, v double, t int"


def rows(spark, path):
    return sorted(((r.kpi, r.dept, r.v) for r in sinks._read(spark, path, spark.createDataFrame([], KPI)).collect()), key=str)


def test_upsert_keeps_other_rows_of_the_null_partition(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "t")
    sinks.append(spark.createDataFrame([("a", None, 1.0, 1), ("b", None, 2.0, 1), ("c", "x", 3.0, 1)], KPI), path, "dept")
    sinks.upsert(spark, path, spark.createDataFrame([("a", None, 9.0, 2)], KPI), ["kpi", "dept"], "t", "dept")
    assert rows(spark, path) == [("a", None, 9.0), ("b", None, 2.0), ("c", "x", 3.0)]
    sinks.upsert(spark, path, spark.createDataFrame([("d", "x", 4.0, 2), ("e", "y", 5.0, 2)], KPI), ["kpi", "dept"], "t", "dept")
    assert rows(spark, path) == [("a", None, 9.0), ("b", None, 2.0), ("c", "x", 3.0), ("d", "x", 4.0), ("e", "y", 5.0)]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_upsert_and_purge_leave_untouched_partitions_alone(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "t")
    data = [("a", "007", 1.0, 1), ("b", "007", 2.0, 1), ("c", "x y/z:%", 3.0, 1), ("d", None, 4.0, 1), ("e", "8", 5.0, 1)]
    sinks.append(spark.createDataFrame(data, KPI).coalesce(1), path, "dept")
    before = files(path)
    sinks.purge(spark, path, F.col("kpi").isin("c", "d", "b"), "dept")
    assert rows(spark, path) == [("a", "007", 1.0), ("e", "8", 5.0)]
    assert [f for f in before if "dept=8" in f] == [f for f in files(path) if "dept=8" in f]
    assert sorted(d for d in os.listdir(path) if d.startswith("dept=")) == ["dept=007", "dept=8"]
    sinks.purge(spark, path, F.col("v") > 100, "dept")
    sinks.purge(spark, path, F.lit(None).cast("boolean"), "dept")
    assert len(rows(spark, path)) == 2
    assert not [d for d in os.listdir(tmpdir_path) if d != "t"]


def test_broken_off_commit_is_finished_by_the_next_call(spark, tmpdir_path, monkeypatch):
    path = os.path.join(tmpdir_path, "t")
    sinks.append(spark.createDataFrame([("a", "x", 1.0, 1), ("b", "y", 2.0, 1), ("c", "z", 3.0, 1)], KPI), path, "dept")
    stopped = sinks.recover
    calls = []

    def once(spark_, path_):
        calls.append(path_)
        if len(calls) > 1:
            raise RuntimeError("driver lost")
        stopped(spark_, path_)

    monkeypatch.setattr(sinks, "recover", once)
    try:
        sinks.upsert(spark, path, spark.createDataFrame([("a", "x", 7.0, 2), ("b", "y", 8.0, 2)], KPI), ["kpi", "dept"], "t", "dept")
    except RuntimeError:
        pass
    monkeypatch.setattr(sinks, "recover", stopped)
    assert rows(spark, path) == [("a", "x", 1.0), ("b", "y", 2.0), ("c", "z", 3.0)]
    commit = os.path.join(tmpdir_path, "t__commit")
    part = [d for d in os.listdir(commit) if d.startswith("dept=")][0]  # one partition had been moved when the driver was lost
    os.rename(os.path.join(path, part), os.path.join(tmpdir_path, "gone"))
    sinks.recover(spark, path)
    assert rows(spark, path) == [("a", "x", 7.0), ("b", "y", 8.0), ("c", "z", 3.0)] and not os.path.exists(commit)
    sinks.recover(spark, path)
    assert len(rows(spark, path)) == 3


def test_purge_types_follow_the_table(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "t")
    sinks.append(spark.createDataFrame([("a", "07", 1.0, 1), ("b", "8", 2.0, 1), ("c", None, 2.0, 1)], KPI), path, "dept")
    sinks.purge(spark, path, F.col("dept") == 7, "dept")
    assert rows(spark, path) == [("b", "8", 2.0), ("c", None, 2.0)]
    sinks.purge(spark, path, F.col("dept").isNull(), "dept")
    assert rows(spark, path) == [("b", "8", 2.0)]
