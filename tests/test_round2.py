"""Edges that once lost or changed rows: caps, merges, lenient numbers, quoting, late streams."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from autokpi.functions.core import lenient_double
from autokpi.operators import analyses, frame, insights, report
from autokpi.sinks import tables as sinks
from autokpi.sources import readers
from autokpi.streaming import incremental


def _path():
    return os.path.join(tempfile.mkdtemp(prefix="autokpi-test-"), "t")


def test_report_rows_filter_before_any_cut(spark):
    rows = spark.range(300).select(
        F.lit(1).alias("department_id"), F.lit(1).alias("user_id"),
        F.when(F.col("id") < 100, "wanted").otherwise("other").alias("kpi_name"),
        F.expr("timestamp_ntz'2024-01-31 10:00:00' - make_interval(0, 0, 0, cast(299 - id as int))").alias("recorded_at"))
    assert report.report_rows(rows, kpi_names=["wanted"]).count() == 100
    assert report.report_rows(rows, date_from="2024-01-31", date_to="2024-01-31").count() == 1


def test_lenient_double_refuses_nan_and_java_suffixes(spark):
    df = spark.createDataFrame([("NaN",), ("1d",), ("2f",), (" 1.5e2 ",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(lenient_double("v")).collect()] == [None, None, None, 150.0, None, None]
    assert spark.createDataFrame([(float("nan"),)], "v double").select(lenient_double("v")).first()[0] is None


def test_correlations_take_any_kpi_name(spark):
    rows = [(dt.date(2024, 1, d), n, float(d * s)) for d in range(1, 12) for n, s in (("Driver's cost", 1), ("b`c", 2))]
    df = spark.createDataFrame(rows, "date date, kpi_name string, value double")
    assert insights.kpi_correlation(df).count() == 1


def test_upsert_errors_types_and_moving_keys(spark):
    path = _path()
    schema = "kpi string, dept string, v int, t int"
    sinks.upsert(spark, path, spark.createDataFrame([("a", "007", 1, 1)], schema), ["kpi"], "t", partition_by="dept")
    sinks.upsert(spark, path, spark.createDataFrame([("a", "008", 2, 2), ("b", "007", 3, 2)], schema), ["kpi"], "t", partition_by="dept")
    got = {(r.kpi, r.dept, r.v) for r in sinks._read(spark, path, spark.createDataFrame([], schema)).collect()}
    assert got == {("a", "008", 2), ("b", "007", 3)}
    assert os.listdir(os.path.dirname(path)) == ["t"]  # no staging left
    sinks.purge(spark, path, F.col("v") == 3, "dept")
    assert spark.read.parquet(path).count() == 1 and os.listdir(os.path.dirname(path)) == ["t"]
    os.rename(path, path + "__previous")  # a swap that broke off
    sinks.upsert(spark, path, spark.createDataFrame([("c", "1", 4, 3)], schema), ["kpi"], "t", partition_by="dept")
    assert spark.read.parquet(path).count() == 2
    bad = _path()
    os.makedirs(bad)
    with open(os.path.join(bad, "part-0.parquet"), "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        sinks.upsert(spark, bad, spark.createDataFrame([("a", "1", 1, 1)], schema), ["kpi"], "t", partition_by="dept")
    assert os.listdir(bad) == ["part-0.parquet"]


def test_run_sql_refuses_jvm_calls_and_unknown_tables(spark):
    for sql in ("SELECT reflect('java.lang.System', 'setProperty', 'a', 'b')", "SELECT * FROM parquet.`/tmp/x`",
                "SELECT id FROM range(1000)) AS q --", "SELECT * FROM nobody"):
        with pytest.raises(Exception):
            readers.run_sql(spark, sql, {}).collect()
    t = spark.range(300)
    assert readers.run_sql(spark, "WITH x AS (SELECT id FROM t) SELECT * FROM x", {"t": t}).count() == 300


def test_late_events_reach_the_daily_totals(spark):
    src, sink, ck = _path(), _path(), _path()
    schema = "ts timestamp, value double"
    drops = [[("2024-01-10 01:00:00", 1.0)], [("2024-03-01 00:00:00", 2.0)], [("2024-01-10 09:00:00", 4.0)]]
    for rows in drops:
        spark.createDataFrame(rows, "ts string, value double").selectExpr("cast(ts as timestamp) ts", "value").write.mode("append").parquet(src)
        incremental.run_daily_totals(spark, src, schema, "ts", "value", "Events", sink, ck).awaitTermination()
    got = {str(r.date): r.value for r in spark.read.parquet(sink).collect()}
    assert got == {"2024-01-10": 5.0, "2024-03-01": 2.0}


def test_corrected_and_late_summaries_are_ingested(spark):
    src, sink, ck = _path(), _path(), _path()
    os.makedirs(src)
    docs = ['{"department":"A","report_date":"2024-02-20","kpis":[{"kpi_name":"k","value":1},{"kpi_name":"k","value":2}]}',
            '{"department":"A","report_date":"2024-02-20","kpis":[{"kpi_name":"k","value":9}]}',
            '{"department":"A","report_date":"2024-01-31","kpis":[]}']
    for n, doc in enumerate(docs):
        with open(os.path.join(src, f"{n}.json"), "w") as f:
            f.write(doc + "\n")
        incremental.run_ingest(spark, src, sink, ck).awaitTermination()
    got = {str(r.report_date): r.combined_kpis for r in spark.read.parquet(sink).collect()}
    assert set(got) == {"2024-02-20", "2024-01-31"} and "9" in got["2024-02-20"]


def test_series_come_back_oldest_first(spark):
    t = spark.sql("SELECT make_date(2023, 1, 1) + cast(id * 11 as int) AS d, 1.0D AS v FROM range(120)").orderBy("v")
    months = [r.bucket for r in analyses.time_series_sum(t, "v", "d", 24).collect()]
    weeks = [r.bucket for r in analyses.count_over_time(t, "d", 26).collect()]
    assert len(months) == 24 and months == sorted(months)
    assert len(weeks) == 26 and weeks == sorted(weeks)
    newest = t.agg({"d": "max"}).first()[0]
    assert months[-1] == newest.replace(day=1)


def test_json_safe_keeps_fractions_and_nested_binary(spark):
    t = spark.sql("""SELECT TIMESTAMP '2024-01-02 03:04:05.123456' AS a, TIMESTAMP '2024-01-02 03:04:05' AS b, X'0AFF' AS c,
        named_struct('x', X'0AFF', 'y', DATE '2024-01-02') AS d, array(X'01', NULL) AS e, map('k', TIMESTAMP '2024-01-02 03:04:05.5') AS f,
        CAST(NULL AS struct<x: binary>) AS g, CAST(NULL AS timestamp) AS h""")
    r = frame.json_safe(t).first()
    assert (r.a, r.b, r.c) == ("2024-01-02T03:04:05.123456", "2024-01-02T03:04:05", "0aff")
    assert (r.d, r.e) == ('{"x":"0aff","y":"2024-01-02"}', '["01",null]')
    assert r.f == '{"k":"2024-01-02T03:04:05.500000"}' and r.g is None and r.h is None
