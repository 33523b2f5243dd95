"""One bad table or date ends nothing else; nothing is cut."""

import datetime as dt

from pyspark.sql import functions as F

from autokpi.operators import analyses, discover, kpi, rollups
from autokpi.plans import sync


def test_text_dates_are_parsed_or_left_out(spark):
    df = spark.createDataFrame([("2024-01-05", "1"), ("bad", "2"), (None, "3"), ("2024-02-01 10:00:00", "n/a"), ("zz", None)], "`it's at` string, amount string")
    assert [(str(r.bucket), r.total) for r in analyses.time_series_sum(df, "amount", "it's at").collect()] == [("2024-01-01", 1.0), ("2024-02-01", None)]
    assert [r.total for r in analyses.count_over_time(df, "it's at").collect()] == [1, 1]
    last = analyses.missing_recent(df, "it's at").first()
    assert last.last_seen == dt.datetime(2024, 2, 1, 10) and last.total_records == 5
    got = discover.summarise(analyses.missing_recent(df, "it's at"), "missing_recent", "2024-02-05").first()
    assert (got.value, got.status) == (4.0, "NORMAL")


def test_value_counts_and_overview_cover_all_rows(spark):
    df = spark.range(1000).select(F.concat(F.lit("v"), (F.col("id") % 20).cast("string")).alias("kind"), "id")
    assert discover.summarise(discover.run_analysis({"t": df}, {"kind": "demographic", "table_name": "t"}), "demographic").first().value == 1000
    top = analyses.demographic(df, top=3).orderBy("rank").collect()
    assert [(r.bucket, r.total, r.rank) for r in top] == [("v0", 50, 1), ("v1", 50, 2), ("v10", 50, 3)]
    kpis = discover.analyse_all(spark, {"a" * 120: df}, recorded_at="2024-01-01").collect()
    assert [(r.kpi_name, r.value) for r in kpis] == [("Table overview: " + "a" * 120, 1000.0)]


def test_failing_and_empty_branches_leave_the_others_intact(spark):
    good = spark.createDataFrame([("2024-01-05", "10"), ("2024-01-06", "x"), ("never", "5")], "paid_on string, amount string")
    broken = good.select(F.col("paid_on"), F.raise_error(F.lit("no")).cast("double").alias("amount"))
    tables = {"payments": good, "contributions": broken, "claims": good.where("paid_on = 'never'").select(F.col("paid_on").alias("closed_at")),
              "pensions": good.limit(0)}
    out = sync.extract_isolated(spark, tables)
    rows = {r.table_name: (r.outcome, r.days, r.rows_read, r.rows_rejected) for r in out["status"].collect()}
    assert rows == {"payments": ("synced", 2, 3, 2), "contributions": ("failed", None, None, None), "pensions": ("skipped", 0, 0, 0),
                    "claims": ("skipped", None, None, None)}
    assert out["status"].where("outcome = 'failed'").first().error == "USER_RAISED_EXCEPTION"
    assert sorted((str(r.date)[:10], r.value) for r in out["frame"].collect()) == [("2024-01-05", 10.0)]
    assert sorted((r.column_name, r.text) for r in out["rejects"].where("table_name = 'payments'").collect()) == [("amount", "x"), ("paid_on", "never")]
    got = discover.sync_analyses(spark, tables, as_of="2024-01-10", recorded_at="2024-01-10")
    status = {r.kpi_name: (r.outcome, r.value, r.rows_read, r.rows_rejected) for r in got["status"].collect()}
    assert status["Contribution trend over time (contributions)"][0] == "failed"
    assert status["Late / missing contribution detection (contributions)"] == ("synced", 4.0, 3, 1)
    assert status["Payment anomaly detection (payments)"] == ("synced", 0.0, 3, 2)
    assert status["Claim processing throughput (claims)"] == ("skipped", None, 1, 1)
    assert got["kpis"].count() == sum(s[0] == "synced" for s in status.values())
    assert spark.conf.get("spark.sql.adaptive.optimizer.excludedRules", None) in (None, "")


def test_one_scan_for_all_rollups(spark, tmpdir_path):
    rows = [(i % 3 if i % 5 else None, i % 7, f"k{i % 4}", dt.date(2024, 1, 1 + i % 9), float(i), "NORMAL" if i % 6 else "CRITICAL") for i in range(500)]
    path = f"{tmpdir_path}/kpis"
    spark.createDataFrame(rows, "department_id int, user_id int, kpi_name string, recorded_at date, value double, status string").write.parquet(path)
    kpis = spark.read.parquet(path)
    depts = spark.createDataFrame([(0, "A"), (1, "B")], "id int, name string")
    out = rollups.dashboard_rollups(kpis, depts)
    got = out.collect()
    assert {r.section for r in got} == set(rollups.ROLLUP_SECTIONS)
    total = sum(r[4] for r in rows)
    for section in rollups.ROLLUP_SECTIONS:
        part = [r for r in got if r.section == section]
        assert sum(r.value for r in part) == total and sum(r.row_count for r in part) == 500 and sum(r.anomaly_count for r in part) == 84
    assert {r.kpi_name: r.department_count for r in got if r.section == "kpi"} == {f"k{i}": 3 for i in range(4)}
    plan = rollups.dashboard_rollups(kpis, depts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("recorded_at#") >= 1 and plan.count("] parquet") <= 1


def test_marks_keep_every_kpi(spark):
    rows = [(1, f"k{i}", i, 1, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "d int, kpi string, day int, u int, value double")
    got = {r.kpi: r.within_newest for r in kpi.latest_per(df, ["d", "kpi"], ["day", "u"], mark_within=(["d"], 25)).collect()}
    assert len(got) == 40 and sorted(k for k, v in got.items() if not v) == sorted(f"k{i}" for i in range(15))
