"""Threshold edges of validation, insights, forecasts, preparation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from autokpi.operators import analyses, forecast, insights, prepare, quality


def kframe(spark, values, name="k", start=dt.date(2024, 1, 1), cust=None):
    rows = [(dt.datetime.combine(start + dt.timedelta(days=i), dt.time()), name, float(v),
             cust[i] if cust else f"c{i}") for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date timestamp_ntz, kpi_name string, value double, customer_id string")


def test_null_rate_equal_to_threshold_is_not_flagged(spark):
    df = spark.createDataFrame([(None,)] + [(1,)] * 9, "x int")
    p = quality.null_profile(df, 0.10).collect()[0]
    assert p.null_pct == 10.0 and p.flagged is False
    assert quality.null_check(df, 0.10).collect()[0].status == "pass"
    assert quality.null_check(df, 0.05).collect()[0].status == "warning"


def test_null_check_empty_frame_passes(spark):
    df = spark.createDataFrame([], "x int")
    r = quality.null_check(df).collect()[0]
    assert r.status == "pass" and r.message == "No data to check for nulls."


def test_magnitude_skips_zero_history_and_flags_big_moves(spark):
    cur = spark.createDataFrame([(1.0, 5.0)], "a double, b double")
    hist = spark.createDataFrame([(0.0, 2.0)], "a double, b double")
    prof = {r.column_name: r for r in quality.magnitude_profile(cur, hist, 0.5).collect()}
    assert "a" not in prof and prof["b"].flagged and prof["b"].change_pct == 150.0
    r = quality.magnitude_check(cur, hist, 0.5).collect()[0]
    assert r.status == "warning" and r.message.endswith(": b")
    r = quality.magnitude_check(cur, hist.limit(0), 0.5).collect()[0]
    assert r.status == "pass"


def test_schema_check_rules(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    f = spark.createDataFrame([(1, "a", True), (2, "z", True), (3, "y", False)], "id int, global_field_name string, required boolean")
    r = quality.schema_check(df, f).collect()[0]
    assert (r.status, r.message) == ("fail", "Missing required fields: z")
    assert quality.schema_check(df, f, soften=True).collect()[0].status == "warning"
    r = quality.schema_check(df, f.filter("not required")).collect()[0]
    assert r.status == "pass" and r.message.startswith("No required fields")


def test_scorecard_without_logs_is_minus_one(spark):
    depts = spark.createDataFrame([(1, "A"), (2, "B")], "id int, name string")
    logs = spark.createDataFrame([(1, 1, "null", "pass", dt.datetime(2024, 1, 1)),
                                  (2, 1, "null", "warning", dt.datetime(2024, 1, 2)),
                                  (3, 1, "schema", "pass", dt.datetime(2024, 1, 1))],
                                 "id int, department_id int, check_type string, status string, created_at timestamp_ntz")
    s = {r.department_id: r for r in quality.scorecard(depts, logs).collect()}
    assert s[2].score == -1 and s[2].checks == ""
    assert s[1].score == 85 and s[1].checks == "null=warning,schema=pass"  # (70 + 100) / 2


def test_governance_grades(spark):
    frame = spark.createDataFrame([(1, "a")] * 10, "x int, y string")
    checks = spark.createDataFrame([("pass",), ("pass",)], "status string")
    g = quality.governance(frame, checks, F.lit(1), F.lit(True)).collect()[0]
    assert g.overall == 100.0 and g.grade == "A" and g.recommendations == quality.ADVICE_GOOD
    g = quality.governance(frame, checks.limit(0), F.lit(40), F.lit(False)).collect()[0]
    assert g.validity == 50.0 and g.freshness == 0.0 and g.traceability == 40.0
    assert quality.ADVICE_FRESHNESS in g.recommendations


def test_trend_shift_needs_seven_values(spark):
    assert insights.trend_shift(kframe(spark, [1, 1, 1, 2, 2, 2])).count() == 0
    r = insights.trend_shift(kframe(spark, [1, 1, 1, 2, 2, 2, 2])).collect()[0]
    assert r.value == 1.0 and r.severity == "warning" and "100.0% upward" in r.explanation


def test_concentration_exactly_half_is_not_reported(spark):
    vals = [1.0] * 10
    cust = ["a", "b", "c", "d", "e", "f", "g", "h", "i", "j"]
    assert insights.concentration(kframe(spark, vals, cust=cust)).count() == 0
    r = insights.concentration(kframe(spark, vals, cust=cust), report_only=False).collect()[0]
    assert r.value == 0.5


@pytest.mark.parametrize("days,sev", [(3, None), (4, "info"), (7, "info"), (8, "warning")])
def test_freshness_days(spark, days, sev):
    f = kframe(spark, [1.0])
    as_of = dt.datetime(2024, 1, 1) + dt.timedelta(days=days, hours=5)
    rows = insights.freshness(f, as_of).collect()
    assert (rows[0].severity if rows else None) == sev


def test_correlation_constant_series_skipped(spark):
    a = kframe(spark, [1, 2, 3, 4, 5, 6], "a")
    b = kframe(spark, [2, 4, 6, 8, 10, 12], "b")
    c = kframe(spark, [7, 7, 7, 7, 7, 7], "c")
    rows = insights.kpi_correlation(a.unionByName(b).unionByName(c)).collect()
    assert [(r.kpi, r.value) for r in rows] == [("a ↔ b", 1.0)]


def test_forecast_needs_ten_rows(spark):
    assert forecast.forecast(kframe(spark, list(range(9)))).count() == 0
    rows = forecast.forecast(kframe(spark, list(range(10)))).orderBy("forecast_date").collect()
    assert len(rows) == 7 and rows[0].forecast_date == dt.date(2024, 1, 11)
    assert rows[0].predicted_value == pytest.approx(10.0, abs=1e-6)


def test_liability_growth_needs_24_months(spark):
    def monthly(n):
        rows = [(dt.datetime(2020 + (m // 12), m % 12 + 1, 1), 100.0 if m < n - 12 else 200.0) for m in range(n)]
        return spark.createDataFrame(rows, "d timestamp_ntz, amt double")
    g23 = analyses.liability_forecast(monthly(23), "amt", "d").select("growth_yoy").first()[0]
    g24 = analyses.liability_forecast(monthly(24), "amt", "d").select("growth_yoy").first()[0]
    assert g23 == 0.0 and g24 == pytest.approx(1.0)


def test_auto_prepare_leaves_no_nulls(spark):
    from conftest import SF_SMALL
    from autokpi.plans.fixtures import fixture
    cleaned, actions = prepare.auto_prepare(fixture(spark, SF_SMALL, "fx_dirty"))
    nulls = cleaned.select([F.sum(F.col(c).isNull().cast("int")).alias(c) for c in cleaned.columns]).first().asDict()
    # only unparseable dates may stay null
    assert all(v == 0 for k, v in nulls.items() if k != "date")
    kinds = {(r.col, r.action) for r in actions.collect()}
    assert ("value", "impute_median") in kinds and ("category", "impute_mode") in kinds


def test_auto_model_roles(spark):
    df = spark.createDataFrame([(i, float(i * 10 % 7), "x" if i % 2 else "y", f"name{i}") for i in range(1, 40)],
                               "order_id int, amount double, kind string, label string")
    roles, sugg = prepare.auto_model(df)
    r = {x.column_name: x.role for x in roles.collect()}
    assert r == {"order_id": "identifier", "amount": "metric", "kind": "category", "label": "text"}
    assert [(s.type, s.dimension) for s in sugg.collect()] == [("group_by", "kind")]


def test_correlation_chunks_give_the_same_pairs(spark):
    from conftest import SF_SMALL
    from autokpi.plans.fixtures import fixture
    fr = fixture(spark, SF_SMALL, "fx_frame")
    one = sorted(insights.kpi_correlation(fr, report_only=False).collect())
    many = sorted(insights.kpi_correlation(fr, report_only=False, block_kpis=2, step_days=3).collect())
    assert one == many and len(one) == 10


def test_correlation_of_many_kpis_equals_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 50))
    series = {f"k{i:03d}": base[i % 30] * (1 if i % 2 else -1) + rng.normal(size=50) * (0.2 + i % 5) for i in range(150)}
    series["flat"] = np.full(50, 0.1)
    rows = [(f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}", k, float(v)) for k, x in series.items() for d, v in enumerate(x)]
    rows += [("2025-01-01", "k000", 5.0), ("2025-01-02", None, 5.0)]
    df = spark.createDataFrame(rows, "date string, kpi_name string, value double").withColumn("date", F.col("date").cast("date"))
    names = sorted(k for k in series if k != "flat")
    r = np.corrcoef([series[k] for k in names])
    want = {f"{a} ↔ {b}": r[i, j] for i, a in enumerate(names) for j, b in enumerate(names) if i < j}
    got = {x.kpi: x.value for x in insights.kpi_correlation(df, block_kpis=16, step_days=8).collect()}
    assert set(got) == {k for k, v in want.items() if abs(v) > 0.75} and len(got) > 50
    assert all(abs(got[k] - want[k]) < 6e-4 for k in got)
    every = insights.kpi_correlation(df, report_only=False, block_kpis=40).collect()
    assert {x.kpi for x in every} == set(want)
    plan = insights.kpi_correlation(df)._jdf.queryExecution().executedPlan().toString()
    assert "Pivot" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
