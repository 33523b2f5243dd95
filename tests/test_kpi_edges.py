"""Hand-worked edge tables for W1/W2/W3."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from autokpi.operators import kpi


def frame(spark, values, start=dt.date(2024, 1, 1), name="k"):
    rows = [(dt.datetime.combine(start + dt.timedelta(days=i), dt.time()), name, float(v))
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date timestamp_ntz, kpi_name string, value double")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_two_rows_is_enough_and_one_is_not(spark):
    assert kpi.kpi_metrics(frame(spark, [5])).count() == 0
    r = one(kpi.kpi_metrics(frame(spark, [4, 5])))
    assert r.dod_pct == 25.0 and r.wow_pct == 25.0 and r.avg_7d == 4.0
    # one history row: std is null -> z = 0 -> NORMAL
    assert r.z_score == 0.0 and r.status == "NORMAL" and r.baseline == "all_history"


def test_zero_base_gives_zero_change(spark):
    r = one(kpi.kpi_metrics(frame(spark, [0, 0, 3])))
    assert r.dod_pct == 0.0 and r.wow_pct == 0.0


def test_wow_uses_row_seven_back_else_first(spark):
    r = one(kpi.kpi_metrics(frame(spark, [10, 1, 1, 1, 1, 1, 1, 20])))  # 8 rows: lag 7 = first row
    assert r.wow_pct == 100.0
    r = one(kpi.kpi_metrics(frame(spark, [99, 10, 1, 1, 1, 1, 1, 1, 20])))  # 9 rows: lag 7 = row 2
    assert r.wow_pct == 100.0
    r = one(kpi.kpi_metrics(frame(spark, [10, 1, 1, 20])))  # short: base = first row
    assert r.wow_pct == 100.0


def test_avg_7d_excludes_today(spark):
    r = one(kpi.kpi_metrics(frame(spark, [100, 1, 2, 3, 4, 5, 6, 7, 1000])))
    assert r.avg_7d == 4.0


def test_std_zero_gives_normal(spark):
    r = one(kpi.kpi_metrics(frame(spark, [5] * 10 + [500])))
    assert r.z_score == 0.0 and r.status == "NORMAL"


def test_weekday_baseline_needs_four_rows(spark):
    # 4 Mondays of history before a Monday -> same-weekday baseline
    vals = [1.0] * 28 + [1.0]
    for i in (0, 7, 14, 21):
        vals[i] = 10.0 + i
    r = one(kpi.kpi_metrics(frame(spark, vals)))  # 2024-01-01 is a Monday; day 28 is a Monday
    assert r.baseline == "same_weekday"
    assert r.baseline_mean == pytest.approx((10 + 17 + 24 + 31) / 4, abs=0.01)
    # only 3 earlier Mondays -> all history
    r = one(kpi.kpi_metrics(frame(spark, vals[7:])))
    assert r.baseline == "all_history"


@pytest.mark.parametrize("z,status", [(1.5, "NORMAL"), (1.51, "WARNING"), (2.5, "WARNING"), (2.51, "CRITICAL")])
def test_thresholds_are_strict(spark, z, status):
    # history -1, 0, 1: mean 0 and sample std exactly 1, so z = today
    r = one(kpi.kpi_metrics(frame(spark, [-1.0, 0.0, 1.0, z]), min_weekday_rows=99))
    assert r.status == status


def test_anomaly_rows_and_reason(spark):
    hist = [0.0, 2.0] * 5
    m = kpi.kpi_metrics(frame(spark, hist + [100.0]), min_weekday_rows=99)
    a = one(kpi.anomalies(m))
    assert a.severity == "CRITICAL"
    assert a.reason.startswith("Value 100.00 is exceptionally far from the historical average of 1.00")


def test_latest_per_keeps_newest(spark):
    df = spark.createDataFrame([(1, "a", 1, 10.0), (1, "a", 3, 30.0), (1, "b", 2, 20.0), (2, "a", 1, 5.0)],
                               "dept int, kpi string, ts int, value double")
    out = {(r.dept, r.kpi): r.value for r in kpi.latest_per(df, ["dept", "kpi"], ["ts"]).collect()}
    assert out == {(1, "a"): 30.0, (1, "b"): 20.0, (2, "a"): 5.0}


def test_partition_count_independence(spark):
    from conftest import SF_MID
    from autokpi.plans.fixtures import fixture
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        res = []
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            res.append(sorted(kpi.kpi_metrics(fixture(spark, SF_MID, "fx_frame"), latest_only=False).collect()))
        assert res[0] == res[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_non_utc_session_gives_same_results(spark):
    from conftest import SF_SMALL
    from autokpi.plans.registry import QUERIES, load_all
    load_all()
    names = ["w1_kpi_metrics_events", "a1_daily_totals_orders", "p4_trailing_30d_events", "f7_freshness_events",
             "p10_due_schedules"]
    base = {n: sorted(map(str, QUERIES[n](spark, SF_SMALL).collect())) for n in names}
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        for n in names:
            assert sorted(map(str, QUERIES[n](spark, SF_SMALL).collect())) == base[n], n
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_identical_rows_are_numbered_and_spread(spark):
    from autokpi.functions.ids import content_ids, positional_index
    df = spark.createDataFrame([("hot", 1)] * 300 + [(f"k{i}", i) for i in range(50)], "x string, y int")
    ids = content_ids(df, "rid").select("x", "rid").collect()
    hot = sorted(int(r.rid.rsplit("-", 1)[1]) for r in ids if r.x == "hot")
    assert hot == list(range(1, 301))
    assert all(r.rid.endswith("-1") for r in ids if r.x != "hot")
    pos = positional_index(df, ["x"], "pos", num_partitions=8)
    parts = pos.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in parts) < 300  # the run of identical rows is split across tasks
    assert sorted(r.pos for r in pos.collect()) == list(range(1, 351))
