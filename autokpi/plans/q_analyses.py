"""Queries: table analyses, forecasts, insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from autokpi.functions.core import round_half_up
from autokpi.operators import analyses, forecast, insights
from autokpi.plans.fixtures import fixture, table, with_fixtures
from autokpi.plans.registry import register

EVENT_KPIS = ["click", "error", "purchase", "signup", "view"]


@register("a2_time_series_sum_orders", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket, round(sum(o_totalprice), 2) AS total
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 24""")
def q_a2(spark, sf):
    """A2: monthly order value, newest 24 months."""
    out = analyses.time_series_sum(table(spark, sf, "orders"), "o_totalprice", "o_orderdate", 24)
    return out.withColumn("total", round_half_up("total", 2))


@register("a3_count_over_time_lineitem", """
SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS bucket, count(*) AS total
FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 26""")
def q_a3(spark, sf):
    """A3: weekly shipped line items, newest 26 weeks."""
    return analyses.count_over_time(table(spark, sf, "lineitem"), "l_shipdate", 26)


def _demo_sql(tab: str, cols: list[str]) -> str:
    unp = " UNION ALL ".join(f"SELECT {i} AS o, '{c}' AS c, CAST({c} AS STRING) AS v FROM {tab}"
                             for i, c in enumerate(cols))
    return f"""
WITH long AS ({unp}),
counts AS (SELECT o, c, v, count(*) AS total FROM long GROUP BY o, c, v)
SELECT c AS column_name, o + 1 AS col_ordinal, v AS bucket, total
FROM counts WHERE o IN (SELECT o FROM counts GROUP BY o HAVING count(*) >= 2)"""


@register("a4_demographic_customer", _demo_sql("customer", ["c_name", "c_mktsegment"]))
def q_a4_customer(spark, sf):
    """A4: the value counts of the text columns of customer."""
    return analyses.demographic(table(spark, sf, "customer"))


@register("a4_demographic_lineitem", _demo_sql("lineitem", ["l_returnflag", "l_linestatus"]))
def q_a4_lineitem(spark, sf):
    """A4: value counts of lineitem's flag columns (over all line items)."""
    return analyses.demographic(table(spark, sf, "lineitem"))


@register("a4_demographic_top", """
SELECT 'c_name' AS column_name, 1 AS col_ordinal, c_name AS bucket, total, rank FROM (
  SELECT c_name, count(*) AS total, CAST(row_number() OVER (ORDER BY count(*) DESC, c_name ASC NULLS LAST) AS INT) AS rank
  FROM customer GROUP BY 1) WHERE rank <= 12""")
def q_a4_top(spark, sf):
    """A4 as a top-k report: the 12 most frequent values of the first text column of customer."""
    return analyses.demographic(table(spark, sf, "customer"), top=12, max_cols=1)


@register("a5_missing_recent_orders", """
SELECT max(o_orderdate) AS last_seen, count(*) AS total_records FROM orders""")
def q_a5(spark, sf):
    """A5: last order date and order count."""
    return analyses.missing_recent(table(spark, sf, "orders"), "o_orderdate")


DIRTY_DATES = ("dd", "SELECT TRY_CAST(date AS TIMESTAMP) AS t, TRY_CAST(value AS DOUBLE) AS value FROM fx_dirty")


@register("a2_time_series_sum_dirty", with_fixtures("""
SELECT CAST(date_trunc('month', t) AS DATE) AS bucket, round(sum(value), 2) AS total
FROM dd WHERE t IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 24""", DIRTY_DATES))
def q_a2_dirty(spark, sf):
    """A2 on text dates and text amounts, some of them unparsable."""
    out = analyses.time_series_sum(fixture(spark, sf, "fx_dirty"), "value", "date", 24)
    return out.withColumn("total", round_half_up("total", 2))


@register("a3_count_over_time_dirty", with_fixtures("""
SELECT CAST(date_trunc('week', t) AS DATE) AS bucket, count(*) AS total
FROM dd WHERE t IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 26""", DIRTY_DATES))
def q_a3_dirty(spark, sf):
    """A3 on text dates, some of them unparsable."""
    return analyses.count_over_time(fixture(spark, sf, "fx_dirty"), "date", 26)


@register("a5_missing_recent_dirty", with_fixtures("SELECT max(t) AS last_seen, count(*) AS total_records FROM dd", DIRTY_DATES))
def q_a5_dirty(spark, sf):
    """A5 on text dates: the newest date that parses, and all rows."""
    return analyses.missing_recent(fixture(spark, sf, "fx_dirty"), "date")


@register("a6_late_accounts_orders", """
WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders
           WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL),
g AS (SELECT o_custkey, d, date_diff('day', lag(d) OVER (PARTITION BY o_custkey ORDER BY d), d) AS gap FROM d),
per AS (SELECT o_custkey, max(d) AS last_seen, count(*) AS active_days, median(gap) AS median_gap_days FROM g GROUP BY 1)
SELECT o_custkey, last_seen, active_days, CAST(median_gap_days AS DOUBLE) AS median_gap_days,
       CAST(date_diff('day', last_seen, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) AS INT) AS days_since
FROM per WHERE date_diff('day', last_seen, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) > 60""")
def q_a6(spark, sf):
    """Customers with no order in the 60 days before the newest order date."""
    return analyses.late_accounts(table(spark, sf, "orders"), "o_custkey", "o_orderdate", 60)


@register("f1_value_outliers_lineitem", """
WITH s AS (SELECT avg(l_extendedprice) AS m,
                  CASE WHEN coalesce(stddev_samp(l_extendedprice), 0) = 0 THEN 1.0 ELSE stddev_samp(l_extendedprice) END AS sd
           FROM lineitem),
o AS (SELECT l_orderkey, l_linenumber, l_extendedprice, (l_extendedprice - s.m) / s.sd AS z, s.m, s.sd
      FROM lineitem, s WHERE abs((l_extendedprice - s.m) / s.sd) > 2.5)
SELECT l_orderkey, l_linenumber, l_extendedprice, round(z, 4) AS _z, round(m, 4) AS mean, round(sd, 4) AS stddev,
       (SELECT count(*) FROM o) AS outlier_count FROM o""")
def q_f1(spark, sf):
    """F1: line items whose extended price is > 2.5 std from the mean (whole table)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    out = analyses.value_outliers(li, "l_extendedprice", 2.5)
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice", round_half_up("_z", 4).alias("_z"),
                      round_half_up("mean", 4).alias("mean"), round_half_up("stddev", 4).alias("stddev"), "outlier_count")


@register("f2_liability_forecast_orders", """
WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket, coalesce(sum(o_totalprice), 0.0) AS total
           FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY bucket DESC) AS rn FROM m),
g AS (SELECT count(*) AS n, avg(CASE WHEN rn <= 12 THEN total END) AS av,
             sum(CASE WHEN rn <= 12 THEN total END) AS s1, sum(CASE WHEN rn > 12 AND rn <= 24 THEN total END) AS s2,
             max(bucket) AS last FROM r),
gg AS (SELECT *, CASE WHEN n >= 24 AND s2 > 0 THEN s1 / s2 - 1 ELSE 0.0 END AS growth FROM g)
SELECT 'history' AS kind, bucket, round(total, 2) AS total, round((SELECT growth FROM gg), 6) AS growth_yoy
FROM r WHERE rn <= 24
UNION ALL
SELECT 'forecast', CAST(last + to_months(CAST(i AS INTEGER)) AS DATE), round(av * power(1 + growth, i / 12.0), 2),
       round(growth, 6)
FROM gg, range(1, 13) t(i)""")
def q_f2(spark, sf):
    """monthly order value, 24 months of history and a 12-month projection."""
    out = analyses.liability_forecast(table(spark, sf, "orders"), "o_totalprice", "o_orderdate")
    return out.select("kind", "bucket", round_half_up("total", 2).alias("total"), round_half_up("growth_yoy", 6).alias("growth_yoy"))


DAILY_EVENTS = ("SELECT kpi_name, CAST(date AS DATE) AS date, SUM(value) AS value FROM fx_frame "
                "GROUP BY kpi_name, CAST(date AS DATE)")

F3_CTES = (
    ("d", DAILY_EVENTS),
    ("f", "SELECT kpi_name, min(date) AS d0, max(date) AS last, count(*) AS n FROM d GROUP BY 1"),
    ("dd", "SELECT d.*, f.d0, CAST(date_diff('day', f.d0, d.date) AS DOUBLE) AS t, isodow(d.date) - 1 AS wd "
           "FROM d JOIN f USING (kpi_name) WHERE f.n >= 10"),
    ("fit", "SELECT kpi_name, coalesce(regr_slope(value, t), 0.0) AS b, avg(value) AS ybar, avg(t) AS tbar "
            "FROM dd GROUP BY 1"),
    ("fit2", "SELECT *, ybar - b * tbar AS a FROM fit"),
    ("r", "SELECT dd.*, value - (a + b * t) AS res FROM dd JOIN fit2 USING (kpi_name)"),
    ("wd", "SELECT kpi_name, wd, avg(res) AS eff FROM r GROUP BY 1, 2"),
    ("band", "SELECT kpi_name, coalesce(stddev_samp(res - eff), 0.0) AS sd FROM r JOIN wd USING (kpi_name, wd) "
             "GROUP BY 1"),
    ("steps", "SELECT f.kpi_name, f.d0, CAST(f.last + CAST(h AS INTEGER) AS DATE) AS forecast_date, a, b, sd "
              "FROM f JOIN fit2 USING (kpi_name) JOIN band USING (kpi_name), range(1, 8) t(h)"),
    ("fc", "SELECT s.kpi_name, s.forecast_date, "
           "a + b * CAST(date_diff('day', d0, forecast_date) AS DOUBLE) + coalesce(w.eff, 0.0) AS yhat, sd "
           "FROM steps s LEFT JOIN wd w ON w.kpi_name = s.kpi_name AND w.wd = isodow(s.forecast_date) - 1"),
)


@register("f3_forecast_events", with_fixtures("""
SELECT kpi_name, forecast_date, round(yhat, 2) AS predicted_value, round(yhat - 1.2816 * sd, 2) AS lower_bound,
       round(yhat + 1.2816 * sd, 2) AS upper_bound FROM fc""", *F3_CTES))
def q_f3(spark, sf):
    """7-day forecast with an 80 % band per event type (trend + weekday effect)."""
    return forecast.forecast(fixture(spark, sf, "fx_frame"))


@register("w7_forecast_wide", with_fixtures("""
SELECT forecast_date AS date, """ + ", ".join(
    f"max(CASE WHEN kpi_name = '{k}' THEN round(yhat, 2) END) AS {k}, "
    f"max(CASE WHEN kpi_name = '{k}' THEN round(yhat - 1.2816 * sd, 2) END) AS {k}_lower, "
    f"max(CASE WHEN kpi_name = '{k}' THEN round(yhat + 1.2816 * sd, 2) END) AS {k}_upper" for k in EVENT_KPIS)
    + " FROM fc GROUP BY forecast_date", *F3_CTES))
def q_w7(spark, sf):
    """Forecast rows widened to one row per date."""
    return forecast.forecast_wide(forecast.forecast(fixture(spark, sf, "fx_frame")), EVENT_KPIS)


@register("w7_forecast_maps", with_fixtures("""
SELECT forecast_date AS date, kpi_name, round(yhat, 2) AS value, round(yhat - 1.2816 * sd, 2) AS lower, round(yhat + 1.2816 * sd, 2) AS upper
FROM fc""", *F3_CTES))
def q_w7_maps(spark, sf):
    """W7 with a map of forecasts per date, unfolded."""
    maps = forecast.forecast_maps(forecast.forecast(fixture(spark, sf, "fx_frame")))
    return maps.select("date", F.explode("kpis").alias("kpi_name", "f")).select("date", "kpi_name", "f.value", "f.lower", "f.upper")


@register("u2_history_and_forecast", with_fixtures("""
SELECT date, kpi_name, round(value, 2) AS value, NULL::DOUBLE AS predicted_value, NULL::DOUBLE AS lower_bound,
       NULL::DOUBLE AS upper_bound, 'history' AS kind FROM d
UNION ALL
SELECT forecast_date, kpi_name, NULL, round(yhat, 2), round(yhat - 1.2816 * sd, 2), round(yhat + 1.2816 * sd, 2),
       'forecast' FROM fc""", *F3_CTES))
def q_u2(spark, sf):
    """Daily history and forecast of each event type as one series."""
    fr = fixture(spark, sf, "fx_frame")
    from autokpi.operators.kpi import daily_frame
    h = daily_frame(fr).withColumn("value", round_half_up("value", 2))
    return forecast.history_and_forecast(h, forecast.forecast(fr))


def _trend_sql(src: str, report_only: bool) -> str:
    cond = "AND abs(c) > 0.15" if report_only else ""
    return f"""SELECT 'trend_shift' AS type, kpi_name AS kpi, CASE WHEN abs(c) > 0.3 THEN 'warning' ELSE 'info' END AS severity,
  'Trend shift detected in ' || list_aggr(list_transform(string_split(replace(kpi_name, '_', ' '), ' '),
      lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS title,
  'The second half of the observed period shows a ' || printf('%.1f', round(abs(c) * 100, 1)) || '% ' ||
  CASE WHEN c > 0 THEN 'upward' ELSE 'downward' END || ' trend compared to the first half. ' ||
  CASE WHEN abs(c) > 0.3 THEN 'This may indicate a structural change worth investigating.' ELSE 'Monitor closely.' END
    AS explanation, round(c, 4) AS value
FROM (SELECT kpi_name, (m2 - m1) / m1 AS c FROM (
  SELECT kpi_name, max(n) AS n, avg(CASE WHEN rn <= floor(n / 2) THEN value END) AS m1,
         avg(CASE WHEN rn > floor(n / 2) THEN value END) AS m2
  FROM (SELECT *, row_number() OVER (PARTITION BY kpi_name ORDER BY date) AS rn,
               count(*) OVER (PARTITION BY kpi_name) AS n FROM {src}) GROUP BY kpi_name)
  WHERE n >= 7 AND m1 > 0) WHERE true {cond}"""


@register("f4_trend_shift_events", with_fixtures(_trend_sql("d", False), ("d", DAILY_EVENTS)))
def q_f4(spark, sf):
    """first-half vs second-half mean change of every event type (unfiltered)."""
    return insights.trend_shift(fixture(spark, sf, "fx_frame"), report_only=False)


@register("f4_trend_shift_orders", with_fixtures(_trend_sql("d", False), (
    "d", "SELECT o_orderpriority AS kpi_name, CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS value "
         "FROM orders GROUP BY 1, 2")))
def q_f4_orders(spark, sf):
    """F4 over daily order counts per priority (unfiltered)."""
    fr = table(spark, sf, "orders").select(F.col("o_orderdate").alias("date"),
                                           F.col("o_orderpriority").alias("kpi_name"), F.lit(1.0).alias("value"))
    return insights.trend_shift(fr, report_only=False)


def _corr_sql(report_only: bool) -> str:
    cond = "AND abs(r) > 0.75" if report_only else ""
    return f"""SELECT 'correlation' AS type, k1 || ' ↔ ' || k2 AS kpi, 'info' AS severity,
  'Strong correlation: ' || upper(k1[1]) || lower(k1[2:]) || ' & ' || upper(k2[1]) || lower(k2[2:]) AS title,
  'These two metrics move together with a correlation of ' || printf('%.2f', round(r, 2)) || '. ' ||
  CASE WHEN r > 0 THEN 'They likely share a common driver.'
       ELSE 'They move inversely — a rise in one predicts a fall in the other.' END AS explanation,
  round(r, 3) AS value
FROM (SELECT a.kpi_name AS k1, b.kpi_name AS k2,
             covar_samp(a.value, b.value) / (stddev_samp(a.value) * stddev_samp(b.value)) AS r, count(*) AS n
      FROM cd a JOIN cd b ON a.date = b.date AND a.kpi_name < b.kpi_name GROUP BY 1, 2)
WHERE n >= 5 AND r IS NOT NULL AND NOT isnan(r) {cond}"""


CORR_CTES = (("d", DAILY_EVENTS),
             ("cd", "SELECT * FROM d WHERE date IN (SELECT date FROM d GROUP BY date "
                    "HAVING count(DISTINCT kpi_name) = (SELECT count(DISTINCT kpi_name) FROM d))"))


@register("f5_kpi_correlation_events", with_fixtures(_corr_sql(False), *CORR_CTES))
def q_f5(spark, sf):
    """Pearson r of every pair of event types over complete days (unfiltered)."""
    return insights.kpi_correlation(fixture(spark, sf, "fx_frame"), report_only=False)


def _conc_sql(report_only: bool) -> str:
    cond = "AND share > 0.5" if report_only else ""
    return f"""SELECT 'concentration_risk' AS type, 'revenue_concentration' AS kpi, 'warning' AS severity,
  'High revenue concentration risk' AS title,
  'Top 5 accounts represent ' || printf('%.1f', round(share * 100, 1)) || '% of total value. This concentration '
  || 'creates dependency risk — losing one key account would have outsized impact.' AS explanation,
  round(share, 3) AS value
FROM (SELECT top5 / total AS share, total FROM (
  SELECT (SELECT sum(v) FROM (SELECT sum(value) AS v FROM fx_frame GROUP BY customer_id ORDER BY v DESC LIMIT 5)) AS top5,
         (SELECT sum(value) FROM fx_frame) AS total)) WHERE total > 0 {cond}"""


@register("f6_concentration_events", with_fixtures(_conc_sql(False)))
def q_f6(spark, sf):
    """share of event value held by the top-5 users (unfiltered)."""
    return insights.concentration(fixture(spark, sf, "fx_frame"), "customer_id", report_only=False)


def _fresh_sql(as_of: str) -> str:
    return f"""SELECT 'data_freshness' AS type, 'data_age' AS kpi,
  CASE WHEN days > 7 THEN 'warning' ELSE 'info' END AS severity, 'Data is ' || CAST(days AS STRING) || ' days old' AS title,
  'The most recent data point is from ' || strftime(latest, '%Y-%m-%d') || '. ' ||
  CASE WHEN days > 7 THEN 'Consider triggering a sync to get current data.' ELSE 'Data is slightly stale.' END
    AS explanation, CAST(days AS DOUBLE) AS value
FROM (SELECT latest, CAST(floor(epoch(TIMESTAMP '{as_of}' - latest) / 86400) AS BIGINT) AS days
      FROM (SELECT max(date) AS latest FROM fx_frame)) WHERE days > 3"""


@register("f7_freshness_events", with_fixtures(_fresh_sql("2024-02-05 00:00:00")))
def q_f7(spark, sf):
    """whole days from the newest event to 2024-02-05."""
    return insights.freshness(fixture(spark, sf, "fx_frame"), "2024-02-05 00:00:00")


@register("f8_insights_events", with_fixtures(
    "SELECT *, 1 AS ordinal FROM t1 UNION ALL SELECT *, 2 FROM t2 UNION ALL SELECT *, 3 FROM t3 "
    "UNION ALL SELECT *, 4 FROM t4",
    ("d", DAILY_EVENTS), CORR_CTES[1], ("t1", _trend_sql("d", True)), ("t2", _corr_sql(True)),
    ("t3", _conc_sql(True)), ("t4", _fresh_sql("2024-02-12 00:00:00"))))
def q_f8(spark, sf):
    """F8: all insights of the event frame as one table (as of 2024-02-12)."""
    return insights.insights(fixture(spark, sf, "fx_frame"), "2024-02-12 00:00:00")


@register("f1_value_outliers_events", """
WITH s AS (SELECT avg(value) AS m, CASE WHEN coalesce(stddev_samp(value), 0) = 0 THEN 1.0 ELSE stddev_samp(value) END AS sd
           FROM events),
o AS (SELECT event_id, value, (value - s.m) / s.sd AS z FROM events, s WHERE abs((value - s.m) / s.sd) > 2.5)
SELECT event_id, value, round(z, 4) AS _z, (SELECT count(*) FROM o) AS outlier_count FROM o""")
def q_f1_events(spark, sf):
    """F1 on event values (a long right tail: several hundred outliers)."""
    ev = table(spark, sf, "events").select("event_id", "value")
    out = analyses.value_outliers(ev, "value", 2.5)
    return out.select("event_id", "value", round_half_up("_z", 4).alias("_z"), "outlier_count")
