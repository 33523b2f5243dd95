"""Queries: charts, report rows, text, schedules, snapshots, NPS
(P6-P12, P14, T1, T3, T6, W5, W6, A15-A17, J10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from autokpi.functions.core import round_half_up, title_label
from autokpi.operators import kpi, nps, report
from autokpi.plans.fixtures import fixture, table, with_fixtures
from autokpi.plans.q_core import DAILY_EVENTS, DAILY_ORDERS, W2_SELECT, order_counts, w1_parts
from autokpi.plans.registry import register


def _py_title(col: str) -> str:
    """DuckDB text for ``initcap(replace(col, '_', ' '))``."""
    return (f"list_aggr(list_transform(string_split(replace({col}, '_', ' '), ' '), "
            f"lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ')")


@register("p6_chart_series_orders", with_fixtures("""
SELECT CAST(row_number() OVER (ORDER BY date, kpi_name) AS INT) AS position, substr(CAST(date AS STRING), 1, 40) AS label,
  value, 'line' AS chart_type, 'date' AS x_column, 'value' AS y_column
FROM (SELECT * FROM fx_kpi_orders ORDER BY date, kpi_name LIMIT 50)"""))
def q_p6(spark, sf):
    """Chart points from the daily order value frame (x = date hint -> line chart)."""
    return report.chart_series(fixture(spark, sf, "fx_kpi_orders"), order_by=["date", "kpi_name"])


@register("p6_chart_series_monthly", """
SELECT CAST(row_number() OVER (ORDER BY bucket) AS INT) AS position, CAST(bucket AS STRING) AS label, total AS value,
  'bar' AS chart_type, 'bucket' AS x_column, 'total' AS y_column
FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket, round(sum(o_totalprice), 2) AS total
      FROM orders GROUP BY 1 ORDER BY 1 LIMIT 50)""")
def q_p6_monthly(spark, sf):
    """P6 over an analysis result (bucket, total): no hint -> first column, bar chart."""
    from autokpi.operators import analyses
    m = analyses.time_series_sum(table(spark, sf, "orders"), "o_totalprice", "o_orderdate", None)
    return report.chart_series(m.withColumn("total", round_half_up("total", 2)))


@register("p7_custom_chart_pie", with_fixtures("""
SELECT CAST(row_number() OVER (ORDER BY recorded_at DESC, department_id, user_id, kpi_name) AS INT) AS position,
  substr(kpi_name, 1, 60) AS label, value, 'pie' AS chart_type, 'kpi_name' AS x_column, 'value' AS y_column
FROM (SELECT * FROM fx_kpi_results ORDER BY recorded_at DESC, department_id, user_id, kpi_name LIMIT 100)"""))
def q_p7(spark, sf):
    """Custom pie chart of the newest 100 KPI results (x = kpi_name, y = value)."""
    kr = fixture(spark, sf, "fx_kpi_results")
    return report.custom_chart(kr, "pie", "kpi_name", "value",
                               order_by=[F.col("recorded_at").desc(), "department_id", "user_id", "kpi_name"])


@register("p8_report_rows_all", with_fixtures("""
SELECT * FROM (SELECT * FROM fx_kpi_results WHERE recorded_at >= DATE '1996-01-01' AND recorded_at <= DATE '1996-12-31'
               ORDER BY recorded_at DESC, department_id, user_id, kpi_name)
WHERE kpi_name IN ('1-URGENT', '2-HIGH')"""))
def q_p8_all(spark, sf):
    """Admin scope, 1996 only, the rows of two KPI names."""
    return report.report_rows(fixture(spark, sf, "fx_kpi_results"), "all", date_from="1996-01-01",
                              date_to="1996-12-31", kpi_names=["1-URGENT", "2-HIGH"])


@register("p8_report_rows_departments", with_fixtures("""
SELECT * FROM fx_kpi_results WHERE department_id IN (1, 3)
ORDER BY recorded_at DESC, department_id, user_id, kpi_name"""))
def q_p8_depts(spark, sf):
    """Chosen departments (1 and 3), all rows."""
    return report.report_rows(fixture(spark, sf, "fx_kpi_results"), "departments", department_ids=[1, 3])


DAILY_DEPT = ("SELECT department_id, kpi_name, recorded_at AS date, sum(value) AS value FROM fx_kpi_results "
              "GROUP BY 1, 2, 3")


def _dept_metrics(spark, sf, latest_only):
    kr = fixture(spark, sf, "fx_kpi_results").withColumnRenamed("recorded_at", "date")
    return kpi.kpi_metrics(kr, latest_only=latest_only, keys=["department_id", "kpi_name"])


_P9_CTES, _P9_FINAL = w1_parts("d", False, ("department_id", "kpi_name"))


@register("p9_alert_rows", with_fixtures("""
SELECT a.department_id, a.kpi_name, a.recorded_at, a.z_score AS deviation, r.user_id, r.role
FROM (SELECT * FROM metrics WHERE status = 'CRITICAL' AND z_score > 3.0) a
JOIN (SELECT * FROM fx_user_roles WHERE role IN ('admin', 'manager')) r ON r.department_id = a.department_id""",
    ("d", DAILY_DEPT), *_P9_CTES, ("metrics", _P9_FINAL)))
def q_p9(spark, sf):
    """Critical anomalies (deviation > 3) of every department's KPI series,
    one row per admin/manager of that department."""
    an = kpi.anomalies(_dept_metrics(spark, sf, False))
    rec = fixture(spark, sf, "fx_user_roles").filter(F.col("role").isin("admin", "manager")) \
        .select("department_id", "user_id", "role")
    out = report.alert_rows(an, rec, "department_id")
    return out.select("department_id", "kpi_name", "recorded_at", "deviation", "user_id", "role")


@register("p10_due_schedules", with_fixtures("""
SELECT user_id, sync_time, sync_frequency, yearly_date, TIMESTAMP '2024-01-01 02:00:00' AS due_at FROM fx_prefs
WHERE sync_time = '02:00' AND (sync_frequency IN ('daily', 'weekly', 'monthly') OR (sync_frequency = 'yearly' AND yearly_date = '01-01'))
UNION ALL
SELECT user_id, sync_time, sync_frequency, yearly_date, TIMESTAMP '2024-01-02 02:00:00' FROM fx_prefs
WHERE sync_time = '02:00' AND sync_frequency = 'daily'"""))
def q_p10(spark, sf):
    """P10: tenants due at 2024-01-01 02:00 (Monday, 1st, 1 January) and at 2024-01-02 02:00."""
    prefs = fixture(spark, sf, "fx_prefs")
    return report.due(prefs, "2024-01-01 02:00:00").unionByName(report.due(prefs, "2024-01-02 02:00:00"))


@register("p11_kpi_labels", f"""
SELECT DISTINCT o_orderpriority AS kpi_name, {_py_title('o_orderpriority')} AS label FROM orders
UNION SELECT DISTINCT event_type, {_py_title('event_type')} FROM events""")
def q_p11(spark, sf):
    """Display labels of every KPI name in orders and events."""
    names = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("kpi_name")) \
        .union(table(spark, sf, "events").select("event_type")).distinct()
    return names.select("kpi_name", title_label("kpi_name").alias("label"))


_W1E_CTES, _W1E_FINAL = w1_parts("d", True)


EXPLAIN_SQL = f"""
SELECT kpi_name, {_py_title('kpi_name')} || ' is currently ' || format('{{:,.2f}}', round(value, 2)) || ', ' ||
  CASE WHEN dod_pct > 0 THEN 'increased' ELSE 'decreased' END || ' ' || printf('%.1f', round(abs(dod_pct), 1)) ||
  '% day-over-day and ' || CASE WHEN wow_pct > 0 THEN 'up' ELSE 'down' END || ' ' ||
  printf('%.1f', round(abs(wow_pct), 1)) || '% week-over-week. ' ||
  CASE status WHEN 'CRITICAL' THEN 'This requires immediate attention.'
              WHEN 'WARNING' THEN 'This warrants close monitoring.' ELSE 'Performance is within normal parameters.' END
  AS explanation
FROM metrics"""


@register("p12_explain_kpi_events", with_fixtures(EXPLAIN_SQL, ("d", DAILY_EVENTS), *_W1E_CTES, ("metrics", _W1E_FINAL)))
def q_p12_kpi(spark, sf):
    """One-line explanation of each event type's latest movement."""
    return report.explain_kpi(kpi.kpi_metrics(fixture(spark, sf, "fx_frame"))).select("kpi_name", "explanation")


_W2O_CTES, _W2O_FINAL = w1_parts("d", False)


@register("p12_explain_anomaly_orders", with_fixtures(f"""
SELECT kpi_name, recorded_at, {_py_title('kpi_name')} || ' shows a ' ||
  CASE WHEN severity = 'CRITICAL' THEN 'critical issue' ELSE 'notable deviation' END || ' with a ' ||
  printf('%.1f', round(deviation, 1)) || 'σ deviation from its normal range. ' || reason || ' ' ||
  CASE WHEN severity = 'CRITICAL' THEN 'Immediate investigation is recommended.'
       ELSE 'Monitor this metric closely over the next 24-48 hours.' END AS explanation
FROM an""", ("d", DAILY_ORDERS), *_W2O_CTES, ("metrics", _W2O_FINAL), ("an", W2_SELECT.format(keys="kpi_name, "))))
def q_p12_anomaly(spark, sf):
    """Explanation of every anomaly of the daily order counts."""
    an = kpi.anomalies(kpi.kpi_metrics(order_counts(spark, sf), latest_only=False))
    return report.explain_anomaly(an).select("kpi_name", "recorded_at", "explanation")


def _pct_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'N/A' ELSE printf('%+.1f', round({c}, 1)) || '%' END"


KPI_LINE_SQL = (f"'  - ' || {_py_title('kpi_name')} || ': ' || format('{{:,.2f}}', round(coalesce(value, 0.0), 2)) || "
                f"' | DoD: ' || {_pct_sql('dod_pct')} || ' | WoW: ' || {_pct_sql('wow_pct')} || ' | Status: ' || "
                f"coalesce(status, 'NORMAL')")


@register("p12_kpi_lines_orders", with_fixtures(f"""
SELECT kpi_name, recorded_at, {KPI_LINE_SQL} AS line FROM metrics""",
    ("d", DAILY_ORDERS), *_W2O_CTES, ("metrics", _W2O_FINAL)))
def q_p12_lines(spark, sf):
    """KPI text line for every day of the daily order counts."""
    m = kpi.kpi_metrics(order_counts(spark, sf), latest_only=False)
    return report.kpi_line(m).select("kpi_name", "recorded_at", "line")


_BR_CTES, _BR_FINAL = w1_parts("d", True, ("department_id", "kpi_name"))


@register("p12_briefing_departments", with_fixtures(f"""
SELECT k.department_id, CASE WHEN k.r = 2 THEN 'RED' WHEN k.r = 1 THEN 'AMBER' ELSE 'GREEN' END AS overall_status,
  k.kpi_text, coalesce(a.n, 0) AS anomaly_count, coalesce(a.anomaly_text, '  No anomalies detected in this period.') AS anomaly_text
FROM (SELECT department_id, max(CASE status WHEN 'CRITICAL' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) AS r,
             string_agg({KPI_LINE_SQL}, chr(10) ORDER BY {KPI_LINE_SQL}) AS kpi_text
      FROM metrics GROUP BY 1) k
LEFT JOIN (SELECT department_id, count(*) AS n, string_agg(line, chr(10) ORDER BY line) AS anomaly_text FROM (
             SELECT department_id, '  [' || severity || '] ' || {_py_title('kpi_name')} || ': ' || reason ||
                    ' (z-score deviation: ' || printf('%.1f', round(deviation, 1)) || ')' AS line FROM an) GROUP BY 1) a
  ON a.department_id = k.department_id""",
    ("d", DAILY_DEPT), *_BR_CTES, ("metrics", _BR_FINAL), ("an", W2_SELECT.format(keys="department_id, kpi_name, "))))
def q_p12_briefing(spark, sf):
    """Fallback briefing per department from the latest KPI movements."""
    m = _dept_metrics(spark, sf, True)
    return report.briefing(m, kpi.anomalies(m), ["department_id"])


@register("p14_validation_logs", with_fixtures("""
SELECT * FROM fx_validation_logs WHERE check_type = 'null' AND department_id = 1
ORDER BY created_at DESC, id DESC"""))
def q_p14(spark, sf):
    """Every null-check log of department 1, newest first."""
    return report.validation_logs(fixture(spark, sf, "fx_validation_logs"), "null", 1)


@register("t1_snapshot_kpi_results", with_fixtures("""
SELECT trim(replace(kpi_name, '_', ' ')) AS name, coalesce(value, 0.0) AS value, coalesce(status, 'NORMAL') AS status,
  recorded_at, kpi_name, department_id, user_id
FROM fx_kpi_results ORDER BY coalesce(value, 0.0) DESC, recorded_at, kpi_name, department_id, user_id LIMIT 12"""))
def q_t1(spark, sf):
    """12 largest KPI results."""
    return report.snapshot(fixture(spark, sf, "fx_kpi_results"), 12)


@register("t3_newest_logs_per_department", with_fixtures("""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY department_id ORDER BY created_at DESC, id DESC) AS INT) AS rank
               FROM fx_validation_logs) WHERE rank <= 50"""))
def q_t3(spark, sf):
    """Newest 50 validation logs per department."""
    return report.newest(fixture(spark, sf, "fx_validation_logs"), ["created_at", "id"], 50, by=["department_id"])


def _trend_sql(src: str) -> str:
    return f"""SELECT n.kpi_name, trim(replace(n.kpi_name, '_', ' ')) AS label, t.date, strftime(t.date, '%b %d') AS day_label,
  round(s.value, 2) AS value
FROM (SELECT DISTINCT kpi_name FROM rec) n CROSS JOIN (SELECT DISTINCT date FROM rec) t
LEFT JOIN (SELECT kpi_name, date, sum(value) AS value FROM rec GROUP BY 1, 2) s
  ON s.kpi_name = n.kpi_name AND s.date = t.date"""


@register("w6_trend_events", with_fixtures(_trend_sql("rec"), (
    "rec", "SELECT kpi_name, CAST(date AS DATE) AS date, value FROM fx_frame "
           "WHERE CAST(date AS DATE) >= (SELECT max(CAST(date AS DATE)) FROM fx_frame) - INTERVAL 14 DAY")))
def q_w6(spark, sf):
    """14-day trend of every event type, aligned on dates."""
    return report.trend(fixture(spark, sf, "fx_frame"), 14)


@register("w6_trend_orders_gappy", with_fixtures(_trend_sql("rec"), (
    "rec", "SELECT kpi_name, date, value FROM fx_kpi_orders "
           "WHERE date >= (SELECT max(date) FROM fx_kpi_orders) - INTERVAL 14 DAY")))
def q_w6_orders(spark, sf):
    """W6 over the gappy daily order value: days a priority misses are null."""
    return report.trend(fixture(spark, sf, "fx_kpi_orders"), 14)


# ----------------------------------------------------------------------- NPS

def _fb(spark, sf):
    return fixture(spark, sf, "fx_feedback")


def _cust(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"),
                                               F.col("c_mktsegment").alias("segment"))


NPS_SQL = """count(score) AS responses, CAST(sum(CASE WHEN score >= 9 THEN 1 ELSE 0 END) AS BIGINT) AS promoters,
  CAST(sum(CASE WHEN score BETWEEN 7 AND 8 THEN 1 ELSE 0 END) AS BIGINT) AS passives,
  CAST(sum(CASE WHEN score <= 6 THEN 1 ELSE 0 END) AS BIGINT) AS detractors,
  round(sum(CASE WHEN score >= 9 THEN 1 ELSE 0 END) * 100.0 / count(score)
        - sum(CASE WHEN score <= 6 THEN 1 ELSE 0 END) * 100.0 / count(score), 1) AS nps_score"""


@register("a15_nps_by_day", with_fixtures(f"SELECT submitted_at, {NPS_SQL} FROM fx_feedback GROUP BY 1"))
def q_a15_day(spark, sf):
    """Daily NPS summary."""
    return nps.nps(_fb(spark, sf), by=["submitted_at"])


@register("a15_nps_by_channel", with_fixtures(f"SELECT channel, {NPS_SQL} FROM fx_feedback GROUP BY 1"))
def q_a15_channel(spark, sf):
    """NPS per channel."""
    return nps.nps(_fb(spark, sf), by=["channel"])


@register("a15_nps_by_segment", with_fixtures(f"""
SELECT c.c_mktsegment AS segment, {NPS_SQL} FROM fx_feedback f JOIN customer c ON c.c_custkey = f.customer_id GROUP BY 1"""))
def q_a15_segment(spark, sf):
    """A15 + J10: NPS per customer segment."""
    return nps.nps(nps.feedback_by(_fb(spark, sf), _cust(spark, sf)), by=["segment"])


@register("a16_weekly_median", with_fixtures("""
SELECT CAST(date_trunc('week', submitted_at) AS DATE) AS week, channel, CAST(median(score) AS DOUBLE) AS median_value,
       count(*) AS responses FROM fx_feedback GROUP BY 1, 2"""))
def q_a16(spark, sf):
    """Weekly median score per channel."""
    return nps.weekly_median(_fb(spark, sf), "score", "submitted_at", ["channel"])


@register("a17_segment_scores", with_fixtures("""
SELECT c.c_mktsegment AS segment, round(avg(f.score), 2) AS avg_score, count(*) AS responses
FROM fx_feedback f JOIN customer c ON c.c_custkey = f.customer_id GROUP BY 1"""))
def q_a17(spark, sf):
    """Average score and responses per segment."""
    return nps.segment_scores(_fb(spark, sf), _cust(spark, sf))


@register("w5_ranked_daily_channel", with_fixtures(f"""
SELECT *, CAST(row_number() OVER (PARTITION BY channel ORDER BY day DESC) AS INT) AS day_rank
FROM (SELECT channel, submitted_at AS day, {NPS_SQL} FROM fx_feedback GROUP BY 1, 2)"""))
def q_w5(spark, sf):
    """Daily NPS per channel ranked newest first."""
    return nps.ranked_daily(_fb(spark, sf), "channel", "submitted_at")


@register("j10_feedback_with_customer", with_fixtures("""
SELECT f.customer_id, f.id, f.score, f.channel, f.submitted_at, f.feedback_text, c.c_name AS name, c.c_mktsegment AS segment
FROM fx_feedback f JOIN customer c ON c.c_custkey = f.customer_id"""))
def q_j10(spark, sf):
    """Every feedback row with its customer's name and segment."""
    return nps.feedback_by(_fb(spark, sf), _cust(spark, sf))


@register("t6_detractors", with_fixtures("""
SELECT d.customer_id, d.id, d.score, d.channel, d.submitted_at, d.feedback_text, c.c_name AS name, c.c_mktsegment AS segment
FROM (SELECT * FROM fx_feedback WHERE score <= 6 ORDER BY submitted_at DESC, id DESC LIMIT 10) d
LEFT JOIN customer c ON c.c_custkey = d.customer_id"""))
def q_t6(spark, sf):
    """Newest 10 detractors with customer details."""
    return nps.detractors(_fb(spark, sf), _cust(spark, sf), 10)


@register("t6_detractors_text_search", with_fixtures("""
SELECT d.customer_id, d.id, d.score, d.channel, d.submitted_at, d.feedback_text, c.c_name AS name, c.c_mktsegment AS segment
FROM (SELECT * FROM fx_feedback WHERE score <= 6
        AND (lower(feedback_text) LIKE '%urgent%' OR lower(feedback_text) LIKE '%high%')
        AND submitted_at >= DATE '1998-01-01'
      ORDER BY submitted_at DESC, id DESC LIMIT 10) d
LEFT JOIN customer c ON c.c_custkey = d.customer_id"""))
def q_t6_search(spark, sf):
    """T6 with text search: detractors mentioning 'urgent' or 'high' since 1998."""
    return nps.detractors(_fb(spark, sf), _cust(spark, sf), 10, contains=["urgent", "high"], since="1998-01-01")


# ------------------------------------------------------------ P3, P5, P10, U3

_RENAMED = """CASE WHEN kpi_name = '5-LOW' THEN 'net_revenue' WHEN kpi_name = '4-NOT SPECIFIED' THEN 'Inventory Value'
  WHEN kpi_name = '3-MEDIUM' THEN 'support_tickets' WHEN kpi_name = '2-HIGH' AND user_id % 2 = 0 THEN NULL
  ELSE kpi_name END"""


@register("p3_hide_retired", with_fixtures(f"""
SELECT department_id, user_id, recorded_at, name AS kpi_name FROM (
  SELECT department_id, user_id, recorded_at, {_RENAMED} AS name FROM fx_kpi_results)
WHERE NOT coalesce(name IN ('net_revenue', 'inventory_value', 'support_tickets', 'Total Revenue', 'Inventory Value',
  'Support Tickets') OR {_py_title('name')} IN ('net_revenue', 'inventory_value', 'support_tickets', 'Total Revenue',
  'Inventory Value', 'Support Tickets'), false)"""))
def q_p3(spark, sf):
    """Retired KPI names (exact or title-cased) are hidden; null names stay.
    Three priorities are renamed to retired names first."""
    from autokpi.operators.frame import hide_retired
    kr = fixture(spark, sf, "fx_kpi_results").select("department_id", "user_id", "recorded_at",
                                                     F.expr(_RENAMED).alias("kpi_name"))
    return hide_retired(kr)


_REPORT_TEXT = """CASE WHEN o_orderkey % 7 = 0 THEN NULL
  ELSE 'Order ' || CAST(o_orderkey AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN ': Net Revenue is 190,000.' ELSE '' END ||
       CASE WHEN o_orderkey % 3 = 0 THEN ' Inventory Value is 5.' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN ' Support Tickets is 150.' ELSE '' END END"""


@register("p3_hide_retired_reports", f"""
SELECT o_orderkey, narrative FROM (SELECT o_orderkey, {_REPORT_TEXT} AS narrative FROM orders)
WHERE o_orderkey % 7 = 0 OR NOT (o_orderkey % 30 = 0)""")
def q_p3_reports(spark, sf):
    """Reports that hold all three marker phrases are hidden; others, and null texts, stay."""
    from autokpi.operators.frame import hide_retired_reports
    return hide_retired_reports(table(spark, sf, "orders").select("o_orderkey", F.expr(_REPORT_TEXT).alias("narrative")))


_MESSAGE = """CASE o_orderkey % 5 WHEN 0 THEN 'NET_REVENUE moved by ' || CAST(o_totalprice AS STRING) WHEN 1 THEN 'Support tickets: none'
  WHEN 2 THEN NULL WHEN 3 THEN 'Net revenues of inventory value' ELSE 'All fields present' END"""


@register("p3_hide_retired_messages", f"""
SELECT o_orderkey, message FROM (SELECT o_orderkey, {_MESSAGE} AS message FROM orders) WHERE o_orderkey % 5 IN (2, 4)""")
def q_p3_messages(spark, sf):
    """Messages that name a retired KPI, in either spelling and any case, are hidden."""
    from autokpi.operators.frame import hide_retired_messages
    return hide_retired_messages(table(spark, sf, "orders").select("o_orderkey", F.expr(_MESSAGE).alias("message")))


@register("p5_json_safe_orders", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate,
       o_orderpriority FROM orders""")
def q_p5(spark, sf):
    """P5: JSON-safe projection of orders (timestamps as ISO text)."""
    from autokpi.operators.frame import json_safe
    return json_safe(table(spark, sf, "orders"))


@register("p10_due_departments", with_fixtures("""
SELECT id AS department_id, '02:00' AS sync_time, heartbeat_schedule AS sync_frequency,
       TIMESTAMP '2024-01-01 02:00:00' AS due_at FROM fx_departments WHERE heartbeat_schedule IN ('daily', 'weekly')
UNION ALL
SELECT id, '02:00', heartbeat_schedule, TIMESTAMP '2024-01-02 02:00:00' FROM fx_departments
WHERE heartbeat_schedule = 'daily'"""))
def q_p10_depts(spark, sf):
    """P10 department variant (no yearly rule): heartbeats due on a Monday and on a Tuesday."""
    d = fixture(spark, sf, "fx_departments").select(F.col("id").alias("department_id"), F.lit("02:00").alias("sync_time"),
                                                    F.col("heartbeat_schedule").alias("sync_frequency"))
    return report.due(d, "2024-01-01 02:00:00", yearly=False).unionByName(
        report.due(d, "2024-01-02 02:00:00", yearly=False))


@register("u3_distinct_report_keys", with_fixtures("""
SELECT DISTINCT coalesce(CAST(report_date AS STRING), '') AS report_date,
       coalesce(customer_id, 'ACCOUNT-PRIMARY') AS customer_id FROM fx_frame"""))
def q_u3(spark, sf):
    """A frame without KPI names gives the distinct (report_date, customer_id) keys."""
    from autokpi.operators import quality
    return quality.validation_frame(fixture(spark, sf, "fx_frame").drop("kpi_name"))
