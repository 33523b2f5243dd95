"""Queries: canonical frame, extraction, KPI metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from autokpi.functions.core import round_half_up
from autokpi.operators import extract, frame, kpi
from autokpi.plans.fixtures import fixture, table, with_fixtures
from autokpi.plans.registry import register
from autokpi.sinks import tables as sinks


def w1_parts(src: str, latest_only: bool = True, keys=("kpi_name",)) -> tuple[list[tuple[str, str]], str]:
    """Oracle text for W1 over a daily CTE ``src(keys..., date DATE, value)``:
    (CTEs, final SELECT)."""
    k = ", ".join(keys)
    last = "AND rn = n" if latest_only else ""
    w = f"PARTITION BY {k} ORDER BY date"
    wd = f"PARTITION BY {k}, isodow(date) ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    hist = f"{w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    m = f"""SELECT {k}, date, value,
    row_number() OVER ({w}) AS rn, count(*) OVER (PARTITION BY {k}) AS n,
    lag(value, 1) OVER ({w}) AS prev, lag(value, 7) OVER ({w}) AS lag7,
    first_value(value) OVER ({w}) AS first_v,
    avg(value) OVER ({w} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS avg7,
    avg(value) OVER ({hist}) AS mean_all, stddev_samp(value) OVER ({hist}) AS std_all,
    count(value) OVER ({wd}) AS cnt_wd, avg(value) OVER ({wd}) AS mean_wd, stddev_samp(value) OVER ({wd}) AS std_wd
  FROM {src}"""
    b = f"""SELECT *, CASE WHEN cnt_wd >= 4 THEN mean_wd ELSE mean_all END AS mean_b,
            CASE WHEN cnt_wd >= 4 THEN std_wd ELSE std_all END AS std_b, coalesce(lag7, first_v) AS wbase
  FROM m WHERE rn >= 2 {last}"""
    z = "SELECT *, CASE WHEN std_b > 0 THEN abs(value - mean_b) / std_b ELSE 0.0 END AS z FROM b"
    final = f"""SELECT {k}, date AS recorded_at, round(value, 2) AS value,
  round(CASE WHEN prev <> 0 THEN (value - prev) / prev * 100 ELSE 0.0 END, 2) AS dod_pct,
  round(CASE WHEN wbase <> 0 THEN (value - wbase) / wbase * 100 ELSE 0.0 END, 2) AS wow_pct,
  round(avg7, 2) AS avg_7d, round(z, 2) AS z_score, round(mean_b, 2) AS baseline_mean,
  CASE WHEN cnt_wd >= 4 THEN 'same_weekday' ELSE 'all_history' END AS baseline,
  CASE WHEN z > 2.5 THEN 'CRITICAL' WHEN z > 1.5 THEN 'WARNING' ELSE 'NORMAL' END AS status
FROM z"""
    return [("m", m), ("b", b), ("z", z)], final


def _w1_oracle(src_sql: str, latest_only: bool = True) -> str:
    ctes, final = w1_parts("d", latest_only)
    return with_fixtures(final, ("d", src_sql), *ctes)


W2_SELECT = """SELECT {keys}recorded_at, status AS severity, z_score AS deviation, baseline,
  'Value ' || printf('%.2f', value) || CASE WHEN status = 'CRITICAL' THEN ' is exceptionally far from the '
    ELSE ' is notable compared to the ' END ||
  CASE WHEN baseline = 'same_weekday' THEN 'same-weekday average' ELSE 'historical average' END ||
  ' of ' || printf('%.2f', baseline_mean) AS reason
FROM metrics WHERE status <> 'NORMAL'"""


DAILY_EVENTS = ("SELECT kpi_name, CAST(date AS DATE) AS date, SUM(value) AS value FROM fx_frame "
                "GROUP BY kpi_name, CAST(date AS DATE)")
DAILY_ORDERS = ("SELECT o_orderpriority AS kpi_name, CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS value "
                "FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)")


def order_counts(spark, sf):
    """KPI frame of orders: one unit per order, so daily sums are exact counts."""
    return table(spark, sf, "orders").select(F.col("o_orderdate").alias("date"),
                                             F.col("o_orderpriority").alias("kpi_name"),
                                             F.lit(1.0).alias("value"))


@register("w1_kpi_metrics_events", _w1_oracle(DAILY_EVENTS))
def q_w1_events(spark, sf):
    """Flagship: latest KPI movement + anomaly status per event type."""
    return kpi.kpi_metrics(fixture(spark, sf, "fx_frame"))


@register("w1_kpi_metrics_orders_all_rows", _w1_oracle(DAILY_ORDERS, latest_only=False))
def q_w1_orders(spark, sf):
    """W1 for every day of every order priority (daily order counts; long, gappy series)."""
    return kpi.kpi_metrics(order_counts(spark, sf), latest_only=False)


def _w2_oracle(src_sql: str, latest_only: bool) -> str:
    ctes, final = w1_parts("d", latest_only)
    return with_fixtures(W2_SELECT.format(keys="kpi_name, "), ("d", src_sql), *ctes, ("metrics", final))


@register("w2_anomalies_orders", _w2_oracle(DAILY_ORDERS, latest_only=False))
def q_w2_orders(spark, sf):
    return kpi.anomalies(kpi.kpi_metrics(order_counts(spark, sf), latest_only=False))


@register("w2_anomalies_events", _w2_oracle(DAILY_EVENTS, latest_only=False))
def q_w2_events(spark, sf):
    return kpi.anomalies(kpi.kpi_metrics(fixture(spark, sf, "fx_frame"), latest_only=False))


@register("p1_canonicalise_dirty", with_fixtures("""
SELECT TRY_CAST(date AS TIMESTAMP) AS date, kpi_name, TRY_CAST(value AS DOUBLE) AS value,
  sha256(concat_ws(chr(31), coalesce(date, '\\N'), coalesce(kpi_name, '\\N'), coalesce(value, '\\N'),
                   coalesce(category, '\\N'), CAST(event_id AS STRING)))
    || '-' || CAST(row_number() OVER (PARTITION BY date, kpi_name, value, category, event_id) AS STRING) AS source_row_id,
  kpi_name AS record_label,
  printf('CUST-%04d', row_number() OVER (ORDER BY TRY_CAST(date AS TIMESTAMP), kpi_name, TRY_CAST(value AS DOUBLE), event_id)) AS customer_id,
  CAST(TRY_CAST(date AS TIMESTAMP) AS DATE) AS report_date, category, event_id
FROM fx_dirty
WHERE TRY_CAST(date AS TIMESTAMP) IS NOT NULL AND kpi_name IS NOT NULL AND TRY_CAST(value AS DOUBLE) IS NOT NULL"""))
def q_p1(spark, sf):
    """P1 on dirty rows: coercion, drops, hashed row ids, positional customer ids."""
    return frame.canonicalise(fixture(spark, sf, "fx_dirty"), order_by=["date", "kpi_name", "value", "event_id"])


@register("p4_trailing_30d_events", with_fixtures("""
SELECT event_id, ts, event_type, value FROM events
WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 30 DAY"""))
def q_p4(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    return frame.trailing(ev, "ts", 30, "2024-01-30")


@register("a1_daily_totals_orders", """
SELECT CAST(o_orderdate AS DATE) AS date, 'Orders' AS kpi_name, round(SUM(o_totalprice), 2) AS value
FROM orders
WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY
GROUP BY CAST(o_orderdate AS DATE)""")
def q_a1(spark, sf):
    """A1: trailing-30-day daily sums; as_of = newest order date."""
    out = extract.daily_totals(table(spark, sf, "orders"), "o_totalprice", "o_orderdate", "Orders")
    return out.withColumn("value", round_half_up("value", 2))


@register("u1_union_daily_totals", """
SELECT CAST(o_orderdate AS DATE) AS date, 'Orders' AS kpi_name, round(SUM(o_totalprice), 2) AS value
FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY
GROUP BY CAST(o_orderdate AS DATE)
UNION ALL
SELECT CAST(l_shipdate AS DATE), 'Lineitem', round(SUM(l_extendedprice), 2) FROM lineitem
WHERE l_shipdate > (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 30 DAY
GROUP BY CAST(l_shipdate AS DATE)
UNION ALL
SELECT CAST(ts AS DATE), 'Events', round(SUM(value), 2) FROM events
WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 30 DAY
GROUP BY CAST(ts AS DATE)""")
def q_u1(spark, sf):
    """U1 over A1 of three tables (orders, lineitem, events)."""
    frames = [
        extract.daily_totals(table(spark, sf, "orders"), "o_totalprice", "o_orderdate", "Orders"),
        extract.daily_totals(table(spark, sf, "lineitem"), "l_extendedprice", "l_shipdate", "Lineitem"),
        extract.daily_totals(table(spark, sf, "events"), "value", "ts", "Events"),
    ]
    return extract.union_frames(frames).withColumn("value", round_half_up("value", 2))


@register("w3_latest_kpi_per_department", with_fixtures("""
SELECT department_id, kpi_name, recorded_at, user_id, value, source_record_count, status FROM (
  SELECT *, row_number() OVER (PARTITION BY department_id, kpi_name ORDER BY recorded_at DESC, user_id DESC) AS rn
  FROM fx_kpi_results) WHERE rn = 1"""))
def q_w3(spark, sf):
    """Newest KPI result per (department, kpi)."""
    kr = fixture(spark, sf, "fx_kpi_results")
    out = kpi.latest_per(kr, ["department_id", "kpi_name"], ["recorded_at", "user_id"])
    return out.select("department_id", "kpi_name", "recorded_at", "user_id", "value", "source_record_count", "status")


@register("w3_latest_kpi_within_newest_25", with_fixtures("""
SELECT department_id, kpi_name, recorded_at, user_id, value, source_record_count, status, rn <= 25 AS within_newest FROM (
  SELECT *, row_number() OVER (PARTITION BY department_id, kpi_name ORDER BY recorded_at DESC, user_id DESC) AS rn2,
         row_number() OVER (PARTITION BY department_id ORDER BY recorded_at DESC, user_id DESC, kpi_name DESC) AS rn
  FROM fx_kpi_results) WHERE rn2 = 1"""))
def q_w3_within(spark, sf):
    """Newest result of every KPI, and whether it is among its department's newest 25 rows."""
    kr = fixture(spark, sf, "fx_kpi_results")
    out = kpi.latest_per(kr, ["department_id", "kpi_name"], ["recorded_at", "user_id"], mark_within=(["department_id"], 25))
    return out.select("department_id", "kpi_name", "recorded_at", "user_id", "value", "source_record_count", "status", "within_newest")


@register("k4_lineage_records", with_fixtures("""
SELECT CAST(department_id AS STRING) || ':' || CAST(recorded_at AS STRING) AS batch_source_id,
  kpi_name, CAST(user_id AS STRING) AS source_record_id, kpi_name AS record_label, recorded_at AS record_date,
  coalesce(TRY_CAST(value AS DOUBLE), 0.0) AS record_value, department_id AS p_department, user_id AS p_user, kpi_name AS p_kpi,
  CAST(recorded_at AS STRING) AS p_recorded, value AS p_value, source_record_count AS p_count, status AS p_status,
  CAST(department_id AS STRING) || ':' || CAST(recorded_at AS STRING) AS p_batch, 8 AS p_fields
FROM fx_kpi_results"""))
def q_k4(spark, sf):
    """K4: lineage rows (batch id = department:day); the full-row JSON payload is read back field by field."""
    kr = fixture(spark, sf, "fx_kpi_results")
    kr = kr.withColumn("batch_source_id", F.concat_ws(":", F.col("department_id").cast("string"),
                                                      F.col("recorded_at").cast("string")))
    out = sinks.lineage(kr, batch_col="batch_source_id", id_col="user_id", label_col="kpi_name",
                        date_col="recorded_at")
    read = F.from_json("raw_payload", "department_id int, user_id int, kpi_name string, recorded_at string, value double, "
                                      "source_record_count bigint, status string, batch_source_id string")
    names = {"p_department": "department_id", "p_user": "user_id", "p_kpi": "kpi_name", "p_recorded": "recorded_at", "p_value": "value",
             "p_count": "source_record_count", "p_status": "status", "p_batch": "batch_source_id"}
    out = out.withColumn("p", read).withColumn("p_fields", F.size(F.json_object_keys("raw_payload")))
    return out.select("*", *[F.col(f"p.{c}").alias(n) for n, c in names.items()]).drop("p", "raw_payload")


@register("k5_changed_only_status", with_fixtures("""
SELECT department_id, kpi_name, recorded_at, status FROM (
  SELECT department_id, kpi_name, recorded_at, status,
         lag(status) OVER (PARTITION BY department_id, kpi_name ORDER BY recorded_at, user_id) AS prev_status
  FROM fx_kpi_results) WHERE prev_status IS DISTINCT FROM status"""))
def q_k5(spark, sf):
    """K5: keep a history row only when the status changed from the newest stored one."""
    kr = fixture(spark, sf, "fx_kpi_results")
    out = sinks.changed_only(kr, ["department_id", "kpi_name"], ["recorded_at", "user_id"], "status")
    return out.select("department_id", "kpi_name", "recorded_at", "status")
