"""Queries: sources, table maintenance and pipelines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autokpi.functions.core import round_half_up

from autokpi.plans import sync
from autokpi.plans import q_analyses, q_discover, q_misc, q_quality  # noqa: F401 -- their oracles
from autokpi.plans.fixtures import FAULTY_SQL, fixture, table, with_fixtures
from autokpi.plans.q_core import DAILY_EVENTS, W2_SELECT, w1_parts
from autokpi.plans.registry import ORACLES, register
from autokpi.session import ensure_checkpoint_dir
from autokpi.sinks import tables as sinks
from autokpi.sources import readers


@register("s2_read_documents_events", """
SELECT ts AS date, CAST(CAST(json_extract(props, '$.k') AS INTEGER) AS DOUBLE) AS value, 'event_docs.k' AS kpi_name
FROM events""")
def q_s2(spark, sf):
    """Two collections built from events: the raw one has no date-like field
    (skipped); ``event_docs`` (created_at, k, value) yields ``event_docs.k``."""
    ev = table(spark, sf, "events")
    docs = ev.select(F.col("ts").alias("created_at"), F.from_json("props", "k INT")["k"].alias("k"), "value")
    return readers.read_documents(spark, {"events": ev.select("ts", "value", "props"), "event_docs": docs})


@register("s3_read_source_parquet", "SELECT * FROM lineitem")
def q_s3(spark, sf):
    """S3: a Parquet table read through ``read_source``."""
    return readers.read_source(spark, {"format": "parquet", "path": f"{sf.rstrip('/')}/lineitem.parquet"})


@register("s10_run_sql", """
SELECT * FROM (SELECT o_orderpriority, count(*) AS n, max(o_orderdate) AS created_at
               FROM orders GROUP BY 1 ORDER BY n DESC)""")
def q_s10(spark, sf):
    """A user's read-only query (a column named created_at is allowed)."""
    sql = ("SELECT o_orderpriority, count(*) AS n, max(o_orderdate) AS created_at "
           "FROM orders GROUP BY 1 ORDER BY n DESC")
    return readers.run_sql(spark, sql, {"orders": table(spark, sf, "orders")})


@register("s11_ingest_summary", with_fixtures("""
SELECT json_extract_string(payload, '$.department') AS department,
       json_extract_string(payload, '$.report_date') AS report_date,
       json_extract_string(payload, '$.kpis[0].kpi_name') AS kpi_name,
       CAST(json_extract(payload, '$.kpis[0].value') AS DOUBLE) AS value,
       'Ingested summary for ' || json_extract_string(payload, '$.department') || ' on '
         || json_extract_string(payload, '$.report_date') || '.' AS narrative
FROM fx_ingest"""))
def q_s11(spark, sf):
    """Department summary documents -> combined-report rows (map exploded)."""
    rep = readers.ingest_summary(fixture(spark, sf, "fx_ingest"))
    return rep.select("department", "report_date", F.explode("combined_kpis").alias("kpi_name", "value"), "narrative")


KEYS = ["department_id", "user_id", "kpi_name", "recorded_at"]


@register("k2_upsert_kpi_results", with_fixtures("""
SELECT department_id, user_id, kpi_name, recorded_at, value, version FROM (
  SELECT *, row_number() OVER (PARTITION BY department_id, user_id, kpi_name, recorded_at
                               ORDER BY version DESC, src DESC) AS rn
  FROM (SELECT department_id, user_id, kpi_name, recorded_at, value, 1 AS version, 0 AS src FROM fx_kpi_results
        UNION ALL
        SELECT department_id, user_id, kpi_name, recorded_at, round(value * 2, 2), 2, 1 FROM fx_kpi_results
        WHERE kpi_name = '1-URGENT'
        UNION ALL
        SELECT department_id, user_id, '9-NEW', recorded_at, value, 2, 1 FROM fx_kpi_results WHERE kpi_name = '2-HIGH'))
WHERE rn = 1"""))
def q_k2(spark, sf):
    """K2: keyed upsert (last write wins): urgent rows rewritten, new KPI rows added."""
    kr = fixture(spark, sf, "fx_kpi_results").select(*KEYS, "value").withColumn("version", F.lit(1))
    changes = (kr.filter(F.col("kpi_name") == "1-URGENT").withColumn("value", round_half_up(F.col("value") * 2, 2))
               .withColumn("version", F.lit(2))
               .unionByName(kr.filter(F.col("kpi_name") == "2-HIGH").withColumn("kpi_name", F.lit("9-NEW"))
                            .withColumn("version", F.lit(2))))
    return sinks.upsert_frame(kr, changes, KEYS, "version")


@register("k3_purge_kpi_results", with_fixtures("""
SELECT * FROM fx_kpi_results
WHERE NOT coalesce(kpi_name ILIKE '%urgent%' OR status IN ('CRITICAL') OR (CASE WHEN value > 400000 THEN NULL ELSE false END), false)"""))
def q_k3(spark, sf):
    """K3: purge rows whose name matches '%urgent%' (ILIKE) or that are CRITICAL;
    rows where the predicate is null survive."""
    kr = fixture(spark, sf, "fx_kpi_results")
    pred = (F.col("kpi_name").ilike("%urgent%") | F.col("status").isin("CRITICAL")
            | F.when(F.col("value") > 400000, F.lit(None).cast("boolean")).otherwise(F.lit(False)))
    return sinks.purge_frame(kr, pred)


_L1_CTES, _L1_FINAL = w1_parts("d", True)


@register("l1_sync_kpis", with_fixtures("""
SELECT m.*, c.source_record_count FROM metrics m
LEFT JOIN (SELECT kpi_name, count(*) AS source_record_count FROM fx_frame GROUP BY 1) c USING (kpi_name)""",
    ("d", DAILY_EVENTS), *_L1_CTES, ("metrics", _L1_FINAL)))
def q_l1(spark, sf):
    """L1: the KPI results of a full sync of the event frame (W1 + row counts)."""
    out = sync.sync(fixture(spark, sf, "fx_frame"))
    return out["kpis"]


_STORED = """SELECT CASE WHEN user_id % 4 = 0 THEN NULL ELSE department_id END AS department_id, user_id, kpi_name, recorded_at, value, status
FROM fx_kpi_results"""


def _stored(spark, sf, name: str) -> tuple[str, DataFrame]:
    """A new folder beside the checkpoints, and KPI results of which some have no department."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows = fixture(spark, sf, "fx_kpi_results").select(
        F.when(F.col("user_id") % 4 != 0, F.col("department_id")).alias("department_id"), "user_id", "kpi_name", "recorded_at", "value", "status")
    return folder, rows


@register("k1_append_stored", with_fixtures("SELECT * FROM r", ("r", _STORED)))
def q_k1(spark, sf):
    """K1: two batches appended to a partitioned table and read back (some rows have no department)."""
    path, rows = _stored(spark, sf, "k1")
    sinks.append(rows.filter("status = 'NORMAL'"), path, "department_id")
    sinks.append(rows.filter("status <> 'NORMAL'"), path, "department_id")
    return spark.read.parquet(path).select(rows.columns)


@register("k2_upsert_stored", with_fixtures("""
SELECT department_id, user_id, kpi_name, recorded_at, CASE WHEN user_id % 3 = 0 AND (department_id IS NULL OR department_id = 2) THEN value * 2 ELSE value END AS value,
  CASE WHEN user_id % 3 = 0 AND (department_id IS NULL OR department_id = 2) THEN 'CHANGED' ELSE status END AS status FROM r""", ("r", _STORED)))
def q_k2_stored(spark, sf):
    """K2 on a stored table: changed rows of the department 2 and of none; the other rows of both partitions stay."""
    path, rows = _stored(spark, sf, "k2")
    sinks.append(rows, path, "department_id")
    changes = rows.filter("user_id % 3 = 0 and (department_id is null or department_id = 2)")
    changes = changes.withColumn("value", F.col("value") * 2).withColumn("status", F.lit("CHANGED"))
    sinks.upsert(spark, path, changes, ["department_id", "user_id", "kpi_name", "recorded_at"], "recorded_at", "department_id")
    return spark.read.parquet(path).select(rows.columns)


@register("k3_purge_stored", with_fixtures("""
SELECT * FROM r WHERE NOT coalesce(department_id = 1 OR (department_id IS NULL AND status = 'CRITICAL'), false)""", ("r", _STORED)))
def q_k3_stored(spark, sf):
    """K3 on a stored table: a whole department and some rows without one go; other partitions are not rewritten."""
    path, rows = _stored(spark, sf, "k3")
    sinks.append(rows, path, "department_id")
    sinks.purge(spark, path, F.expr("department_id = 1 or (department_id is null and status = 'CRITICAL')"), "department_id")
    return spark.read.parquet(path).select(rows.columns)


def _a1(tab: str, amt: str, dt: str, label: str) -> str:
    return (f"SELECT CAST(CAST({dt} AS DATE) AS TIMESTAMP) AS date, '{label}' AS kpi_name, round(sum({amt}), 2) AS value "
            f"FROM {tab} WHERE {dt} > (SELECT max({dt}) FROM {tab}) - INTERVAL 30 DAY GROUP BY CAST({dt} AS DATE)")


@register("l1_extract_discovered", with_fixtures(" UNION ALL ".join([
    _a1("orders", "o_totalprice", "o_orderdate", "Orders"),
    _a1("lineitem", "l_extendedprice", "l_shipdate", "Product"),
    _a1("contributions", "amount", "paid_at", "Contribution"),
    _a1("payments", "amount", "payment_date", "Payment"),
    _a1("pensions", "monthly_amount", "paid_on", "Beneficiary")])))
def q_l1_extract(spark, sf):
    """L1 extraction: trailing-30-day daily sums of every table with an amount
    and a date column, labelled by its first domain (driver + demo tables)."""
    from autokpi.plans.q_discover import _tables
    fr = sync.extract(spark, _tables(spark, sf))
    return fr.select("date", "kpi_name", round_half_up("value", 2).alias("value"))


@register("l1_extract_status_dirty", with_fixtures(f"""
SELECT 'contributions_ok' AS table_name, 'Contribution' AS label, 'synced' AS outcome,
  (SELECT count(DISTINCT CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY) AS days,
  (SELECT count(*) FROM orders) AS rows_read, 0 AS rows_rejected
UNION ALL SELECT 'payments_dirty', 'Payment', 'synced',
  (SELECT count(DISTINCT CAST(t AS DATE)) FROM (SELECT TRY_CAST(date AS TIMESTAMP) AS t FROM fx_dirty)
   WHERE t > (SELECT max(TRY_CAST(date AS TIMESTAMP)) FROM fx_dirty) - INTERVAL 30 DAY),
  (SELECT count(*) FROM fx_dirty), (SELECT count(*) FROM fx_dirty WHERE (value IS NOT NULL AND TRY_CAST(value AS DOUBLE) IS NULL)
      OR (date IS NOT NULL AND TRY_CAST(date AS TIMESTAMP) IS NULL))
UNION ALL SELECT 'pensions_broken', 'Pension', 'failed', NULL, NULL, NULL
UNION ALL SELECT 'claims_undated', 'Claim', 'skipped', NULL, NULL, NULL
UNION ALL SELECT 'stock_plain', 'Inventory', 'skipped', NULL, NULL, NULL"""))
def q_l1_extract_dirty(spark, sf):
    """L1 extraction from tables with faults: outcome, days and rows of each; the broken one ends only itself."""
    out = sync.extract_isolated(spark, {t: fixture(spark, sf, t) for t in FAULTY_SQL})
    return out["status"].drop("error")


def _synced(spark, sf):
    """The full sync of the event frame, with mappings of the fixture fields."""
    return sync.sync(fixture(spark, sf, "fx_frame"), fields=fixture(spark, sf, "fx_fields"), mappings=fixture(spark, sf, "fx_mappings"),
                     batch_id="b1", depts=fixture(spark, sf, "fx_departments"), department_id=1)


@register("l1_sync_frame", with_fixtures("""
SELECT source_row_id, kpi_name, value, value * 100.0 AS event_value FROM fx_frame"""))
def q_l1_frame(spark, sf):
    """L1: the mapped frame (the event type is no column of a canonical frame, so that mapping is skipped)."""
    return _synced(spark, sf)["frame"].select("source_row_id", "kpi_name", "value", "event_value")


_L1_AN = [("d", DAILY_EVENTS), *_L1_CTES, ("metrics", _L1_FINAL)]


@register("l1_sync_anomalies", with_fixtures(W2_SELECT.format(keys="kpi_name, "), *_L1_AN))
def q_l1_anomalies(spark, sf):
    """L1: the anomalies of the sync."""
    return _synced(spark, sf)["anomalies"]


register("l1_sync_forecasts", ORACLES["f3_forecast_events"])(lambda spark, sf: _synced(spark, sf)["forecasts"])


@register("l1_sync_lineage", with_fixtures("""
SELECT 'b1' AS batch_source_id, kpi_name, source_row_id AS source_record_id, record_label, report_date AS record_date,
  coalesce(value, 0.0) AS record_value, customer_id AS p_customer, value AS p_value FROM fx_frame"""))
def q_l1_lineage(spark, sf):
    """L1: the lineage of the sync, two fields read back from the payload."""
    out = _synced(spark, sf)["lineage"]
    return out.select("*", F.get_json_object("raw_payload", "$.customer_id").alias("p_customer"),
                      F.get_json_object("raw_payload", "$.value").cast("double").alias("p_value")).drop("raw_payload")


@register("l1_sync_combined", with_fixtures("""
SELECT k.recorded_at AS report_date, coalesce(d.name, 'Unassigned') AS department_name, k.kpi_name, k.value
FROM metrics k LEFT JOIN fx_departments d ON d.id = 1""", *_L1_AN))
def q_l1_combined(spark, sf):
    """L1: the combined report of the sync, its department map as rows."""
    out = _synced(spark, sf)["combined"]
    per = out.select("report_date", F.explode("department_breakdown").alias("department_name", "m"))
    return per.select("report_date", "department_name", F.explode("m").alias("kpi_name", "value"))


@register("l1_sync_briefing", with_fixtures("""
SELECT max(CASE status WHEN 'CRITICAL' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) AS severity,
       count(*) AS kpis, count(*) FILTER (WHERE status <> 'NORMAL') AS anomaly_count FROM metrics""", *_L1_AN))
def q_l1_briefing(spark, sf):
    """L1: the briefing of the sync: overall colour, lines of KPIs, anomalies."""
    b = _synced(spark, sf)["briefing"]
    severity = F.when(F.col("overall_status") == "RED", 2).when(F.col("overall_status") == "AMBER", 1).otherwise(0)
    return b.select(severity.alias("severity"), F.size(F.split("kpi_text", "\n")).cast("bigint").alias("kpis"), "anomaly_count")


_L4_CTES, _L4_FINAL = w1_parts("d", True)


@register("l4_analyst_explanations", with_fixtures("""
SELECT m.kpi_name, m.z_score, e.explanation FROM (SELECT kpi_name, z_score FROM metrics ORDER BY z_score DESC, kpi_name LIMIT 3) m
JOIN (""" + q_misc.EXPLAIN_SQL + """) e USING (kpi_name)""", ("d", DAILY_EVENTS), *_L4_CTES, ("metrics", _L4_FINAL)))
def q_l4(spark, sf):
    """L4: the analyst run's top-3 explained KPIs of the event frame."""
    frame = fixture(spark, sf, "fx_frame")
    out = sync.analyst(frame, fixture(spark, sf, "fx_validation_logs"), 4, True, "2024-02-03")
    return out["explanations"].select("kpi_name", "z_score", "explanation")


@register("l4_analyst_insights", ORACLES["f8_insights_events"])
def q_l4_insights(spark, sf):
    """L4: the analyst run's insights of the event frame (as of 2024-02-12)."""
    out = sync.analyst(fixture(spark, sf, "fx_frame"), fixture(spark, sf, "fx_validation_logs"), 4, True, "2024-02-12 00:00:00")
    return out["insights"]


def _dirty_analyst(spark, sf):
    logs = fixture(spark, sf, "fx_validation_logs")
    days = F.datediff(F.lit("2024-02-03").cast("date"), logs.agg(F.max(F.to_date("created_at"))).scalar())
    return sync.analyst(fixture(spark, sf, "fx_dirty"), logs, days, True, "2024-02-03", account="category")


@register("l4_analyst_actions", ORACLES["v6_prepare_actions"])
def q_l4_actions(spark, sf):
    """L4: what the analyst run does to prepare the dirty frame."""
    return _dirty_analyst(spark, sf)["actions"]


@register("l4_analyst_governance", ORACLES["f9_governance_dirty"])
def q_l4_governance(spark, sf):
    """L4: the analyst run's governance score of the dirty frame."""
    return _dirty_analyst(spark, sf)["governance"]


@register("l2_overview_kpis", """
SELECT 'Table rows: ' || t AS kpi_name, CAST(n AS DOUBLE) AS value, 'NORMAL' AS status FROM (
  SELECT 'region' AS t, 1 AS o, count(*) AS n FROM region UNION ALL SELECT 'nation', 2, count(*) FROM nation
  UNION ALL SELECT 'customer', 3, count(*) FROM customer UNION ALL SELECT 'supplier', 4, count(*) FROM supplier
  UNION ALL SELECT 'part', 5, count(*) FROM part UNION ALL SELECT 'orders', 6, count(*) FROM orders
  UNION ALL SELECT 'lineitem', 7, count(*) FROM lineitem UNION ALL SELECT 'events', 8, count(*) FROM events
  UNION ALL SELECT 'documents', 9, count(*) FROM documents UNION ALL SELECT 'embeddings', 10, count(*) FROM embeddings
  UNION ALL SELECT 'pages', 11, count(*) FROM pages UNION ALL SELECT 'benchmark', 12, count(*) FROM benchmark
  UNION ALL SELECT 'labels', 13, count(*) FROM labels UNION ALL SELECT 'conversations', 14, count(*) FROM conversations)
ORDER BY n DESC, o LIMIT 10""")
def q_l2(spark, sf):
    """L2: overview fallback KPIs (10 largest driver tables) when nothing is extractable."""
    from autokpi.plans.fixtures import BASE_TABLES
    return sync.overview(spark, {t: table(spark, sf, t) for t in BASE_TABLES})["kpis"]
