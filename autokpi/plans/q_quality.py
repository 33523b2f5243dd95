"""Queries: validation, quality scores, mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from autokpi.functions.core import round_half_up
from autokpi.operators import mapping, quality
from autokpi.plans.fixtures import BASE_TABLES, fixture, table, with_fixtures
from autokpi.plans.registry import ORACLES, register
from autokpi.sources import catalog

EVENT_KPIS = ["click", "error", "purchase", "signup", "view"]

VF_SQL = """SELECT coalesce(CAST(report_date AS STRING), '') AS report_date,
  coalesce(customer_id, 'ACCOUNT-PRIMARY') AS customer_id,
  """ + ",\n  ".join(
    f"round(sum(CASE WHEN kpi_name = '{k}' THEN coalesce(value, 0.0) END), 2) AS {k}" for k in EVENT_KPIS) + """
FROM fx_frame GROUP BY 1, 2"""


def _vf(spark, sf):
    return quality.validation_frame(fixture(spark, sf, "fx_frame"), EVENT_KPIS)


@register("a7_validation_frame", with_fixtures("SELECT * FROM vf", ("vf", VF_SQL)))
def q_a7(spark, sf):
    """Wide validation frame per (report_date, customer_id), one column per KPI."""
    vf = _vf(spark, sf)
    return vf.select("report_date", "customer_id", *[round_half_up(k, 2).alias(k) for k in EVENT_KPIS])


@register("a7_validation_frame_extra_columns", with_fixtures("""
SELECT coalesce(CAST(TRY_CAST(date AS DATE) AS STRING), '') AS report_date, 'ACCOUNT-PRIMARY' AS customer_id,
  count(*) AS n_rows,
  """ + ",\n  ".join(
    f"round(sum(CASE WHEN kpi_name = '{k}' THEN coalesce(TRY_CAST(value AS DOUBLE), 0.0) END), 2) AS {k}" for k in EVENT_KPIS)
    + """,
  arg_min(category, event_id) FILTER (WHERE category IS NOT NULL) AS category
FROM fx_dirty WHERE kpi_name IS NOT NULL GROUP BY 1, 2"""))
def q_a7_extra(spark, sf):
    """A7 without customer ids, with an extra column taken as the first non-null by row id."""
    d = fixture(spark, sf, "fx_dirty").filter(F.col("kpi_name").isNotNull())
    d = d.withColumn("date", F.to_date(F.col("date").try_cast("date"))) \
        .withColumn("source_row_id", F.col("event_id")).withColumn("n_rows", F.lit(1))
    vf = quality.validation_frame(d.drop("event_id"), EVENT_KPIS)
    counts = d.groupBy(F.coalesce(F.col("date").cast("string"), F.lit("")).alias("report_date")) \
        .agg(F.count(F.lit(1)).alias("n_rows"))
    return vf.drop("n_rows").join(counts, "report_date").select(
        "report_date", "customer_id", "n_rows", *[round_half_up(k, 2).alias(k) for k in EVENT_KPIS], "category")


@register("a8_kpi_row_counts", with_fixtures("""
SELECT m.kpi_name, m.status, c.source_record_count FROM
  (SELECT kpi_name, 'x' AS status FROM fx_frame GROUP BY kpi_name) m
  LEFT JOIN (SELECT kpi_name, count(*) AS source_record_count FROM fx_frame GROUP BY kpi_name) c USING (kpi_name)"""))
def q_a8(spark, sf):
    """Number of source rows attached to each KPI result."""
    fr = fixture(spark, sf, "fx_frame")
    res = fr.select("kpi_name").distinct().withColumn("status", F.lit("x"))
    return quality.kpi_row_counts(fr, res)


@register("v1_schema_check_mapped", with_fixtures("""
SELECT 'schema' AS check_type, 'fail' AS status,
  'Missing required fields: ' || string_agg(global_field_name, ', ' ORDER BY id) AS message
FROM fx_fields WHERE required AND global_field_name NOT IN (SELECT column_name FROM (VALUES
  ('event_id'), ('ts'), ('user_id'), ('event_type'), ('value'), ('props'), ('event_value')) t(column_name))"""))
def q_v1(spark, sf):
    """V1: required fields vs the columns of the mapped events table, mapped
    without the ``kind`` rule, so the required field ``kind`` is missing -> fail."""
    ev = table(spark, sf, "events")
    rules = mapping.mapping_rules(fixture(spark, sf, "fx_mappings"), fixture(spark, sf, "fx_fields"))
    mapped = mapping.apply_mappings(ev, rules.filter(F.col("global_field_name") != "kind"))
    return quality.schema_check(mapped, fixture(spark, sf, "fx_fields"))


@register("v2_null_profile_dirty", with_fixtures("""
SELECT column_name, null_count, total_rows, round(null_count * 100.0 / total_rows, 1) AS null_pct,
       null_count * 1.0 / total_rows > 0.1 AS flagged
FROM (
  SELECT 'date' AS column_name, count(*) - count(date) AS null_count, count(*) AS total_rows FROM fx_dirty
  UNION ALL SELECT 'kpi_name', count(*) - count(kpi_name), count(*) FROM fx_dirty
  UNION ALL SELECT 'value', count(*) - count(value), count(*) FROM fx_dirty
  UNION ALL SELECT 'category', count(*) - count(category), count(*) FROM fx_dirty
  UNION ALL SELECT 'event_id', count(*) - count(event_id), count(*) FROM fx_dirty)"""))
def q_v2_profile(spark, sf):
    """V2 detail: per-column null counts and rates of the dirty frame."""
    return quality.null_profile(fixture(spark, sf, "fx_dirty"), 0.10).drop("__total")


@register("v2_null_check_dirty", with_fixtures("""
SELECT 'null' AS check_type, CASE WHEN count(*) FILTER (WHERE flagged) > 0 THEN 'warning' ELSE 'pass' END AS status,
  CASE WHEN count(*) FILTER (WHERE flagged) > 0 THEN
    CAST(count(*) FILTER (WHERE flagged) AS STRING) || ' column(s) exceed 10% null threshold. Worst: ' ||
    CAST(max(null_pct) FILTER (WHERE flagged) AS STRING) || '% nulls.'
  ELSE 'All columns below 10% null threshold.' END AS message
FROM (SELECT round(null_count * 100.0 / total_rows, 1) AS null_pct, null_count * 1.0 / total_rows > 0.1 AS flagged FROM (
  SELECT count(*) - count(date) AS null_count, count(*) AS total_rows FROM fx_dirty
  UNION ALL SELECT count(*) - count(kpi_name), count(*) FROM fx_dirty
  UNION ALL SELECT count(*) - count(value), count(*) FROM fx_dirty
  UNION ALL SELECT count(*) - count(category), count(*) FROM fx_dirty
  UNION ALL SELECT count(*) - count(event_id), count(*) FROM fx_dirty))"""))
def q_v2(spark, sf):
    """V2: null check result row for the dirty frame (category is 14 % null)."""
    return quality.null_check(fixture(spark, sf, "fx_dirty"), 0.10)


MAG_CTES = (("vf", VF_SQL),
            ("cur", "SELECT * FROM vf WHERE report_date = (SELECT max(report_date) FROM vf)"),
            ("hist", "SELECT * FROM vf WHERE report_date < (SELECT max(report_date) FROM vf)"),
            ("prof", " UNION ALL ".join(
                f"SELECT '{k}' AS column_name, (SELECT coalesce(sum(coalesce({k}, 0.0)), 0.0) FROM cur) AS c, "
                f"(SELECT coalesce(sum(coalesce({k}, 0.0)), 0.0) FROM hist) AS h" for k in EVENT_KPIS)))


@register("v3_magnitude_profile", with_fixtures("""
SELECT column_name, round(c, 2) AS current_total, round(h, 2) AS previous_total,
  round(abs(c - h) / abs(h) * 100, 1) AS change_pct, abs(c - h) / abs(h) > 0.5 AS flagged
FROM prof WHERE h <> 0""", *MAG_CTES))
def q_v3_profile(spark, sf):
    """V3 detail: newest day's KPI totals vs all earlier days."""
    cur, hist = quality.split_latest(_vf(spark, sf))
    return quality.magnitude_profile(cur, hist, 0.50).drop("n_cur", "n_hist")


@register("v5_validate", with_fixtures("""
SELECT 1 AS seq, 'schema' AS check_type, 'pass' AS status, 'All 2 required fields present.' AS message
UNION ALL
SELECT 2, 'null', CASE WHEN count(*) FILTER (WHERE flagged) > 0 THEN 'warning' ELSE 'pass' END,
  CASE WHEN count(*) FILTER (WHERE flagged) > 0 THEN
    CAST(count(*) FILTER (WHERE flagged) AS STRING) || ' column(s) exceed 10% null threshold. Worst: ' ||
    CAST(max(null_pct) FILTER (WHERE flagged) AS STRING) || '% nulls.'
  ELSE 'All columns below 10% null threshold.' END
FROM (SELECT round(n * 100.0 / t, 1) AS null_pct, n * 1.0 / t > 0.1 AS flagged FROM (
  """ + " UNION ALL ".join(f"SELECT count(*) - count({c}) AS n, count(*) AS t FROM cur"
                           for c in ["report_date", "customer_id", *EVENT_KPIS]) + """))
UNION ALL
SELECT 3, 'anomaly', CASE WHEN count(*) > 0 THEN 'warning' ELSE 'pass' END,
  CASE WHEN count(*) > 0 THEN 'Change vs history exceeds 50% for: ' || string_agg(column_name, ', ' ORDER BY column_name)
       ELSE 'No KPIs exceed 50% change vs history.' END
FROM prof WHERE h <> 0 AND abs(c - h) / abs(h) > 0.5""", *MAG_CTES))
def q_v5(spark, sf):
    """V5: schema, null and magnitude checks over the validation frame, as long rows.
    Required fields here are the two KPI columns ``click`` and ``view``."""
    vf = _vf(spark, sf)
    fields = spark.createDataFrame([(1, "click", True), (2, "view", True), (3, "nope", False)],
                                   "id int, global_field_name string, required boolean")
    return quality.validate(vf, fields, 0.10, 0.50)


@register("v5_validate_long", ORACLES["v5_validate"])
def q_v5_long(spark, sf):
    """V5 of the event frame with its KPI names as data (no column per KPI, no list of names)."""
    fields = spark.createDataFrame([(1, "click", True), (2, "view", True), (3, "nope", False)],
                                   "id int, global_field_name string, required boolean")
    return quality.validate_long(fixture(spark, sf, "fx_frame"), fields, 0.10, 0.50)


@register("a7_validation_maps", with_fixtures("""
SELECT coalesce(CAST(report_date AS STRING), '') AS report_date, coalesce(customer_id, 'ACCOUNT-PRIMARY') AS customer_id, kpi_name,
  round(sum(coalesce(value, 0.0)), 2) AS value
FROM fx_frame WHERE kpi_name IS NOT NULL GROUP BY 1, 2, 3"""))
def q_a7_maps(spark, sf):
    """A7 with a map of KPI sums per account-day, unfolded."""
    maps = quality.validation_maps(fixture(spark, sf, "fx_frame"))
    out = maps.select("report_date", "customer_id", F.explode("kpis").alias("kpi_name", "value"))
    return out.withColumn("value", round_half_up("value", 2))


TOP_LOGS_SQL = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY department_id
  ORDER BY created_at DESC, id DESC) AS rn FROM fx_validation_logs)"""
PER_TYPE_SQL = "SELECT department_id, check_type, arg_max(status, (created_at, id)) AS status FROM top GROUP BY 1, 2"


@register("a12_scorecard", with_fixtures("""
SELECT d.id AS department_id, d.name AS department_name,
  coalesce(CAST(round_even(s.score, 0) AS INT), -1) AS score, coalesce(s.checks, '') AS checks, l.last_validation
FROM fx_departments d
LEFT JOIN (SELECT department_id,
             avg(CASE status WHEN 'pass' THEN 100 WHEN 'warning' THEN 70 ELSE 0 END) AS score,
             string_agg(check_type || '=' || status, ',' ORDER BY check_type || '=' || status) AS checks
           FROM per_type GROUP BY 1) s ON s.department_id = d.id
LEFT JOIN (SELECT department_id, max(created_at) AS last_validation FROM top GROUP BY 1) l ON l.department_id = d.id""",
    ("top", TOP_LOGS_SQL), ("per_type", PER_TYPE_SQL)))
def q_a12(spark, sf):
    """Quality scorecard per department (department 4 has no logs -> -1)."""
    return quality.scorecard(fixture(spark, sf, "fx_departments"), fixture(spark, sf, "fx_validation_logs"))


@register("a13_pass_rate", with_fixtures("""
SELECT d.id AS department_id, d.name AS department_name, r.pass_rate, coalesce(r.n_logs, 0) AS n_logs
FROM fx_departments d LEFT JOIN (
  SELECT department_id, round(avg(CASE WHEN status = 'pass' THEN 100.0 ELSE 0.0 END), 1) AS pass_rate, count(*) AS n_logs
  FROM (SELECT *, row_number() OVER (PARTITION BY department_id ORDER BY created_at DESC, id DESC) AS rn
        FROM fx_validation_logs) WHERE rn <= 10 GROUP BY 1) r ON r.department_id = d.id"""))
def q_a13(spark, sf):
    """Pass rate of each department's newest 10 validation logs."""
    return quality.pass_rate(fixture(spark, sf, "fx_departments"), fixture(spark, sf, "fx_validation_logs"))


@register("a14_rag_status", with_fixtures("""
SELECT department_id, CASE WHEN max(r) = 2 THEN 'RED' WHEN max(r) = 1 THEN 'AMBER' ELSE 'GREEN' END AS overall_status
FROM (SELECT department_id, CASE status WHEN 'CRITICAL' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END AS r FROM fx_kpi_results)
GROUP BY department_id"""))
def q_a14(spark, sf):
    """RED / AMBER / GREEN per department from KPI statuses."""
    return quality.rag_status(fixture(spark, sf, "fx_kpi_results"), ["department_id"])


F9_S = """
  SELECT
    round(greatest(0.0, 1.0 - ((count(*) - count(date)) + (count(*) - count(kpi_name)) + (count(*) - count(value))
      + (count(*) - count(category)) + (count(*) - count(event_id))) * 1.0 / greatest(count(*) * 5, 1) * 10) * 100, 1)
      AS completeness,
    (SELECT CASE WHEN d <= 1 THEN 100.0 WHEN d <= 3 THEN 80.0 WHEN d <= 7 THEN 60.0 WHEN d <= 30 THEN 30.0 ELSE 0.0 END
     FROM (SELECT date_diff('day', max(CAST(created_at AS DATE)), DATE '2024-02-03') AS d FROM fx_validation_logs)) AS freshness,
    (SELECT round(count(*) FILTER (WHERE status = 'pass') * 100.0 / count(*), 1) FROM fx_validation_logs) AS validity,
    100.0 AS traceability
  FROM fx_dirty"""


@register("f9_governance_dirty", with_fixtures("""
SELECT completeness, CAST(freshness AS DOUBLE) AS freshness, validity, CAST(traceability AS DOUBLE) AS traceability,
  round((completeness + freshness + validity + traceability) / 4, 1) AS overall,
  CASE WHEN round((completeness + freshness + validity + traceability) / 4, 1) >= 90 THEN 'A'
       WHEN round((completeness + freshness + validity + traceability) / 4, 1) >= 75 THEN 'B'
       WHEN round((completeness + freshness + validity + traceability) / 4, 1) >= 60 THEN 'C'
       WHEN round((completeness + freshness + validity + traceability) / 4, 1) >= 40 THEN 'D' ELSE 'F' END AS grade,
  coalesce(nullif(concat_ws(' | ',
    CASE WHEN completeness < 70 THEN '""" + quality.ADVICE_COMPLETENESS + """' END,
    CASE WHEN freshness < 60 THEN '""" + quality.ADVICE_FRESHNESS + """' END,
    CASE WHEN validity < 70 THEN '""" + quality.ADVICE_VALIDITY + """' END,
    CASE WHEN traceability < 60 THEN '""" + quality.ADVICE_TRACEABILITY + """' END), ''),
    '""" + quality.ADVICE_GOOD + """') AS recommendations
FROM s""", ("s", F9_S)))
def q_f9(spark, sf):
    """governance score of the dirty frame: validity from the validation logs,
    freshness = days from the newest log to 2024-02-03, traceability = mappings exist."""
    logs = fixture(spark, sf, "fx_validation_logs")
    days = F.datediff(F.lit("2024-02-03").cast("date"), logs.agg(F.max(F.to_date("created_at"))).scalar())
    mapped = fixture(spark, sf, "fx_mappings").agg(F.count(F.lit(1)) > 0).scalar()
    return quality.governance(fixture(spark, sf, "fx_dirty"), logs, days, mapped)


@register("j1_mapping_rules", with_fixtures("""
SELECT m.template_field_id, m.local_column_name, f.global_field_name, f.data_type,
  json_extract_string(m.transformation_rule, '$.type') AS rule_type,
  coalesce(TRY_CAST(json_extract_string(m.transformation_rule, '$.factor') AS DOUBLE), 1.0) AS factor,
  coalesce(TRY_CAST(json_extract_string(m.transformation_rule, '$.offset') AS DOUBLE), 0.0) AS offset
FROM mappings_all m JOIN fields_all f ON f.id = m.template_field_id"""))
def q_j1(spark, sf):
    """Mappings joined to their semantic field (the mapping to field 9 has
    none); fields and mappings include those derived from the event types."""
    return mapping.mapping_rules(fixture(spark, sf, "mappings_all"), fixture(spark, sf, "fields_all"))


@register("p2_apply_mappings_events", with_fixtures("""
SELECT event_id, event_type, value, value * 100.0 AS event_value, upper(event_type) AS kind FROM events"""))
def q_p2(spark, sf):
    """Mapped events: event_value = value × 100, kind = upper(event_type);
    the unknown field and the missing column are skipped."""
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    rules = mapping.mapping_rules(fixture(spark, sf, "fx_mappings"), fixture(spark, sf, "fx_fields"))
    return mapping.apply_mappings(ev, rules)


@register("j6_unmapped_fields", with_fixtures("""
SELECT * FROM fields_all WHERE id NOT IN (SELECT template_field_id FROM mappings_all)"""))
def q_j6_fields(spark, sf):
    """Semantic fields with no mapping (fixture + event-type fields)."""
    return mapping.unmapped_fields(fixture(spark, sf, "fields_all"), fixture(spark, sf, "mappings_all"))


@register("j6_users_without_department", with_fixtures("""
SELECT c_custkey AS user_id, c_name FROM customer
WHERE CAST(c_custkey AS INT) NOT IN (SELECT user_id FROM fx_user_roles WHERE department_id IS NOT NULL)"""))
def q_j6_users(spark, sf):
    """Customers (as users) with no department role (anti-join)."""
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    roles = fixture(spark, sf, "fx_user_roles").filter(F.col("department_id").isNotNull()) \
        .select(F.col("user_id").cast("bigint").alias("user_id"))
    return mapping.without_role(users, roles)


@register("v14_mapping_status", with_fixtures("""
SELECT f.template_id, count(*) AS total_fields, count(m.id) AS mapped_fields,
  CAST(sum(CASE WHEN f.required THEN 1 ELSE 0 END) AS BIGINT) AS required_fields,
  coalesce(string_agg(CASE WHEN f.required AND m.id IS NULL THEN f.global_field_name END, ',' ORDER BY f.global_field_name), '') AS missing_required,
  coalesce(string_agg(CASE WHEN NOT f.required AND m.id IS NULL THEN f.global_field_name END, ',' ORDER BY f.global_field_name), '') AS missing_optional,
  coalesce(string_agg(CASE WHEN f.required AND m.id IS NULL THEN f.global_field_name END, ','), '') = '' AS valid
FROM fields_all f LEFT JOIN (SELECT DISTINCT template_field_id AS id FROM mappings_all) m ON m.id = f.id
GROUP BY f.template_id"""))
def q_v14(spark, sf):
    """Mapping completeness per template (fixture template 1, event-type template 2)."""
    return mapping.mapping_status(fixture(spark, sf, "fields_all"), fixture(spark, sf, "mappings_all"))


@register("v13_kpi_mode", with_fixtures("""
SELECT f.template_id, CASE WHEN count(*) = 0 THEN 'auto' WHEN count(m.id) > 0 THEN 'configured'
  ELSE 'configured-unmapped' END AS mode, count(*) AS total_fields, count(m.id) AS mapped_fields
FROM fields_all f LEFT JOIN (SELECT DISTINCT template_field_id AS id FROM mappings_all) m ON m.id = f.id
GROUP BY f.template_id"""))
def q_v13(spark, sf):
    """KPI mode per template (fixture template 1, event-type template 2)."""
    return mapping.kpi_mode(fixture(spark, sf, "fields_all"), fixture(spark, sf, "mappings_all"))


@register("v13_kpi_mode_templates", with_fixtures("""
SELECT CAST(t.r_regionkey AS INT) AS template_id, CASE WHEN count(f.id) = 0 THEN 'auto' WHEN count(m.id) > 0 THEN 'configured'
  ELSE 'configured-unmapped' END AS mode, count(f.id) AS total_fields, count(m.id) AS mapped_fields
FROM region t LEFT JOIN fields_all f ON f.template_id = t.r_regionkey LEFT JOIN (SELECT DISTINCT template_field_id AS id FROM mappings_all) m ON m.id = f.id
GROUP BY 1"""))
def q_v13_templates(spark, sf):
    """V13 for given templates (one per region): those without fields are ``auto``."""
    templates = table(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("id"))
    return mapping.kpi_mode(fixture(spark, sf, "fields_all"), fixture(spark, sf, "mappings_all"), templates)


@register("p13_runtime_config", with_fixtures("""
SELECT d.id AS department_id, d.name AS company_name,
  coalesce(TRY_CAST(json_extract_string(t.config, '$.validation_rules.null_threshold') AS DOUBLE), 0.10) AS null_threshold,
  coalesce(TRY_CAST(json_extract_string(t.config, '$.validation_rules.anomaly_threshold') AS DOUBLE), 0.50) AS anomaly_threshold,
  coalesce(TRY_CAST(json_extract_string(t.config, '$.validation_rules.critical_anomaly_zscore') AS DOUBLE), 3.0) AS critical_anomaly_zscore
FROM fx_departments d LEFT JOIN fx_templates t ON t.id = d.template_id"""))
def q_p13(spark, sf):
    """Effective thresholds per department (template 1 sets null 0.2)."""
    return mapping.runtime_config(fixture(spark, sf, "fx_departments"), fixture(spark, sf, "fx_templates"))


def _catalog(spark, sf):
    tables = {t: table(spark, sf, t) for t in BASE_TABLES}
    return catalog.catalog_columns(spark, tables)


TABLE_ORDER = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {i + 1})" for i, t in enumerate(BASE_TABLES)) + \
    ") AS t(table_name, table_ordinal)"


@register("j9_match_fields", with_fixtures("""
SELECT semantic_field, semantic_field_id, table_name, column_name, CAST(score AS BIGINT) AS score, CAST(rank AS INT) AS rank,
       CAST(round(least(1.0, 0.4 + score * 0.2), 2) AS DOUBLE) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY semantic_field_id ORDER BY score DESC, table_ordinal, ordinal) AS rank FROM (
    SELECT f.global_field_name AS semantic_field, f.id AS semantic_field_id, c.table_name, c.column_name,
      c.table_ordinal, c.ordinal,
      list_sum(list_transform(regexp_extract_all(lower(f.global_field_name), '[a-z0-9]+'),
               lambda t: CASE WHEN contains(lower(c.column_name), t) THEN 1 ELSE 0 END)) AS score
    FROM fields_all f, cat c) WHERE score > 0) WHERE rank <= 3""",
    ("tord", TABLE_ORDER),
    ("cat", "SELECT c.table_name, o.table_ordinal, c.ordinal_position AS ordinal, c.column_name "
            "FROM information_schema.columns c JOIN tord o ON o.table_name = c.table_name")))
def q_j9(spark, sf):
    """Top-3 column suggestions per semantic field (fixture fields and one
    field per event type) across all 14 driver tables."""
    return mapping.match_fields(fixture(spark, sf, "fields_all"), _catalog(spark, sf))


@register("a13_department_heartbeat", with_fixtures("""
SELECT d.id AS department_id, d.name AS department_name, d.heartbeat_schedule, k.last_sync,
  CASE WHEN k.last_sync IS NOT NULL THEN 'active' ELSE 'pending' END AS status, coalesce(u.n, 0) AS user_count,
  v.validation_score
FROM fx_departments d
LEFT JOIN (SELECT department_id, max(recorded_at) AS last_sync FROM fx_kpi_results GROUP BY 1) k ON k.department_id = d.id
LEFT JOIN (SELECT department_id, count(*) AS n FROM fx_user_roles GROUP BY 1) u ON u.department_id = d.id
LEFT JOIN (SELECT department_id, round(avg(CASE WHEN status = 'pass' THEN 100.0 ELSE 0.0 END), 1) AS validation_score
           FROM (SELECT *, row_number() OVER (PARTITION BY department_id ORDER BY created_at DESC, id DESC) AS rn
                 FROM fx_validation_logs) WHERE rn <= 10 GROUP BY 1) v ON v.department_id = d.id"""))
def q_a13_heartbeat(spark, sf):
    """Department heartbeat: last sync, active/pending, users, validation score."""
    return quality.department_heartbeat(fixture(spark, sf, "fx_departments"), fixture(spark, sf, "fx_validation_logs"),
                                        fixture(spark, sf, "fx_kpi_results"), fixture(spark, sf, "fx_user_roles"))
