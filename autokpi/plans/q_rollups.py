"""Queries: roll-ups, tenancy and drill-downs."""

from __future__ import annotations

from pyspark.sql import functions as F

from autokpi.functions.core import round_half_up
from autokpi.operators import rollups
from autokpi.plans.fixtures import fixture, table, with_fixtures
from autokpi.plans.registry import register

KR_DEPT = ("kd", "SELECT k.*, coalesce(d.name, 'Unassigned') AS department_name FROM fx_kpi_results k "
                 "LEFT JOIN fx_departments d ON d.id = k.department_id")


def _kr(spark, sf):
    return fixture(spark, sf, "fx_kpi_results")


def _depts(spark, sf):
    return fixture(spark, sf, "fx_departments")


@register("a9_department_breakdown", with_fixtures("""
SELECT recorded_at AS report_date, department_name, kpi_name, round(sum(value), 2) AS value
FROM kd GROUP BY 1, 2, 3""", KR_DEPT))
def q_a9(spark, sf):
    """A9 (long form): department -> KPI -> sum for every report date."""
    out = rollups.department_breakdown(_kr(spark, sf), _depts(spark, sf))
    return out.withColumn("value", round_half_up("value", 2))


@register("a9_combined_maps", with_fixtures("""
SELECT recorded_at AS report_date, department_name, kpi_name, round(sum(value), 2) AS value,
  round(sum(sum(value)) OVER (PARTITION BY recorded_at, kpi_name), 2) AS combined
FROM kd GROUP BY 1, 2, 3""", KR_DEPT))
def q_a9_maps(spark, sf):
    """The department map of every report date, unfolded, with each KPI's entry of the combined map."""
    rep = rollups.combined_report(_kr(spark, sf), _depts(spark, sf))
    per = rep.select("report_date", "combined_kpis", F.explode("department_breakdown").alias("department_name", "m"))
    per = per.select("report_date", "combined_kpis", "department_name", F.explode("m").alias("kpi_name", "value"))
    out = per.select("report_date", "department_name", "kpi_name", "value", F.col("combined_kpis")[F.col("kpi_name")].alias("combined"))
    return out.withColumn("value", round_half_up("value", 2)).withColumn("combined", round_half_up("combined", 2))


@register("l5_dashboard", with_fixtures("""
SELECT 'department_kpi_day' AS section, recorded_at AS period, NULL::INT AS department_id, department_name, kpi_name, round(sum(value), 2) AS value,
  count(*) AS row_count, count(*) FILTER (WHERE status <> 'NORMAL') AS anomaly_count, NULL::BIGINT AS department_count, NULL::INT AS rank, NULL::VARCHAR AS status
FROM kd GROUP BY recorded_at, department_name, kpi_name
UNION ALL SELECT 'kpi_day', recorded_at, NULL, NULL, kpi_name, round(sum(value), 2), count(*), count(*) FILTER (WHERE status <> 'NORMAL'), NULL, NULL, NULL
FROM kd GROUP BY recorded_at, kpi_name
UNION ALL SELECT 'department_day', recorded_at, NULL, department_name, NULL, round(sum(value), 2), count(*), count(*) FILTER (WHERE status <> 'NORMAL'), NULL, NULL, NULL
FROM kd GROUP BY recorded_at, department_name
UNION ALL SELECT 'day', recorded_at, NULL, NULL, NULL, round(sum(value), 2), count(*), count(*) FILTER (WHERE status <> 'NORMAL'), NULL, NULL, NULL
FROM kd GROUP BY recorded_at
UNION ALL SELECT 'kpi', NULL, NULL, NULL, kpi_name, round(sum(value), 2), count(*), count(*) FILTER (WHERE status <> 'NORMAL'), count(DISTINCT department_id), NULL, NULL
FROM kd GROUP BY kpi_name
UNION ALL SELECT 'department_kpi', NULL, department_id, NULL, kpi_name, round(sum(value), 2), count(*), count(*) FILTER (WHERE status <> 'NORMAL'), NULL, NULL, NULL
FROM kd GROUP BY department_id, kpi_name
UNION ALL SELECT 'department', NULL, department_id, NULL, NULL, round(sum(value), 2), count(*), count(*) FILTER (WHERE status <> 'NORMAL'), NULL, NULL, NULL
FROM kd GROUP BY department_id
UNION ALL SELECT 'latest', recorded_at, department_id, NULL, kpi_name, round(value, 2), source_record_count, NULL, NULL, NULL, status FROM (
  SELECT *, row_number() OVER (PARTITION BY department_id, kpi_name ORDER BY recorded_at DESC, user_id DESC) AS rn FROM fx_kpi_results) WHERE rn = 1
UNION ALL SELECT 'snapshot', recorded_at, NULL, NULL, trim(replace(kpi_name, '_', ' ')), round(value, 2), NULL, NULL, NULL, NULL, status FROM (
  SELECT * FROM fx_kpi_results ORDER BY coalesce(value, 0.0) DESC, recorded_at, kpi_name, department_id, user_id LIMIT 12)
UNION ALL SELECT 'department_top', t.recorded_at, d.id, d.name, t.kpi_name, round(t.value, 2), NULL, coalesce(a.n, 0), NULL, t.rank, t.status
FROM fx_departments d
LEFT JOIN (SELECT department_id, count(*) AS n FROM fx_kpi_results WHERE status <> 'NORMAL' GROUP BY 1) a ON a.department_id = d.id
LEFT JOIN (SELECT * FROM (SELECT department_id, kpi_name, recorded_at, value, status,
             CAST(row_number() OVER (PARTITION BY department_id ORDER BY recorded_at DESC, kpi_name, user_id) AS INT) AS rank
           FROM fx_kpi_results) WHERE rank <= 6) t ON t.department_id = d.id""", KR_DEPT))
def q_l5(spark, sf):
    """The dashboard in long form; all its roll-ups come from one scan."""
    from autokpi.plans import sync
    kr = _kr(spark, sf)
    out = sync.dashboard_rows(sync.dashboard(kr, kr.filter(F.col("status") != "NORMAL"), _depts(spark, sf)))
    return out.withColumn("value", round_half_up("value", 2))


@register("a9_combined_narrative", with_fixtures("""
SELECT report_date, 'Combined governed-mesh snapshot for ' || CAST(report_date AS STRING) || ': ' ||
  string_agg(kpi_name || ' ' || format('{:,.2f}', round(v, 2)), ', ' ORDER BY kpi_name) AS narrative,
  round(sum(v), 2) AS combined_total, count(*) AS n_kpis
FROM (SELECT recorded_at AS report_date, kpi_name, sum(value) AS v FROM kd GROUP BY 1, 2) GROUP BY report_date""",
    KR_DEPT))
def q_a9_narrative(spark, sf):
    """Combined report per date: narrative plus the combined map's total and size."""
    rep = rollups.combined_report(_kr(spark, sf), _depts(spark, sf))
    vals = F.map_values("combined_kpis")
    return rep.select("report_date", "narrative",
                      round_half_up(F.aggregate(vals, F.lit(0.0), lambda a, b: a + b), 2).alias("combined_total"),
                      F.size("combined_kpis").cast("bigint").alias("n_kpis"))


@register("a10_combined_kpis", with_fixtures("""
SELECT kpi_name, round(sum(value), 2) AS total_value, count(DISTINCT department_id) AS department_count
FROM fx_kpi_results GROUP BY kpi_name"""))
def q_a10(spark, sf):
    """A10: per-KPI total and number of departments reporting it (all rows)."""
    return rollups.combined_kpis(_kr(spark, sf))


@register("a11_timeline", with_fixtures("""
SELECT recorded_at AS period, round(sum(value), 2) AS total_value, count(DISTINCT department_name) AS n_departments
FROM kd GROUP BY 1""", KR_DEPT))
def q_a11(spark, sf):
    """Per date total value and the size of its department map."""
    t = rollups.timeline(_kr(spark, sf), _depts(spark, sf))
    return t.select("period", round_half_up("total_value", 2).alias("total_value"),
                    F.size("department_breakdown").cast("bigint").alias("n_departments"))


@register("a11_timeline_breakdown", with_fixtures("""
SELECT recorded_at AS period, department_name, round(sum(value), 2) AS value FROM kd GROUP BY 1, 2""", KR_DEPT))
def q_a11_long(spark, sf):
    """A11 (long form): per date and department value."""
    return rollups.timeline_long(_kr(spark, sf), _depts(spark, sf)).withColumn("value", round_half_up("value", 2))


@register("w4_department_summaries", with_fixtures("""
SELECT d.id AS department_id, d.name AS department_name, coalesce(a.n, 0) AS anomaly_count,
       t.rank, t.kpi_name, t.recorded_at, t.value, t.status
FROM fx_departments d
LEFT JOIN (SELECT department_id, count(*) AS n FROM fx_kpi_results WHERE status <> 'NORMAL' GROUP BY 1) a
  ON a.department_id = d.id
LEFT JOIN (SELECT * FROM (SELECT department_id, kpi_name, recorded_at, value, status,
             CAST(row_number() OVER (PARTITION BY department_id ORDER BY recorded_at DESC, kpi_name, user_id) AS INT) AS rank
           FROM fx_kpi_results) WHERE rank <= 6) t ON t.department_id = d.id"""))
def q_w4(spark, sf):
    """Newest 6 KPIs and anomaly count per department."""
    kr = _kr(spark, sf)
    out = rollups.department_summaries(_depts(spark, sf), kr, kr.filter(F.col("status") != "NORMAL"))
    return out.select("department_id", "department_name", "anomaly_count", "rank", "kpi_name", "recorded_at",
                      "value", "status")


@register("j2_kpis_with_role_department", with_fixtures("""
SELECT k.user_id, k.kpi_name, k.recorded_at, k.value, r.department_id, coalesce(d.name, 'Unassigned') AS department_name
FROM fx_kpi_results k JOIN fx_user_roles r ON r.user_id = k.user_id
LEFT JOIN fx_departments d ON d.id = r.department_id"""))
def q_j2(spark, sf):
    """KPI rows labelled with their owner's department ('Unassigned' when the role has none)."""
    kr = _kr(spark, sf).select("user_id", "kpi_name", "recorded_at", "value")
    roles = fixture(spark, sf, "fx_user_roles").select("user_id", "department_id")
    return rollups.with_department(kr.join(roles, "user_id"), _depts(spark, sf))


@register("j4_department_directory", with_fixtures("""
SELECT d.id AS department_id, d.name, d.template_id, d.heartbeat_schedule, coalesce(u.n, 0) AS user_count,
       l.last_report_date, t.config AS template_config
FROM fx_departments d
LEFT JOIN (SELECT department_id, count(DISTINCT user_id) AS n FROM fx_user_roles WHERE department_id IS NOT NULL
           GROUP BY 1) u ON u.department_id = d.id
LEFT JOIN (SELECT department_id, max(recorded_at) AS last_report_date FROM fx_kpi_results GROUP BY 1) l
  ON l.department_id = d.id
LEFT JOIN fx_templates t ON t.id = d.template_id"""))
def q_j4(spark, sf):
    """Department directory with user counts, last report date and template."""
    return rollups.department_directory(_depts(spark, sf), fixture(spark, sf, "fx_user_roles"), _kr(spark, sf),
                                        fixture(spark, sf, "fx_templates"))


@register("j4_user_directory", with_fixtures("""
SELECT n.n_nationkey AS user_id, n.n_name AS name, r.department_id, r.role, d.name AS department_name
FROM nation n LEFT JOIN fx_user_roles r ON r.user_id = n.n_nationkey LEFT JOIN fx_departments d ON d.id = r.department_id"""))
def q_j4_users(spark, sf):
    """Users (nations) with their role and department name."""
    users = table(spark, sf, "nation").select(F.col("n_nationkey").alias("user_id"), F.col("n_name").alias("name"))
    return rollups.user_directory(users, fixture(spark, sf, "fx_user_roles"), _depts(spark, sf))


@register("j5_visible_row_counts", with_fixtures("""
SELECT r.user_id, CAST(CASE WHEN max(CASE WHEN r.role = 'admin' THEN 1 ELSE 0 END) = 1 THEN (SELECT count(*) FROM fx_kpi_results)
  ELSE (SELECT count(*) FROM fx_kpi_results k WHERE k.user_id = r.user_id
        OR k.department_id IN (SELECT department_id FROM fx_user_roles r2 WHERE r2.user_id = r.user_id
                               AND r2.department_id IS NOT NULL)) END AS BIGINT) AS visible_rows
FROM fx_user_roles r GROUP BY r.user_id"""))
def q_j5(spark, sf):
    """Rows of the KPI results each user may see (admins: all)."""
    return rollups.visible_row_counts(_kr(spark, sf), fixture(spark, sf, "fx_user_roles"))


@register("j5_row_visibility", with_fixtures("""
SELECT k.department_id, k.user_id, k.kpi_name, k.recorded_at,
  (SELECT count(DISTINCT r.user_id) FROM fx_user_roles r WHERE r.role = 'admin' OR r.user_id = k.user_id OR r.department_id = k.department_id) AS visible_to,
  k.user_id = 3 OR k.department_id IN (SELECT department_id FROM fx_user_roles WHERE user_id = 3 AND department_id IS NOT NULL) AS seen_by_3
FROM fx_kpi_results k"""))
def q_j5_rows(spark, sf):
    """By how many viewers each KPI result is seen, and whether viewer 3 sees it."""
    out = rollups.row_visibility(_kr(spark, sf), fixture(spark, sf, "fx_user_roles"))
    return out.select("department_id", "user_id", "kpi_name", "recorded_at", "visible_to", rollups.sees(F.col("viewers"), 3).alias("seen_by_3"))


@register("j5_tenant_scope", with_fixtures("""
SELECT * FROM fx_kpi_results WHERE user_id = 3 OR department_id IN (SELECT department_id FROM fx_user_roles WHERE user_id = 3 AND department_id IS NOT NULL)"""))
def q_j5_scope(spark, sf):
    """J5 for one viewer (user 3, no admin): rows of their department and their own."""
    return rollups.tenant_scope(_kr(spark, sf), fixture(spark, sf, "fx_user_roles"), 3)


LINEAGE_SQL = """SELECT CAST(n.n_regionkey AS INT) AS department_id, CAST(n.n_nationkey AS INT) AS user_id,
  o.o_orderpriority AS kpi_name, CAST(o.o_orderdate AS DATE) AS recorded_at, o.o_orderkey AS source_record_id,
  o.o_totalprice AS record_value
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"""


@register("j7_kpi_lineage", with_fixtures("""
SELECT k.department_id, k.user_id, k.kpi_name, k.recorded_at, k.value, f.found, l.source_record_id, l.record_value
FROM fx_kpi_results k
LEFT JOIN (SELECT department_id, user_id, kpi_name, recorded_at, count(*) AS found FROM lin GROUP BY 1, 2, 3, 4) f
  USING (department_id, user_id, kpi_name, recorded_at)
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY department_id, user_id, kpi_name, recorded_at
                                                       ORDER BY source_record_id) AS rn FROM lin)) l
  USING (department_id, user_id, kpi_name, recorded_at)""", ("lin", LINEAGE_SQL)))
def q_j7(spark, sf):
    """Every KPI result with all the orders behind it."""
    keys = ["department_id", "user_id", "kpi_name", "recorded_at"]
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    lineage = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
               .select(F.col("n_regionkey").cast("int").alias("department_id"),
                       F.col("n_nationkey").cast("int").alias("user_id"),
                       F.col("o_orderpriority").alias("kpi_name"), F.to_date("o_orderdate").alias("recorded_at"),
                       F.col("o_orderkey").alias("source_record_id"), F.col("o_totalprice").alias("record_value")))
    kr = _kr(spark, sf).select(*keys, "value")
    out = rollups.kpi_lineage(kr, lineage, keys, ["source_record_id"])
    return out.select(*keys, "value", "found", "source_record_id", "record_value")


@register("j7_related_kpis", with_fixtures("""
SELECT department_id, recorded_at, kpi_name, user_id, related_kpi_name, related_user_id, related_value, related_rank
FROM (SELECT m.department_id, m.recorded_at, m.kpi_name, m.user_id, h.kpi_name AS related_kpi_name,
        h.user_id AS related_user_id, h.value AS related_value,
        CAST(row_number() OVER (PARTITION BY m.department_id, m.recorded_at, m.kpi_name, m.user_id ORDER BY h.rn) AS INT)
          AS related_rank
      FROM fx_kpi_results m JOIN (SELECT *, row_number() OVER (PARTITION BY department_id, recorded_at
                                                               ORDER BY kpi_name, user_id) AS rn FROM fx_kpi_results) h
        ON h.department_id = m.department_id AND h.recorded_at = m.recorded_at AND h.rn <= 21
       AND NOT (h.kpi_name = m.kpi_name AND h.user_id = m.user_id))
WHERE related_rank <= 20"""))
def q_j7_related(spark, sf):
    """Up to 20 other KPI rows of the same department and date, for every KPI row."""
    kr = _kr(spark, sf)
    out = rollups.related_kpis(kr, ["department_id", "recorded_at"], ["kpi_name", "user_id"], 20)
    return out.select("department_id", "recorded_at", "kpi_name", "user_id",
                      F.col("related_kpi_name"), F.col("related_user_id"), "related_value", "related_rank")


@register("j8_report_kpis", with_fixtures("""
SELECT r.report_date, k.department_id, k.user_id, k.kpi_name, k.value, false AS fallback
FROM reports r JOIN fx_kpi_results k ON k.recorded_at = r.report_date
UNION ALL
SELECT r.report_date, n.department_id, n.user_id, n.kpi_name, n.value, true
FROM reports r, newest n WHERE r.report_date NOT IN (SELECT recorded_at FROM fx_kpi_results)""",
    ("reports", "SELECT DISTINCT CAST(ts AS DATE) AS report_date FROM events UNION "
                "SELECT DISTINCT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '1-URGENT'"),
    ("newest", "SELECT * FROM fx_kpi_results ORDER BY recorded_at DESC, department_id, user_id, kpi_name LIMIT 20")))
def q_j8(spark, sf):
    """Reports (event days and urgent-order days) with the KPIs of their date,
    or the 20 newest KPIs when their date has none."""
    ev = table(spark, sf, "events").select(F.to_date("ts").alias("report_date"))
    od = table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT") \
        .select(F.to_date("o_orderdate").alias("report_date"))
    reports = ev.union(od).distinct()
    kr = _kr(spark, sf).select("department_id", "user_id", "kpi_name", "recorded_at", "value")
    out = rollups.report_kpis(reports, kr, 20)
    return out.select("report_date", "department_id", "user_id", "kpi_name", "value", "fallback")


@register("a21_template_list", with_fixtures("""
SELECT t.id AS template_id, coalesce(f.n, 0) AS field_count, coalesce(d.n, 0) AS department_count
FROM fx_templates t
LEFT JOIN (SELECT template_id, count(*) AS n FROM fx_fields GROUP BY 1) f ON f.template_id = t.id
LEFT JOIN (SELECT template_id, count(*) AS n FROM fx_departments GROUP BY 1) d ON d.template_id = t.id"""))
def q_a21(spark, sf):
    """Templates with field and department counts."""
    return rollups.template_list(fixture(spark, sf, "fx_templates"), fixture(spark, sf, "fx_fields"),
                                 _depts(spark, sf))
