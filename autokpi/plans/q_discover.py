"""Queries: catalog, profiling, preparation, modelling and discovery
(S4-S9, T2, A19, A20, V6-V12, A18, L3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from autokpi.functions.core import round_half_up
from autokpi.operators import discover, prepare
from autokpi.plans.fixtures import BASE_TABLES, DEMO_SQL, FAULTY_SQL, fixture, table, with_fixtures
from autokpi.plans.registry import register
from autokpi.sources import catalog as cat

# Column lists of the driver tables: (column, type) of all columns with comparable values;
# values only match within one type.
SCHEMAS = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"),
             ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
                 ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
                 ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp")],
    "events": [("event_id", "bigint"), ("ts", "timestamp"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")],
    "embeddings": [("vec_id", "bigint"), ("label", "int")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")],
}
DEMO_COLUMNS = {
    "contributions": ["id", "employer_id", "amount", "paid_at", "status"],
    "payments": ["id", "line_no", "amount", "payment_date"],
    "claims": ["id", "beneficiary_id", "claim_type", "created_at"],
    "beneficiaries": ["id", "full_name", "segment", "region_code"],
    "pensions": ["id", "beneficiary_id", "monthly_amount", "paid_on"],
}
ALL_TABLES = list(BASE_TABLES) + list(DEMO_SQL)


def _tables(spark, sf, names=None):
    out = {}
    for n in names or ALL_TABLES:
        out[n] = fixture(spark, sf, n) if n in DEMO_SQL else table(spark, sf, n)
    return out


def _catalog(spark, sf):
    return cat.catalog_columns(spark, _tables(spark, sf))


TORD = ("tord", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {i + 1})" for i, t in enumerate(ALL_TABLES))
        + ") AS t(table_name, table_ordinal)")
CAT_SQL = ("cat", "SELECT c.table_name, o.table_ordinal, CAST(c.ordinal_position AS INT) AS ordinal, c.column_name "
                  "FROM information_schema.columns c JOIN tord o ON o.table_name = c.table_name "
                  "WHERE c.table_name IN (" + ", ".join(f"'{t}'" for t in BASE_TABLES) + ") UNION ALL "
                  "SELECT table_name, table_ordinal, ordinal, column_name FROM (VALUES " + ", ".join(
                      f"('{t}', {ALL_TABLES.index(t) + 1}, {j + 1}, '{c}')"
                      for t, cols in DEMO_COLUMNS.items() for j, c in enumerate(cols))
        + ") AS d(table_name, table_ordinal, ordinal, column_name)")


@register("s4_catalog_columns", with_fixtures("""
SELECT c.table_name, o.table_ordinal, CAST(c.ordinal_position AS INT) AS ordinal, c.column_name, false AS is_view
FROM information_schema.columns c JOIN tord o ON o.table_name = c.table_name
WHERE c.table_name IN (""" + ", ".join(f"'{t}'" for t in BASE_TABLES) + ")", TORD))
def q_s4(spark, sf):
    """The column catalog of the 14 driver tables."""
    return cat.catalog_columns(spark, _tables(spark, sf, BASE_TABLES)) \
        .select("table_name", "table_ordinal", "ordinal", "column_name", "is_view")


PROFILE_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, {i + 1} AS table_ordinal, count(*) AS row_count FROM {t}"
                                 for i, t in enumerate(ALL_TABLES))


@register("s5_table_profile", with_fixtures("SELECT * FROM prof", ("prof", PROFILE_SQL)))
def q_s5(spark, sf):
    """Exact row count of every table (14 driver tables + 5 derived demo tables), one job."""
    return cat.table_profile(_tables(spark, sf))


@register("s8_preview_orders", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def q_s8(spark, sf):
    """10-row preview of orders by key."""
    return cat.preview(table(spark, sf, "orders"), 10, ["o_orderkey"])


@register("t2_largest_tables", with_fixtures("""
SELECT p.table_name, p.row_count FROM prof p
WHERE row_count > 0 ORDER BY row_count DESC, p.table_ordinal LIMIT 5""", ("prof", PROFILE_SQL), TORD))
def q_t2(spark, sf):
    """The 5 largest non-empty tables."""
    return cat.largest(cat.table_profile(_tables(spark, sf)), 5)


@register("a19_overview_kpis", with_fixtures("""
SELECT 'Table rows: ' || table_name AS kpi_name, CAST(row_count AS DOUBLE) AS value
FROM prof ORDER BY row_count DESC, table_ordinal LIMIT 10""", ("prof", PROFILE_SQL)))
def q_a19(spark, sf):
    """The 10 largest tables as KPI rows (overview fallback)."""
    return cat.overview_kpis(cat.table_profile(_tables(spark, sf)), 10)


def _keys_sql(tabs: list[str]) -> str:
    parts = []
    for t in tabs:
        for c, _ in SCHEMAS[t]:
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name FROM {t} "
                         f"HAVING count(*) > 0 AND count({c}) = count(*) AND count(DISTINCT {c}) = count(*)")
    return " UNION ALL ".join(parts)


@register("s6_candidate_keys", _keys_sql(list(SCHEMAS)))
def q_s6(spark, sf):
    """The non-null unique columns of all 14 tables."""
    return cat.candidate_keys_many(_tables(spark, sf, BASE_TABLES))


VALUES_SQL = " UNION ALL ".join(
    f"SELECT DISTINCT '{t}' AS tab, '{c}' AS col, '{ty}' AS ty, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL"
    for t, cols in SCHEMAS.items() for c, ty in cols)


@register("s7_foreign_keys", with_fixtures("""
SELECT m.table_name, m.column_name, m.ref_table, m.ref_column FROM (
  SELECT a.tab AS table_name, a.col AS column_name, b.tab AS ref_table, b.col AS ref_column, count(*) AS hits
  FROM vals a JOIN vals b ON a.ty = b.ty AND a.v = b.v AND a.tab <> b.tab
  JOIN keys k ON k.table_name = b.tab AND k.column_name = b.col GROUP BY 1, 2, 3, 4) m
JOIN (SELECT tab, col, count(*) AS n FROM vals GROUP BY 1, 2) c ON c.tab = m.table_name AND c.col = m.column_name
WHERE m.hits = c.n""", ("keys", _keys_sql(list(SCHEMAS))), ("vals", VALUES_SQL)))
def q_s7(spark, sf):
    """Inclusion dependencies into candidate keys among all 14 tables."""
    return cat.foreign_keys(_tables(spark, sf, BASE_TABLES))


@register("s9_list_tables", with_fixtures("""
SELECT table_name, count(*) AS column_count FROM cat GROUP BY table_name""", TORD, CAT_SQL))
def q_s9(spark, sf):
    """Table list with column counts (driver + demo tables)."""
    return cat.list_tables(_catalog(spark, sf))


@register("s9_describe_orders", with_fixtures("""
SELECT ordinal, column_name FROM cat WHERE table_name = 'orders'""", TORD, CAT_SQL))
def q_s9_describe(spark, sf):
    """The columns of one table."""
    return cat.describe(_catalog(spark, sf), "orders").select("ordinal", "column_name")


KW_SQL = ("kw", "SELECT * FROM (VALUES " + ", ".join(
    f"({i + 1}, '{lbl}', '{k}')" for i, (lbl, kws) in enumerate(discover.DOMAIN_KEYWORDS) for k in kws)
    + ") AS k(label_ord, label, kw)")
TL_SQL = ("tl", """SELECT t.table_name, t.table_ordinal, t.hay, l.label, l.label_ord FROM
  (SELECT table_name, table_ordinal, lower(table_name || ' ' || string_agg(column_name, ' ' ORDER BY ordinal)) AS hay
   FROM cat GROUP BY 1, 2) t
  LEFT JOIN (SELECT DISTINCT t2.table_name, kw.label, kw.label_ord FROM
     (SELECT table_name, lower(table_name || ' ' || string_agg(column_name, ' ' ORDER BY ordinal)) AS hay
      FROM cat GROUP BY 1) t2 JOIN kw ON contains(t2.hay, kw.kw)) l ON l.table_name = t.table_name""")


@register("v8_classify_tables", with_fixtures("""
SELECT table_name, table_ordinal, coalesce(string_agg(label, ',' ORDER BY label_ord), '') AS labels
FROM tl GROUP BY 1, 2""", TORD, CAT_SQL, KW_SQL, TL_SQL))
def q_v8(spark, sf):
    """V8: business-domain labels of the driver and demo tables."""
    return discover.classify(_catalog(spark, sf))


@register("v9_column_roles", with_fixtures(f"""
SELECT table_name, ordinal, column_name, regexp_matches(column_name, '{discover.AMOUNT_PATTERN}') AS is_amount,
  regexp_matches(column_name, '{discover.DATE_PATTERN}') AS is_date,
  regexp_matches(column_name, '{discover.ID_PATTERN}') AS is_id FROM cat""", TORD, CAT_SQL))
def q_v9(spark, sf):
    """V9: amount / date / id roles of every column by name."""
    return discover.column_roles(_catalog(spark, sf))


@register("a20_tables_by_domain", with_fixtures("""
SELECT label, string_agg(table_name, ',' ORDER BY table_ordinal) AS tables, CAST(count(*) AS INT) AS table_count
FROM (SELECT table_name, table_ordinal, coalesce(label, 'other') AS label FROM tl) GROUP BY label""",
    TORD, CAT_SQL, KW_SQL, TL_SQL))
def q_a20(spark, sf):
    """Tables grouped by domain label."""
    return discover.tables_by_domain(_catalog(spark, sf))


V10_CTES = (
    TORD, CAT_SQL, KW_SQL, TL_SQL, ("prof", PROFILE_SQL),
    ("firsts", f"""SELECT table_name,
       min(CASE WHEN regexp_matches(column_name, '{discover.AMOUNT_PATTERN}') THEN ordinal END) AS amt_ord,
       min(CASE WHEN regexp_matches(column_name, '{discover.DATE_PATTERN}') THEN ordinal END) AS dt_ord FROM cat GROUP BY 1"""),
    ("tsum", """SELECT f.table_name, a.column_name AS amt, d.column_name AS dt FROM firsts f
       LEFT JOIN cat a ON a.table_name = f.table_name AND a.ordinal = f.amt_ord
       LEFT JOIN cat d ON d.table_name = f.table_name AND d.ordinal = f.dt_ord"""),
    ("lab", """SELECT tl.table_name, tl.table_ordinal, tl.label, s.amt, s.dt,
       row_number() OVER (PARTITION BY tl.label ORDER BY tl.table_ordinal) AS label_rank
       FROM tl JOIN tsum s USING (table_name) WHERE tl.label IS NOT NULL"""),
    ("rules", "SELECT * FROM (VALUES " + ", ".join(
        f"({o}, {discover._SUB.get(k, 1)}, '{lbl}', {'NULL' if fb is None else repr(fb)}, {mx}, '{k}', {str(na).lower()}, "
        f"{str(nd).lower()}, '{title}')" for o, lbl, fb, mx, k, na, nd, title in discover._RULES)
     + ") AS r(rule_order, sub, label, fallback, max_tables, kind, needs_amount, needs_date, title_prefix)"),
    ("rules2", """SELECT r.*, CASE WHEN r.label IN (SELECT label FROM lab) THEN r.label
       WHEN r.fallback IN (SELECT label FROM lab) THEN r.fallback END AS use_label FROM rules r"""),
    ("picked", """SELECT r.rule_order, l.label_rank, r.sub, r.kind, l.table_name,
       CASE WHEN r.kind IN ('time_series_sum', 'anomaly_zscore', 'liability_forecast') THEN l.amt END AS amount_column,
       CASE WHEN r.kind <> 'demographic' THEN l.dt END AS date_column,
       r.title_prefix || ' (' || l.table_name || ')' AS title
       FROM rules2 r JOIN lab l ON l.label = r.use_label
       WHERE l.label_rank <= r.max_tables AND (NOT r.needs_amount OR l.amt IS NOT NULL)
         AND (NOT r.needs_date OR l.dt IS NOT NULL)"""),
    ("ov", """SELECT 6 AS rule_order, row_number() OVER (ORDER BY p.row_count DESC, o.table_ordinal) AS label_rank, 1 AS sub,
       'overview' AS kind, p.table_name, NULL AS amount_column, NULL AS date_column,
       'Table overview: ' || p.table_name AS title
       FROM (SELECT table_name, row_count FROM prof WHERE row_count > 0 ORDER BY row_count DESC, table_ordinal LIMIT 5) p
       JOIN tord o USING (table_name)"""),
)


@register("v10_suggest_analyses", with_fixtures("""
SELECT CAST(row_number() OVER (ORDER BY rule_order, label_rank, sub) AS INT) AS seq, kind, table_name,
       amount_column, date_column, title
FROM (SELECT * FROM picked UNION ALL SELECT * FROM ov)""", *V10_CTES))
def q_v10(spark, sf):
    """Analyses suggested for the driver + demo tables."""
    tabs = _tables(spark, sf)
    out = discover.suggest_analyses(cat.catalog_columns(spark, tabs), cat.table_profile(tabs))
    return out.select(F.col("seq").cast("int").alias("seq"), "kind", "table_name", "amount_column", "date_column",
                      "title")


L3_SQL = """
SELECT CAST(seq AS INT) AS seq, kpi_name, value, status, DATE '2001-08-02' AS recorded_at FROM (
  SELECT 1 AS seq, 'Contribution trend over time (contributions)' AS kpi_name,
    (SELECT round(sum(amount), 2) FROM contributions GROUP BY date_trunc('month', paid_at)
     ORDER BY date_trunc('month', paid_at) DESC LIMIT 1) AS value, 'NORMAL' AS status
  UNION ALL
  SELECT 2, 'Late / missing contribution detection (contributions)', CAST(d AS DOUBLE),
    CASE WHEN d > 30 THEN 'CRITICAL' WHEN d > 7 THEN 'WARNING' ELSE 'NORMAL' END
  FROM (SELECT date_diff('day', CAST(max(paid_at) AS DATE), DATE '2001-08-02') AS d FROM contributions)
  UNION ALL
  SELECT 3, 'Payment anomaly detection (payments)', CAST(n AS DOUBLE),
    CASE WHEN n >= 5 THEN 'WARNING' WHEN n > 0 THEN 'WATCH' ELSE 'NORMAL' END
  FROM (SELECT count(*) AS n FROM payments, (SELECT avg(amount) AS m, stddev_samp(amount) AS sd FROM payments) s
        WHERE abs((amount - s.m) / CASE WHEN coalesce(s.sd, 0) = 0 THEN 1.0 ELSE s.sd END) > 2.5)
  UNION ALL
  SELECT 4, 'Claim processing throughput (claims)',
    (SELECT CAST(count(*) AS DOUBLE) FROM claims GROUP BY date_trunc('week', created_at)
     ORDER BY date_trunc('week', created_at) DESC LIMIT 1), 'NORMAL'
  UNION ALL
  SELECT 5, 'Demographic distribution (claims)',
    (SELECT CAST(count(*) AS DOUBLE) FROM claims),
    'NORMAL'
  UNION ALL
  SELECT 6, 'Pension/benefit liability forecast (pensions)',
    round((SELECT sum(round(av * power(1 + g, i / 12.0), 2)) FROM lf, range(1, 13) r(i)), 2), 'NORMAL'
  UNION ALL
  SELECT 6 + row_number() OVER (ORDER BY row_count DESC, table_ordinal), 'Table overview: ' || table_name,
    CAST(row_count AS DOUBLE), 'NORMAL'
  FROM (SELECT * FROM prof WHERE row_count > 0 ORDER BY row_count DESC, table_ordinal LIMIT 5))"""

LF_SQL = """SELECT avg(CASE WHEN rn <= 12 THEN total END) AS av,
  CASE WHEN count(*) >= 24 AND sum(CASE WHEN rn > 12 AND rn <= 24 THEN total END) > 0
       THEN sum(CASE WHEN rn <= 12 THEN total END) / sum(CASE WHEN rn > 12 AND rn <= 24 THEN total END) - 1
       ELSE 0.0 END AS g
FROM (SELECT total, row_number() OVER (ORDER BY bucket DESC) AS rn FROM (
  SELECT date_trunc('month', paid_on) AS bucket, coalesce(sum(monthly_amount), 0.0) AS total FROM pensions
  WHERE paid_on IS NOT NULL GROUP BY 1))"""


@register("l3_analyse_all", with_fixtures(L3_SQL, ("prof", PROFILE_SQL), ("lf", LF_SQL)))
def q_l3(spark, sf):
    """L3: run and summarise every suggested analysis over the driver + demo
    tables (as of 2001-08-02).  The oracle recomputes each of the 11
    analyses V10 selects for this schema."""
    return discover.analyse_all(spark, _tables(spark, sf), as_of="2001-08-02", recorded_at="2001-08-02")


_FAULTY_ROWS = """SELECT count(*) FROM fx_dirty WHERE (value IS NOT NULL AND TRY_CAST(value AS DOUBLE) IS NULL)
      OR (date IS NOT NULL AND TRY_CAST(date AS TIMESTAMP) IS NULL)"""


@register("l3_sync_status_dirty", with_fixtures(f"""
SELECT CAST(seq AS INT) AS seq, kpi_name, kind, table_name, outcome, value, status, rows_read, rows_rejected, DATE '2001-08-02' AS recorded_at FROM (
  SELECT 1 AS seq, 'Contribution trend over time (contributions_ok)' AS kpi_name, 'time_series_sum' AS kind, 'contributions_ok' AS table_name,
    'synced' AS outcome, (SELECT round(sum(amount), 2) FROM contributions_ok GROUP BY date_trunc('month', paid_at)
     ORDER BY date_trunc('month', paid_at) DESC LIMIT 1) AS value, 'NORMAL' AS status,
    (SELECT count(*) FROM orders) AS rows_read, 0 AS rows_rejected
  UNION ALL
  SELECT 2, 'Late / missing contribution detection (contributions_ok)', 'missing_recent', 'contributions_ok', 'synced', CAST(d AS DOUBLE),
    CASE WHEN d > 30 THEN 'CRITICAL' WHEN d > 7 THEN 'WARNING' ELSE 'NORMAL' END, n, 0
  FROM (SELECT date_diff('day', CAST(max(paid_at) AS DATE), DATE '2001-08-02') AS d, count(*) AS n FROM contributions_ok)
  UNION ALL
  SELECT 3, 'Payment anomaly detection (payments_dirty)', 'anomaly_zscore', 'payments_dirty', 'synced', CAST(n AS DOUBLE),
    CASE WHEN n >= 5 THEN 'WARNING' WHEN n > 0 THEN 'WATCH' ELSE 'NORMAL' END, (SELECT count(*) FROM fx_dirty), ({_FAULTY_ROWS})
  FROM (SELECT count(*) AS n FROM (SELECT TRY_CAST(amount AS DOUBLE) AS x FROM payments_dirty) p,
          (SELECT avg(TRY_CAST(amount AS DOUBLE)) AS m, stddev_samp(TRY_CAST(amount AS DOUBLE)) AS sd FROM payments_dirty) s
        WHERE abs((x - s.m) / CASE WHEN coalesce(s.sd, 0) = 0 THEN 1.0 ELSE s.sd END) > 2.5)
  UNION ALL
  SELECT 4, 'Claim processing throughput (claims_undated)', 'count_over_time', 'claims_undated', 'skipped', NULL, NULL, count(*), count(*) FROM events
  UNION ALL
  SELECT 5, 'Pension/benefit liability forecast (pensions_broken)', 'liability_forecast', 'pensions_broken', 'failed', NULL, NULL, NULL, NULL
  UNION ALL
  SELECT 5 + row_number() OVER (ORDER BY n DESC, o), 'Table overview: ' || t, 'overview', t, 'synced', CAST(n AS DOUBLE), 'NORMAL', n, 0 FROM (
    SELECT 'contributions_ok' AS t, 1 AS o, count(*) AS n FROM orders UNION ALL SELECT 'payments_dirty', 2, count(*) FROM events
    UNION ALL SELECT 'claims_undated', 3, count(*) FROM events UNION ALL SELECT 'pensions_broken', 4, count(*) FROM orders
    UNION ALL SELECT 'stock_plain', 5, count(*) FROM part))"""))
def q_l3_dirty(spark, sf):
    """L3 over a set of tables with faults: what was synced, skipped or failed, with the rows read and rejected."""
    tabs = {t: fixture(spark, sf, t) for t in FAULTY_SQL}
    return discover.sync_analyses(spark, tabs, as_of="2001-08-02", recorded_at="2001-08-02")["status"].drop("error")


@register("l3_rejects_dirty", with_fixtures("""
SELECT 'payments_dirty' AS table_name, 'amount' AS column_name, value AS text, event_id AS ref FROM fx_dirty
WHERE value IS NOT NULL AND TRY_CAST(value AS DOUBLE) IS NULL
UNION ALL SELECT 'payments_dirty', 'payment_date', date, event_id FROM fx_dirty WHERE date IS NOT NULL AND TRY_CAST(date AS TIMESTAMP) IS NULL
UNION ALL SELECT 'claims_undated', 'closed_on', 'never', event_id FROM events"""))
def q_l3_rejects(spark, sf):
    """L3: the rows of the faulty tables whose amount or date cannot be read."""
    tabs = {t: fixture(spark, sf, t) for t in FAULTY_SQL}
    out = discover.rejects(tabs, discover.suggested_specs(spark, tabs))
    return out.select("table_name", "column_name", "text", F.get_json_object("row", "$.ref").cast("bigint").alias("ref"))


# ------------------------------------------------------------------ V6 / V7

@register("v6_prepared_dirty", with_fixtures("""
SELECT TRY_CAST(d.date AS TIMESTAMP) AS date, coalesce(d.kpi_name, st.mo_kpi) AS kpi_name,
  round(least(greatest(coalesce(TRY_CAST(d.value AS DOUBLE), st.md), st.mu - 3 * st.sd), st.mu + 3 * st.sd), 4) AS value,
  coalesce(d.category, st.mo_cat) AS category, d.event_id
FROM fx_dirty d, st""", ("st", """SELECT
  (SELECT kpi_name FROM fx_dirty WHERE kpi_name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, kpi_name LIMIT 1) AS mo_kpi,
  (SELECT category FROM fx_dirty WHERE category IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 1) AS mo_cat,
  quantile_cont(TRY_CAST(value AS DOUBLE), 0.5) AS md, avg(TRY_CAST(value AS DOUBLE)) AS mu,
  stddev_samp(TRY_CAST(value AS DOUBLE)) AS sd FROM fx_dirty""")))
def q_v6(spark, sf):
    """V6: the dirty frame after automatic preparation (value rounded to 4 for the comparison)."""
    cleaned, _ = prepare.auto_prepare(fixture(spark, sf, "fx_dirty"))
    return cleaned.withColumn("value", round_half_up("value", 4))


@register("v6_prepare_actions", with_fixtures("""
SELECT 'kpi_name' AS col, 'impute_mode' AS action, n - nn_k AS filled, CAST(0 AS BIGINT) AS coerced_nulls, mo_kpi AS value,
  NULL::BIGINT AS capped, NULL::DOUBLE AS range_lo, NULL::DOUBLE AS range_hi FROM st WHERE n - nn_k > 0
UNION ALL SELECT 'value', 'impute_median', n - nx_v, nx_v * 0 + (nn_v - nx_v), CAST(round(md, 4) AS STRING), NULL, NULL, NULL
  FROM st WHERE n - nx_v > 0
UNION ALL SELECT 'value', 'cap_outliers', NULL, NULL, NULL,
  (SELECT count(*) FROM fx_dirty WHERE TRY_CAST(value AS DOUBLE) < mu - 3 * sd OR TRY_CAST(value AS DOUBLE) > mu + 3 * sd),
  round(mu - 3 * sd, 2), round(mu + 3 * sd, 2) FROM st
UNION ALL SELECT 'category', 'impute_mode', n - nn_c, 0, mo_cat, NULL, NULL, NULL FROM st WHERE n - nn_c > 0
UNION ALL SELECT 'date', 'parse_datetime', NULL, NULL, NULL, NULL, NULL, NULL FROM st WHERE np_d > n * 0.5""",
    ("st", """SELECT
  (SELECT kpi_name FROM fx_dirty WHERE kpi_name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, kpi_name LIMIT 1) AS mo_kpi,
  (SELECT category FROM fx_dirty WHERE category IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 1) AS mo_cat,
  quantile_cont(TRY_CAST(value AS DOUBLE), 0.5) AS md, avg(TRY_CAST(value AS DOUBLE)) AS mu,
  stddev_samp(TRY_CAST(value AS DOUBLE)) AS sd, count(*) AS n, count(value) AS nn_v, count(TRY_CAST(value AS DOUBLE)) AS nx_v,
  count(kpi_name) AS nn_k, count(category) AS nn_c, count(TRY_CAST(date AS TIMESTAMP)) AS np_d FROM fx_dirty""")))
def q_v6_actions(spark, sf):
    """V6: the preparation action log of the dirty frame."""
    _, actions = prepare.auto_prepare(fixture(spark, sf, "fx_dirty"))
    return actions


def _roles_sql(tab: str, cols: list[tuple[str, str]]) -> str:
    parts = []
    for i, (c, kind) in enumerate(cols):
        low = c.lower()
        if kind == "date":
            role = "CASE WHEN count({c}) = 0 THEN 'empty' ELSE 'date' END"
        elif kind == "num":
            ident = any(k in low for k in prepare.NUMERIC_ID_HINTS)
            role = ("CASE WHEN count({c}) = 0 THEN 'empty' " +
                    ("ELSE 'identifier' END" if ident else
                     "WHEN stddev_samp({c}) / nullif(avg({c}), 0) > 0.1 THEN 'metric' ELSE 'dimension_numeric' END"))
        else:
            ident = any(k in low for k in prepare.TEXT_ID_HINTS)
            role = ("CASE WHEN count({c}) = 0 THEN 'empty' WHEN count(DISTINCT {c}) <= 20 THEN 'category' " +
                    ("ELSE 'identifier' END" if ident else "ELSE 'text' END"))
        hint = "CAST(NULL AS VARCHAR)"
        if kind == "str" and (low.endswith("_id") or low.endswith("_code")):
            hint = f"'{low.replace('_id', '').replace('_code', '')}'"
        parts.append(f"SELECT {i + 1} AS ordinal, '{c}' AS column_name, {role.format(c=c)} AS role, "
                     f"CASE WHEN {role.format(c=c)} = 'identifier' THEN {hint} END AS likely_references, "
                     f"count(*) AS row_count, {len(cols)} AS column_count FROM {tab}")
    return " UNION ALL ".join(parts)


ORDERS_KINDS = [("o_orderkey", "num"), ("o_custkey", "num"), ("o_orderstatus", "str"), ("o_totalprice", "num"),
                ("o_orderdate", "date"), ("o_orderpriority", "str")]
EVENTS_KINDS = [("event_id", "num"), ("ts", "date"), ("user_id", "num"), ("event_type", "str"), ("value", "num"),
                ("props", "str")]


@register("v7_roles_orders", _roles_sql("orders", ORDERS_KINDS))
def q_v7(spark, sf):
    """V7: column roles of orders."""
    roles, _ = prepare.auto_model(table(spark, sf, "orders"))
    return roles.withColumn("column_count", F.col("column_count").cast("int"))


@register("v7_roles_events", _roles_sql("events", EVENTS_KINDS))
def q_v7_events(spark, sf):
    """V7: column roles of events."""
    roles, _ = prepare.auto_model(table(spark, sf, "events"))
    return roles.withColumn("column_count", F.col("column_count").cast("int"))


@register("v7_kpi_candidates_lineitem", " UNION ALL ".join(
    f"SELECT {i} AS ordinal, '{c}' AS column_name FROM lineitem HAVING count({c}) > 0 AND stddev_samp({c}) / nullif(avg({c}), 0) > 0.1"
    for i, c in [(5, "l_quantity"), (6, "l_extendedprice"), (7, "l_discount"), (8, "l_tax")]))
def q_v7_candidates(spark, sf):
    """V7: the KPI candidates of lineitem (its keys and its line number are identifiers by name)."""
    roles, _ = prepare.auto_model(table(spark, sf, "lineitem"))
    return prepare.kpi_candidates(roles)


@register("a18_run_suggestions_orders", """
SELECT 1 AS ordinal, CAST(CAST(o_orderdate AS DATE) AS STRING) AS bucket, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY 2
UNION ALL SELECT 2, o_orderstatus, round(sum(o_totalprice), 2) FROM orders GROUP BY 2
UNION ALL SELECT 3, o_orderpriority, round(sum(o_totalprice), 2) FROM orders GROUP BY 2""")
def q_a18(spark, sf):
    """Every roll-up the modeller suggests for orders (time series + 2 categories)."""
    orders = table(spark, sf, "orders")
    _, sugg = prepare.auto_model(orders)
    return prepare.run_suggestions(orders, sugg).withColumn("total", round_half_up("total", 2))
