"""Derived fixture views (FIXTURES.md §3).

The same SQL text runs in Spark (over temp views of the driver tables) and in
DuckDB (as CTEs of the oracle queries), so both engines see identical inputs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# The derived views of FIXTURES.md §3, verbatim.
FIXTURE_SQL: dict[str, str] = {
    "fx_frame": """
SELECT ts AS date, event_type AS kpi_name, value, CAST(event_id AS STRING) AS source_row_id,
       event_type AS record_label, CAST(user_id AS STRING) AS customer_id, CAST(ts AS DATE) AS report_date
FROM events""",
    "fx_kpi_daily": """
SELECT CAST(ts AS DATE) AS date, event_type AS kpi_name, ROUND(SUM(value), 2) AS value
FROM events GROUP BY CAST(ts AS DATE), event_type""",
    "fx_kpi_orders": """
SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS kpi_name, ROUND(SUM(o_totalprice), 2) AS value
FROM orders GROUP BY CAST(o_orderdate AS DATE), o_orderpriority""",
    "fx_dirty": """
SELECT CASE WHEN event_id % 97 = 0 THEN 'not-a-date' ELSE CAST(CAST(ts AS DATE) AS STRING) END AS date,
       CASE WHEN event_id % 83 = 0 THEN NULL ELSE event_type END AS kpi_name,
       CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 79 = 0 THEN 'n/a'
            WHEN event_id % 1009 = 1 THEN '99999' ELSE CAST(value AS STRING) END AS value,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS category,
       event_id
FROM events""",
    "fx_departments": """
SELECT CAST(r_regionkey AS INT) AS id, r_name AS name, 1 AS template_id,
       CASE WHEN r_regionkey % 2 = 0 THEN 'daily' ELSE 'weekly' END AS heartbeat_schedule
FROM region""",
    "fx_user_roles": """
SELECT CAST(n_nationkey AS INT) AS user_id,
       CASE WHEN n_nationkey % 7 = 6 THEN NULL ELSE CAST(n_regionkey AS INT) END AS department_id,
       CASE WHEN n_nationkey = 6 THEN 'admin' WHEN n_nationkey % 3 = 0 THEN 'viewer' ELSE 'manager' END AS role
FROM nation""",
    "fx_kpi_results": """
SELECT CAST(n.n_regionkey AS INT) AS department_id, CAST(n.n_nationkey AS INT) AS user_id,
       o.o_orderpriority AS kpi_name, CAST(o.o_orderdate AS DATE) AS recorded_at,
       ROUND(SUM(o.o_totalprice), 2) AS value, COUNT(*) AS source_record_count,
       CASE WHEN MAX(o.o_orderkey) % 11 = 0 THEN 'CRITICAL' WHEN MAX(o.o_orderkey) % 5 = 0 THEN 'WARNING' ELSE 'NORMAL' END AS status
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_regionkey, n.n_nationkey, o.o_orderpriority, CAST(o.o_orderdate AS DATE)""",
    "fx_validation_logs": """
SELECT event_id AS id, CAST(user_id % 4 AS INT) AS department_id,
       CASE event_id % 3 WHEN 0 THEN 'schema' WHEN 1 THEN 'null' ELSE 'anomaly' END AS check_type,
       CASE WHEN value < 15 THEN 'pass' WHEN value < 60 THEN 'warning' ELSE 'fail' END AS status,
       ts AS created_at
FROM events""",
    "fx_feedback": """
SELECT o_orderkey AS id, o_custkey AS customer_id, CAST(o_orderkey % 11 AS INT) AS score,
       CASE o_orderkey % 3 WHEN 0 THEN 'Email' WHEN 1 THEN 'Web' ELSE 'In-App' END AS channel,
       CAST(o_orderdate AS DATE) AS submitted_at, 'ref ' || CAST(o_orderkey AS STRING) || ' ' || o_orderpriority AS feedback_text
FROM orders""",
    "fx_fields": """
SELECT * FROM (VALUES (1, 1, 'event_value', 'float', true), (2, 1, 'kind', 'string', true),
  (3, 1, 'order_total_price', 'currency', false), (4, 1, 'customer_id', 'string', false))
  AS t(id, template_id, global_field_name, data_type, required)""",
    "fx_mappings": """
SELECT * FROM (VALUES (1, 'value', '{"type":"multiply","factor":100}'), (2, 'event_type', '{"type":"uppercase"}'),
  (9, 'value', '{"type":"add","offset":1}'), (4, 'no_such_column', NULL)) AS t(template_field_id, local_column_name, transformation_rule)""",
    "fx_templates": """
SELECT * FROM (VALUES (1, '{"validation_rules":{"null_threshold":0.2}}'), (2, '{}')) AS t(id, config)""",
    "fx_prefs": """
SELECT CAST(n_nationkey AS INT) AS user_id, '02:00' AS sync_time,
       CASE n_nationkey % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'monthly' ELSE 'yearly' END AS sync_frequency,
       CASE WHEN n_nationkey % 8 = 3 THEN '01-01' ELSE '06-15' END AS yearly_date
FROM nation""",
    "fx_ingest": """
SELECT '{"department":"' || r_name || '","report_date":"2024-01-30","kpis":[{"kpi_name":"a","value":' || CAST(r_regionkey AS STRING) || '}]}' AS payload
FROM region""",
}

# Derived tables shaped like the reference's demo social-insurance schema, built
# from the driver tables so that every discovery rule meets real data.
DEMO_SQL: dict[str, str] = {
    "contributions": """
SELECT o_orderkey AS id, o_custkey AS employer_id, o_totalprice AS amount, o_orderdate AS paid_at, o_orderstatus AS status
FROM orders""",
    "payments": """
SELECT l_orderkey AS id, l_linenumber AS line_no, l_extendedprice AS amount, l_shipdate AS payment_date FROM lineitem""",
    "claims": """
SELECT event_id AS id, user_id AS beneficiary_id, event_type AS claim_type, ts AS created_at FROM events""",
    "beneficiaries": """
SELECT c_custkey AS id, c_name AS full_name, c_mktsegment AS segment, c_nationkey AS region_code FROM customer""",
    "pensions": """
SELECT o_orderkey AS id, o_custkey AS beneficiary_id, o_totalprice AS monthly_amount, o_orderdate AS paid_on
FROM orders WHERE o_orderstatus = 'F'""",
}
FIXTURE_SQL.update(DEMO_SQL)

# Semantic configuration derived from the data: one field per event type
# (template 2; click and view required) and a mapping of ``value`` to each
# field except the error one, on top of the fixed fx_fields / fx_mappings rows.
CONFIG_SQL: dict[str, str] = {
    "fields_all": """
SELECT id, template_id, global_field_name, data_type, required FROM fx_fields
UNION ALL
SELECT CAST(100 + row_number() OVER (ORDER BY event_type) AS INT), 2, event_type || '_value', 'float',
       event_type IN ('click', 'view')
FROM (SELECT DISTINCT event_type FROM events)""",
    "mappings_all": """
SELECT template_field_id, local_column_name, transformation_rule FROM fx_mappings
UNION ALL
SELECT id, 'value', '{"type":"multiply","factor":' || CAST(id - 100 AS STRING) || '}' FROM fields_all
WHERE template_id = 2 AND global_field_name <> 'error_value'""",
}
FIXTURE_SQL.update(CONFIG_SQL)

# A set of tables with faults: unparsable amounts and dates, a date column
# without any date, and a table whose amount raises an error when it is read.
FAULTY_SQL: dict[str, str] = {
    "contributions_ok": "SELECT o_orderkey AS id, o_totalprice AS amount, o_orderdate AS paid_at FROM orders",
    "payments_dirty": "SELECT event_id AS ref, value AS amount, date AS payment_date FROM fx_dirty",
    "claims_undated": "SELECT event_id AS ref, 'never' AS closed_on FROM events",
    "pensions_broken": "SELECT o_orderkey AS ref, CAST(o_orderpriority AS INT) AS monthly_amount, o_orderdate AS paid_on FROM orders",
    "stock_plain": "SELECT p_partkey AS ref, p_brand AS brand FROM part",
}
FIXTURE_SQL.update(FAULTY_SQL)

_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _tables_in(sql: str) -> list[str]:
    words = set(_WORD.findall(sql))
    return [t for t in BASE_TABLES if t in words]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table (Parquet)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build a derived fixture view as a lazy DataFrame (fixture views it
    names are registered first)."""
    sql = FIXTURE_SQL[name]
    register_tables(spark, sf_dir, _tables_in(sql))
    for dep in FIXTURE_SQL:
        if dep != name and re.search(rf"\b{dep}\b", sql):
            fixture(spark, sf_dir, dep).createOrReplaceTempView(dep)
    return spark.sql(sql)


def with_fixtures(body: str, *ctes: tuple[str, str]) -> str:
    """Prefix an oracle query with the fixture CTEs it names, plus extra CTEs."""
    text = body + " ".join(c for _, c in ctes)
    used = [n for n in FIXTURE_SQL if re.search(rf"\b{n}\b", text)]
    # fixtures named by other fixtures come first (dict order already lists them earlier)
    for n in list(used):
        for dep in FIXTURE_SQL:
            if dep not in used and re.search(rf"\b{dep}\b", FIXTURE_SQL[n]):
                used.append(dep)
    used = [n for n in FIXTURE_SQL if n in used]
    parts = [f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in used]
    parts += [f"{n} AS ({c.strip()})" for n, c in ctes]
    if not parts:
        return body.strip()
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
