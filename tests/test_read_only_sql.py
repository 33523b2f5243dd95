"""What a read-only query may do, and attacks that it refuses."""

import pytest

from autokpi.sources import readers

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def orders(spark):
    spark.range(3).createOrReplaceTempView("secret")
    spark.range(3).createOrReplaceGlobalTempView("secret_global")
    yield spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    spark.catalog.dropTempView("secret")
    spark.catalog.dropGlobalTempView("secret_global")


ATTACKS = [
    "SELECT * FROM (SELECT count(*) c FROM secret) AS secret",
    "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
    "SELECT (SELECT max(id) FROM secret) FROM orders",
    "SELECT * FROM orders WHERE o_orderkey IN (SELECT id FROM secret)",
    "SELECT * FROM orders o, LATERAL (SELECT id FROM secret WHERE id = o.o_orderkey)",
    f"SELECT * FROM parquet.`{SF_SMALL}/customer.parquet`",
    "SELECT * FROM global_temp.secret_global",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM orders",
    "SELECT upper(java_method('java.lang.System', 'getenv', 'HOME'))",
    "SELECT * FROM orders WHERE EXISTS (SELECT 1 FROM orders WHERE input_file_name() LIKE '%x%')",
    "SELECT 1; DROP TABLE orders",
    "DROP VIEW orders",
    "CREATE TABLE t AS SELECT 1",
    "INSERT INTO orders SELECT * FROM orders",
    "FROM orders INSERT OVERWRITE DIRECTORY '/tmp/x' USING parquet SELECT *",
    "SET spark.sql.ansi.enabled=false",
    "SHOW TABLES",
    "DESCRIBE orders",
    "EXPLAIN SELECT * FROM orders",
]


@pytest.mark.parametrize("sql", ATTACKS)
def test_attacks_are_refused(spark, orders, sql):
    with pytest.raises(Exception) as refused:
        readers.run_sql(spark, sql, {"orders": orders}).collect()
    assert type(refused.value).__name__ in ("ValueError", "ParseException", "AnalysisException")


def test_queries_of_every_kind_run(spark, orders):
    given = {"orders": orders, "nation_names": spark.read.parquet(f"{SF_SMALL}/nation.parquet")}
    run = lambda sql: readers.run_sql(spark, sql, given).count()
    n = orders.count()
    assert run("SELECT * FROM Orders") == n and run("FROM orders SELECT o_orderkey;") == n
    assert run("WITH created_at AS (SELECT 1 AS drop_table FROM orders) SELECT * FROM created_at") == n
    assert run("SELECT * FROM (SELECT o_orderkey AS secret FROM orders) AS secret") == n
    assert run("SELECT 'DROP TABLE x; --' AS insert_into FROM orders LIMIT 3") == 3
    assert run("SELECT o_orderstatus, count(DISTINCT o_custkey), rank() OVER (ORDER BY count(*)) FROM orders GROUP BY ROLLUP (o_orderstatus)") >= 2
    assert run("SELECT * FROM orders PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F', 'O'))") > 0
    assert run("SELECT explode(sequence(1, 3)) FROM `nation_names` UNION ALL SELECT * FROM VALUES (1)") == 76
    assert run("SELECT a.o_orderkey FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE a.o_orderkey = b.o_orderkey) "
               "EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'") > 0
    assert run("SELECT * FROM orders TABLESAMPLE (100 PERCENT)") == n and run("SELECT id FROM range(4)") == 4


def test_views_and_settings_do_not_outlive_the_call(spark, orders):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = readers.run_sql(spark, "SELECT current_timezone() AS tz, count(*) AS n FROM orders_here", {"orders_here": orders}).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got.tz == "Asia/Tokyo" and got.n == orders.count()
    assert not spark.catalog.tableExists("orders_here")
    assert [t.name for t in spark.catalog.listTables("global_temp") if t.name.startswith("handed")] == []
