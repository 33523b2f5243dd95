"""V2, V3, V5, A7 with KPI names as data; J5 bitmaps; S1 connection strings; V13 auto."""

import random

import pytest
from pyspark.sql import functions as F

from autokpi.operators import mapping, quality, rollups
from autokpi.sources import readers, value_index


def test_long_validation_equals_the_wide_one(spark):
    rng = random.Random(2)
    names = ["it's", 'say "x"', "a`b", "a.b", "net_revenue", "k1", "k2", "k3"]
    rows = [(f"2024-01-0{rng.randint(1, 3)}", rng.choice(names), rng.choice([1.0, 2.5, None, -4.0]), rng.choice(["c1", "c2", None]), i, rng.choice(["x", None]), rng.choice([1, None]))
            for i in range(300)]
    df = spark.createDataFrame(rows, "date string, kpi_name string, value double, customer_id string, source_row_id int, region string, `n'o` int").withColumn("date", F.to_date("date"))
    df = df.withColumn("report_date", F.col("date"))
    fields = spark.createDataFrame([(1, "it's", True), (2, "region", True), (3, "absent", True)], "id int, global_field_name string, required boolean")
    for frame in (df, df.filter("date = '2024-01-01'"), df.filter("kpi_name <> 'k1' or date < '2024-01-03'"), df.limit(0)):
        wide = quality.validate(quality.validation_frame(frame), fields, 0.2, 0.1).collect()
        long = quality.validate_long(frame, fields, 0.2, 0.1).collect()
        if frame.isEmpty():
            assert [r.status for r in long] == ["fail", "pass", "pass"]
        else:
            assert sorted(map(tuple, long), key=str) == sorted(map(tuple, wide), key=str)


def test_twenty_thousand_kpi_names(spark):
    df = spark.range(60000).select(F.concat(F.lit("k'"), (F.col("id") % 20000).cast("string")).alias("kpi_name"), (F.col("id") % 7).cast("double").alias("value"),
                                   F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 20000).cast("int")).alias("report_date"), F.col("id").alias("source_row_id"))
    out = {r.check_type: r.status for r in quality.validate_long(df, spark.createDataFrame([(1, "k'5", True)], "id int, global_field_name string, required boolean")).collect()}
    assert out == {"schema": "pass", "null": "pass", "anomaly": "warning"}
    assert quality.validation_maps(df).select(F.size("kpis")).first()[0] == 20000


def test_row_visibility_equals_the_counts(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.choice([None, 1, 2, 3]), rng.choice([None, 5, 40000, 70000, 9]), i) for i in range(200)], "department_id int, user_id int, n int")
    roles = spark.createDataFrame([(5, 1, "viewer"), (5, 2, "viewer"), (40000, None, "viewer"), (70000, 3, "manager"), (8, None, "admin"), (8, 1, "admin")],
                                  "user_id int, department_id int, role string")
    seen = rollups.row_visibility(df, roles)
    for r in rollups.visible_row_counts(df, roles).collect():
        assert seen.filter(rollups.sees(F.col("viewers"), r.user_id)).count() == r.visible_rows
    rows = seen.collect()
    assert len(rows) == 200 and sum(r.visible_to for r in rows) == sum(r.visible_rows for r in rollups.visible_row_counts(df, roles).collect())


def test_key_discovery_handles_names_types_and_nulls(spark):
    a = spark.createDataFrame([(1, "x", 1.5, None), (2, "y", 2.5, 7), (3, "x", 0.0, 7)], "`it's` int, `a``b` string, `a.b` double, n int")
    b = spark.createDataFrame([(1, None), (3, None), (1, None)], "ref int, empty string")
    tables = {"t'1": a, "two": b, "none": a.limit(0).select(F.col("it's").alias("id"))}
    facts = value_index.column_facts(tables)
    assert sorted(map(tuple, value_index.candidate_keys(facts).collect())) == [("t'1", "a.b"), ("t'1", "it's")]
    assert sorted(map(tuple, value_index.foreign_keys(facts).collect())) == [("two", "ref", "t'1", "it's")]
    wide = spark.range(200).select(*[(F.col("id") % (k + 1)).alias(f"c{k}") for k in range(150)], F.col("id").alias("key"))
    facts = value_index.column_facts({"wide": wide, "other": wide.select(F.col("key").alias("k2"))})
    assert sorted(map(tuple, value_index.candidate_keys(facts).collect())) == [("other", "k2"), ("wide", "key")]
    assert value_index.foreign_keys(facts).count() == 152


@pytest.mark.parametrize("given, dialect, want", [
    ("mysql+pymysql://u:p%40w@h:3307/db?charset=utf8", "mysql", ("jdbc:mysql://h:3307/db?charset=utf8", "u", "p@w")),
    ("postgresql+psycopg2://u:p@h/db", "postgresql", ("jdbc:postgresql://h/db", "u", "p")),
    ("postgres://u@h:5432/db", "postgresql", ("jdbc:postgresql://h:5432/db", "u", None)),
    ("mssql+pyodbc://sa:x@h:1433/sales?driver=ODBC+Driver&encrypt=true", "sqlserver", ("jdbc:sqlserver://h:1433;databaseName=sales;encrypt=true", "sa", "x")),
    ("mssql+pymssql://h/sales", "sqlserver", ("jdbc:sqlserver://h;databaseName=sales", None, None)),
    ("oracle+oracledb://u:p@h:1521/?service_name=XE", "oracle", ("jdbc:oracle:thin:@//h:1521/XE", "u", "p")),
    ("sqlite:///data/shop.db", "sqlite", ("jdbc:sqlite:data/shop.db", None, None)),
    ("sqlite:////var/shop.db", "sqlite", ("jdbc:sqlite:/var/shop.db", None, None)),
    ("shop.db", "sqlite", ("jdbc:sqlite:shop.db", None, None)),
    ("h:3306/db", "mysql", ("jdbc:mysql://h:3306/db", None, None)),
    ("jdbc:derby:memory:x;create=true", "derby", ("jdbc:derby:memory:x;create=true", None, None)),
])
def test_connection_strings(given, dialect, want):
    assert readers.jdbc_target(given, dialect) == want


def test_template_without_fields_is_auto(spark):
    fields = spark.createDataFrame([(1, 1, "a", True)], "id int, template_id int, global_field_name string, required boolean")
    none = spark.createDataFrame([], "template_field_id int, local_column_name string")
    templates = spark.createDataFrame([(1,), (2,)], "id int")
    assert sorted((r.template_id, r.mode, r.total_fields) for r in mapping.kpi_mode(fields, none, templates).collect()) == [(1, "configured-unmapped", 1), (2, "auto", 0)]
