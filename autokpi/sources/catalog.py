"""Catalog and profiling over a set of named tables.

The catalog is schema metadata (bounded by tables × columns) turned into a
DataFrame; every data-dependent profile (row counts, keys, foreign keys,
samples) is a Spark job over the tables themselves, batched into as few jobs
as possible (one ``union`` of per-table aggregates instead of a job per table).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autokpi.sources import value_index

CATALOG_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("table_ordinal", T.IntegerType()),
    T.StructField("is_view", T.BooleanType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("nullable", T.BooleanType()),
])


def catalog_columns(spark: SparkSession, tables: dict[str, DataFrame], views: set[str] | None = None,
                    max_tables: int | None = None) -> DataFrame:
    """One row per (table, column): ordinal (1-based), Spark type, nullability.

    Tables come before views; all of them, or the first ``max_tables``.  Built on the
    driver from schemas only (no data is read).
    """
    views = views or set()
    names = [n for n in tables if n not in views] + [n for n in tables if n in views]
    rows = []
    for ti, name in enumerate(names[:max_tables]):
        for ci, f in enumerate(tables[name].schema.fields):
            rows.append((name, ti + 1, name in views, ci + 1, f.name, f.dataType.simpleString(), f.nullable))
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def catalog_from_spark(spark: SparkSession, database: str | None = None, max_tables: int | None = None) -> DataFrame:
    """S4 over the session catalog (``listTables`` / ``listColumns``)."""
    tabs = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    ordered = [t for t in tabs if t.tableType != "VIEW"] + [t for t in tabs if t.tableType == "VIEW"]
    rows = []
    for ti, t in enumerate(ordered[:max_tables]):
        cols = spark.catalog.listColumns(t.name, database) if database else spark.catalog.listColumns(t.name)
        for ci, c in enumerate(cols):
            rows.append((t.name, ti + 1, t.tableType == "VIEW", ci + 1, c.name, c.dataType, bool(c.nullable)))
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Exact row count per table (with its catalog position), all tables
    in one job (union of per-table global counts)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(name).alias("table_name"), F.lit(i + 1).alias("table_ordinal"), "row_count")
             for i, (name, df) in enumerate(tables.items())]
    return reduce(DataFrame.unionByName, parts)


def sample_rows(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """S5/S8 preview: the first ``n`` rows by ``order_by`` (default: all columns)
    — a TakeOrderedAndProject (per-partition top-n, then a merge of n per task)."""
    cols = order_by or df.columns
    return df.orderBy(*cols).limit(n)


def preview(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows (10 for overview, 20 for the query page), ordered by key."""
    return sample_rows(df, n, order_by)


def candidate_keys_many(tables: dict[str, DataFrame]) -> DataFrame:
    """S6 for many tables: their non-null, unique columns, from one scan of each (see ``value_index``)."""
    return value_index.candidate_keys(value_index.column_facts(tables))


def candidate_keys(df: DataFrame, table_name: str = "") -> DataFrame:
    """S6 for one table: columns that are non-null and unique."""
    return candidate_keys_many({table_name: df})


def foreign_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column) -> (ref_table, ref_column) when every non-null value
    of the column appears in another table's candidate key of the same type.

    Keys and inclusions come from the same index, so each table is scanned
    once, however many pairs of columns there are.
    """
    return value_index.foreign_keys(value_index.column_facts(tables))


def largest(profile: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest tables with rows > 0 (ties: catalog order)."""
    return (profile.filter(F.col("row_count") > 0).orderBy(F.col("row_count").desc(), "table_ordinal").limit(n)
            .select("table_name", "row_count"))


def overview_kpis(profile: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest tables as KPI rows ``Table rows: <name>``."""
    top = profile.orderBy(F.col("row_count").desc_nulls_last(), "table_ordinal").limit(n)
    return top.select(F.concat(F.lit("Table rows: "), F.col("table_name")).alias("kpi_name"),
                      F.col("row_count").cast("double").alias("value"))


def count_tables(catalog: DataFrame) -> DataFrame:
    """Number of tables."""
    return catalog.agg(F.count_distinct("table_name").alias("table_count"))


def list_tables(catalog: DataFrame) -> DataFrame:
    """Table names with their column counts."""
    return (catalog.groupBy("table_name", "table_ordinal").agg(F.count(F.lit(1)).alias("column_count"))
            .orderBy("table_ordinal").drop("table_ordinal"))


def describe(catalog: DataFrame, table_name: str) -> DataFrame:
    """Columns of one table."""
    return (catalog.filter(F.col("table_name") == table_name).orderBy("ordinal")
            .select("ordinal", "column_name", "data_type", "nullable"))
