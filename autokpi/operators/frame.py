"""The canonical KPI frame and row-level projections (P1, P3, P4, P5, K4 helper).

KPI frame columns: date TIMESTAMP_NTZ, kpi_name STRING, value DOUBLE,
source_row_id STRING, record_label STRING, customer_id STRING,
report_date DATE; extra columns are carried along.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autokpi.functions.core import lenient_double, lenient_timestamp, ntz_literal, title_label
from autokpi.functions.ids import content_ids, positional_index, row_content

KPI_COLUMNS = ["date", "kpi_name", "value", "source_row_id", "record_label", "customer_id", "report_date"]

KPI_SCHEMA = T.StructType([
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("kpi_name", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("source_row_id", T.StringType()),
    T.StructField("record_label", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("report_date", T.DateType()),
])

# KPI names retired from responses (exact match, or after
# "_" -> space + title case).
RETIRED_KPI_NAMES = (
    "net_revenue", "inventory_value", "support_tickets",
    "Total Revenue", "Inventory Value", "Support Tickets",
)


def canonicalise(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Coerce to the KPI frame.

    Requires ``date``, ``kpi_name``, ``value`` (error lists the missing ones,
    sorted).  Rows with any of the three null after lenient coercion are dropped.
    ``source_row_id`` / ``record_label`` / ``customer_id`` are filled only when
    the column is absent: content hash + occurrence, ``kpi_name``, and
    ``CUST-0001..`` by position in ``order_by`` (default: date, kpi_name, value).
    Scale: narrow (no shuffle) unless an id has to be generated; content ids
    add one count by content hash, positional ids one range sort and a
    reliable checkpoint (see ``functions.ids``).
    """
    missing = sorted({"date", "kpi_name", "value"} - set(df.columns))
    if missing:
        raise ValueError(f"Extracted data is missing required columns: {', '.join(missing)}")
    dtypes = dict((f.name, f.dataType) for f in df.schema.fields)
    need_ids = "source_row_id" not in df.columns
    if need_ids:
        df = df.withColumn("__content", row_content(df))
    out = (df.withColumn("date", lenient_timestamp("date", dtypes["date"]))
           .withColumn("value", lenient_double("value"))
           .withColumn("kpi_name", F.col("kpi_name").cast("string"))
           .filter(F.col("date").isNotNull() & F.col("kpi_name").isNotNull() & F.col("value").isNotNull()))
    if "source_row_id" in df.columns:
        out = out.withColumn("source_row_id", F.col("source_row_id").cast("string"))
    else:
        out = content_ids(out, "source_row_id", content_col="__content").drop("__content")
    if "record_label" not in df.columns:
        out = out.withColumn("record_label", F.col("kpi_name"))
    if "customer_id" not in df.columns:
        order = order_by or ["date", "kpi_name", "value"]
        out = positional_index(out, order, "__pos")
        out = out.withColumn("customer_id", F.format_string("CUST-%04d", F.col("__pos"))).drop("__pos")
    out = out.withColumn("report_date", F.to_date("date"))
    extra = [c for c in out.columns if c not in KPI_COLUMNS]
    return out.select(*KPI_COLUMNS, *extra)


def empty_kpi_frame(spark) -> DataFrame:
    return spark.createDataFrame([], KPI_SCHEMA)


def trailing(df: DataFrame, ts: str, days: int, as_of) -> DataFrame:
    """Rows strictly later than ``as_of - days``.

    ``as_of`` is a literal (date/datetime/ISO text) so the bound is a constant
    and reaches the Parquet scan as a pushed filter / partition prune.
    """
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    elif isinstance(as_of, _dt.date) and not isinstance(as_of, _dt.datetime):
        as_of = _dt.datetime.combine(as_of, _dt.time())
    bound = as_of - _dt.timedelta(days=days)
    return df.filter(F.col(ts) > ntz_literal(bound))


def is_retired(name: Column) -> Column:
    """P3 predicate: exact match or match after ``_`` -> space + title case."""
    names = list(RETIRED_KPI_NAMES)
    return name.isin(names) | title_label(name).isin(names)


def hide_retired(df: DataFrame, col: str = "kpi_name") -> DataFrame:
    """Drop rows naming a retired KPI.  A null name is kept."""
    return df.filter(~F.coalesce(is_retired(F.col(col)), F.lit(False)))


def hide_retired_messages(df: DataFrame, col: str = "message") -> DataFrame:
    """Drop validation messages naming a retired KPI (case-insensitive, both spellings)."""
    names = set(RETIRED_KPI_NAMES)
    names |= {n.replace("_", " ").title() for n in RETIRED_KPI_NAMES}
    hit = F.lit(False)
    for n in sorted(names):
        hit = hit | F.lower(F.col(col)).contains(n.lower())
    return df.filter(~F.coalesce(hit, F.lit(False)))


# A report that holds all of these phrases is a retired demonstration report.
RETIRED_REPORT_PHRASES = ("Net Revenue is 190,000", "Inventory Value is", "Support Tickets is 150")


def hide_retired_reports(df: DataFrame, col: str = "narrative") -> DataFrame:
    """Drop reports whose text holds every marker phrase (as spelt); a null text stays."""
    every = F.lit(True)
    for phrase in RETIRED_REPORT_PHRASES:
        every = every & F.col(col).contains(phrase)
    return df.filter(~F.coalesce(every, F.lit(False)))


def _json_value(c: Column, t: T.DataType) -> Column:
    """``c`` with the leaves of its type in JSON-safe form, nested ones too."""
    if isinstance(t, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        part = F.date_format(c, "SSSSSS")
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part == "000000", "").otherwise(F.concat(F.lit("."), part)))
    if isinstance(t, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(t, T.DecimalType):
        return c.cast("double")
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _json_value(x, t.elementType))
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_json_value(c.getField(f.name), f.dataType).alias(f.name) for f in t.fields]))
    if isinstance(t, T.MapType):
        keyed = F.transform_keys(c, lambda k, _: _json_value(k, t.keyType))
        return F.transform_values(keyed, lambda _, v: _json_value(v, t.valueType))
    return c


def json_safe(df: DataFrame) -> DataFrame:
    """P5: JSON-safe projection by type (narrow, no shuffle).

    Dates/timestamps -> ISO text (with six decimals where the second is not
    whole), binary -> lower hex, decimal -> double, arrays/structs/maps -> JSON
    text whose parts follow the same rules; everything else unchanged.
    """
    cols = []
    for f in df.schema.fields:
        c = _json_value(F.col(f"`{f.name}`"), f.dataType)
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)
