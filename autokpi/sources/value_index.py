"""Inverted value index: which columns hold which values.

Every table is scanned once and turned into (type, value, column) counts;
grouping by value gives the *set of columns* that hold it, as bits.  Equal sets
are merged at once, so all that follows works on the few distinct sets: a column
is a key when no set shows it with a null or a repeated value, and the columns
that contain all values of a column are the intersection of all its sets.

Values meet only within one type.  Numbers, dates and times stand for
themselves; other values by two 64-bit hashes, so that long texts are not
shuffled.  Counts are combined before the first shuffle (a hot value costs a
row per task); the second moves one row per distinct value and column; the last
has a row per column.  Nothing is sampled or estimated, and only names and types
are known on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autokpi.functions.core import quoted

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
_BITS = 63
_FACTS = "column_no int, table_name string, column_name string, data_type string"


def indexed_columns(tables: dict[str, DataFrame]) -> list[tuple[int, str, str, T.DataType]]:
    """(number, table, column, type) of every column with comparable values, in table and schema order."""
    cols = [(t, f.name, f.dataType) for t, df in tables.items() for f in df.schema.fields
            if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType, T.NullType))]
    return [(i, *c) for i, c in enumerate(cols)]


def _cell(number: int, type_no: int, name: str, kind: T.DataType) -> Column:
    c = quoted(name)
    if isinstance(kind, _WHOLE):
        parts = c.cast("long"), F.lit(0).cast("long")
    elif isinstance(kind, T.DateType):
        parts = F.unix_date(c).cast("long"), F.lit(0).cast("long")
    elif isinstance(kind, T.TimestampType):
        parts = F.unix_micros(c), F.lit(0).cast("long")
    else:
        parts = F.when(c.isNotNull(), F.xxhash64(c)), F.when(c.isNotNull(), F.xxhash64(F.lit(1), c))
    return F.struct(F.lit(number).alias("col"), F.lit(type_no).alias("type"), parts[0].alias("v"), parts[1].alias("w"))


def _bit(word: int, marked: Column | None = None) -> Column:
    bit = F.when(F.floor(F.col("col") / _BITS) == word, F.expr(f"shiftleft(1L, cast(col % {_BITS} as int))")).otherwise(F.lit(0).cast("long"))
    return bit if marked is None else F.when(marked, bit).otherwise(F.lit(0).cast("long"))


def value_sets(tables: dict[str, DataFrame]) -> DataFrame:
    """The distinct sets of columns that share a value: (is_null, holds, repeats), both arrays of bit words."""
    cols = indexed_columns(tables)
    type_no = {k: i for i, k in enumerate(dict.fromkeys(kind.simpleString() for _, _, _, kind in cols))}
    parts = []
    for t, df in tables.items():
        cells = [_cell(i, type_no[kind.simpleString()], c, kind) for i, t2, c, kind in cols if t2 == t]
        if cells:
            parts.append(df.select(F.inline(F.array(*cells))))
    counts = reduce(DataFrame.unionByName, parts).groupBy("type", "v", "w", "col").agg(F.count(F.lit(1)).alias("n"))
    words = range(-(-len(cols) // _BITS))
    sets = counts.groupBy("type", "v", "w").agg(*[F.bit_or(_bit(k)).alias(f"h{k}") for k in words],
                                                *[F.bit_or(_bit(k, F.col("n") > 1)).alias(f"r{k}") for k in words])
    return sets.select(F.col("v").isNull().alias("is_null"), F.array(*[f"h{k}" for k in words]).alias("holds"),
                       F.array(*[f"r{k}" for k in words]).alias("repeats")).distinct()


def _set(words: str, number: str) -> Column:
    return F.expr(f"(shiftright(element_at({words}, cast({number} div {_BITS} as int) + 1), cast({number} % {_BITS} as int)) & 1L) = 1L")


def column_facts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column that has a value: (column_no, table_name, column_name, data_type, is_key, within).

    ``is_key``: no null and no repeated value.  ``within``: bit words of the
    columns, itself included, that hold every value of it.
    """
    cols = indexed_columns(tables)
    spark = next(iter(tables.values())).sparkSession
    names = spark.createDataFrame([(i, t, c, k.simpleString()) for i, t, c, k in cols], _FACTS)
    if not cols:
        return names.select("*", F.lit(False).alias("is_key"), F.array(F.lit(0).cast("long")).alias("within"))
    sets = value_sets(tables)
    members = F.expr(f"filter(sequence(0, {len(cols) - 1}), i -> (shiftright(element_at(holds, cast(i div {_BITS} as int) + 1), i % {_BITS}) & 1L) = 1L)")
    each = sets.select("is_null", "holds", "repeats", F.explode(members).alias("column_no"))
    words = range(-(-len(cols) // _BITS))
    facts = each.groupBy("column_no").agg(
        F.bool_and(~F.col("is_null")).alias("filled"),
        F.bool_or(_set("repeats", "column_no") & ~F.col("is_null")).alias("repeated"),
        *[F.bit_and(F.when(~F.col("is_null"), F.col("holds")[k])).alias(f"b{k}") for k in words]).where("b0 is not null")
    return facts.join(names, "column_no").select(
        "column_no", "table_name", "column_name", "data_type", (F.col("filled") & ~F.col("repeated")).alias("is_key"),
        F.array(*[f"b{k}" for k in words]).alias("within"))


def candidate_keys(facts: DataFrame) -> DataFrame:
    """(table_name, column_name) of the non-null, unique columns."""
    return facts.where("is_key").select("table_name", "column_name")


def foreign_keys(facts: DataFrame) -> DataFrame:
    """(table_name, column_name, ref_table, ref_column): all values of a column are in another table's key."""
    keys = facts.where("is_key").select(F.col("column_no").alias("ref_no"), F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column"))
    holders = F.expr(f"filter(sequence(0, size(within) * {_BITS} - 1), i -> (shiftright(element_at(within, cast(i div {_BITS} as int) + 1), i % {_BITS}) & 1L) = 1L)")
    refs = facts.select("table_name", "column_name", F.explode(holders).alias("ref_no")).join(keys, "ref_no")
    return refs.where("table_name <> ref_table").select("table_name", "column_name", "ref_table", "ref_column")
