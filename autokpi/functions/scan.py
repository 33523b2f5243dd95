"""Scans along an order that do not put a whole key into one task.

A window over a key holds all rows of the key in one task; a key with a third
of all rows stays there however many machines there are.  Here the order is
cut into *chunks* at a few splitters, so a window holds one key's rows of one
chunk, and the last state of each (key, chunk), a row each, is carried to the
key's next chunk.  Any splitters give the same result; approximate quantiles
of the whole table make the chunks even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNKS = 64
_SPLIT = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _sortable(df: DataFrame, name: str) -> Column | None:
    """A number that follows the column's order, or None where there is none."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.col(name).cast("timestamp").cast("double")
    return F.col(name).cast("double") if isinstance(kind, T.NumericType) else None


def chunk_of(df: DataFrame, name: str, chunks: int = CHUNKS) -> Column:
    """The number of the chunk of ``name`` that a row falls into, rising with ``name`` (null first).

    One aggregate of the column gives the splitters.  A column without numbers
    for its order (text) is one chunk.
    """
    x = _sortable(df, name)
    if x is None or chunks < 2:
        return F.lit(0)
    at = [k / chunks for k in range(1, chunks)]
    cuts = df.agg(F.percentile_approx(x, at, 10 * chunks).alias("cuts")).first()["cuts"] or []
    cuts = sorted({c for c in cuts if c is not None and c == c})
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < x)), F.lit(-1))


def with_previous(df: DataFrame, keys: list[str], order: list[str], col: str, previous: str, first: str, chunks: int = CHUNKS) -> DataFrame:
    """Add ``previous``, the value of ``col`` in the row before (by ``order``, within ``keys``), and ``first``, whether there is none.

    Null keys are a key.  Rows that ``order`` does not tell apart follow in any order.
    """
    cut = df.withColumn("__chunk", chunk_of(df, order[0], chunks))
    along = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    inside = cut.withColumn("__rn", F.row_number().over(along)).withColumn("__lag", F.lag(F.col(col)).over(along))
    back = Window.partitionBy(*keys, "__chunk").orderBy(*[F.col(c).desc() for c in order])
    ends = cut.select(*keys, "__chunk", F.col(col).alias("__v"), F.row_number().over(back).alias("__at")).filter("__at = 1")
    carried = Window.partitionBy(*keys).orderBy("__chunk")  # a row per key and chunk
    carry = ends.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__chunk").alias("__of"),
                        F.lag("__v").over(carried).alias("__carry"), (F.row_number().over(carried) == 1).alias("__begins"))
    same = (F.col("__rn") == 1) & (F.col("__chunk") == F.col("__of"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    joined = inside.join(carry, same, "left")
    start = F.col("__rn") == 1
    return joined.select(*df.columns, F.when(start, F.col("__carry")).otherwise(F.col("__lag")).alias(previous),
                         (start & F.coalesce("__begins", F.lit(True))).alias(first))
