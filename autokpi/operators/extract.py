"""Metric extraction (A1, U1) and the as-of helper.

A1 is the in-Spark equivalent of the per-table ``SUM(amount) GROUP BY day``
the reference pushes into the source database.  Shuffle key: the day (and the
label); partial aggregation runs map-side, so a hot day costs one partial row
per input partition, not its rows.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autokpi.functions.core import event_time, ntz_literal, quoted


def as_of_column(df: DataFrame, ts: str, as_of=None) -> Column:
    """The reference instant as a column.

    A literal ``as_of`` stays a literal (pushed to the scan).  ``None`` means
    the newest value of ``ts`` in the data: a scalar subquery (one partial +
    final ``max``, evaluated once, then used as a constant).
    """
    if as_of is None:
        return df.agg(F.max(ts)).scalar()
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    return ntz_literal(as_of)


def daily_totals(df: DataFrame, amount: str, date: str, label: str,
                 days: int | None = 30, as_of=None) -> DataFrame:
    """A1: ``SUM(amount)`` per day over the trailing ``days`` (strictly after
    ``as_of - days``); columns ``date`` DATE, ``kpi_name``, ``value`` DOUBLE.
    ``days=None`` keeps the whole history.  Null dates are dropped (D4).
    """
    src = df.select(event_time(df, date).alias("__d"), quoted(amount).try_cast("double").alias("__v"))
    src = src.filter(F.col("__d").isNotNull())
    if days is not None:
        ref = as_of_column(src, "__d", as_of)
        src = src.filter(F.col("__d") > ref - F.expr(f"INTERVAL {int(days)} DAYS"))
    return (src.groupBy(F.to_date("__d").alias("date"))
            .agg(F.sum("__v").alias("value"))
            .select("date", F.lit(label).alias("kpi_name"), "value"))


def union_frames(frames: list[DataFrame]) -> DataFrame:
    """Union all by name, missing columns filled with null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
