"""KPI metrics, anomalies and newest-per-key reads.

W1 runs on the daily-aggregated frame (KPIs x days), never on raw rows: the
raw frame is reduced by a partial+final ``sum`` on (kpi_name, day) first, so a
hot KPI costs one partial row per input partition.  The windows then shuffle
once by ``kpi_name``; the (kpi_name, weekday) windows reuse that partitioning
(hash(kpi_name) satisfies clustering on (kpi_name, weekday)).  Largest window
group: the number of days of one KPI.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autokpi.functions.core import fmt2, round_half_up


def daily_frame(frame: DataFrame, key: str = "kpi_name") -> DataFrame:
    """One row per (key, day): ``sum(value)``; ``date`` becomes a DATE."""
    return (frame.filter(F.col("date").isNotNull() & F.col("value").isNotNull() & F.col(key).isNotNull())
            .groupBy(key, F.to_date("date").alias("date"))
            .agg(F.sum("value").alias("value")))


def _shifted_std(frame_window) -> Column:
    """Sample std over a window frame from sums of ``__d`` = value minus the
    series' first value.  Exact for integer-valued data (so a z-score that is
    exactly on a threshold stays on it, as with a two-pass std) and free of
    the cancellation of raw sums of squares otherwise.  Null below 2 rows."""
    n = F.count(F.col("__d")).over(frame_window)
    s1 = F.sum(F.col("__d")).over(frame_window)
    s2 = F.sum(F.col("__d") * F.col("__d")).over(frame_window)
    var = (s2 - s1 * s1 / n) / (n - 1)
    return F.when(n >= 2, F.sqrt(F.greatest(var, F.lit(0.0))))


def _z_status(z: Column, critical: float, warning: float) -> Column:
    return (F.when(z > critical, "CRITICAL").when(z > warning, "WARNING").otherwise("NORMAL"))


def kpi_metrics(frame: DataFrame, latest_only: bool = True, daily: bool = True,
                critical_z: float = 2.5, warning_z: float = 1.5,
                min_weekday_rows: int = 4, keys: list[str] | None = None) -> DataFrame:
    """Day-over-day, week-over-week, 7-row average, weekday-aware z-score.

    Per KPI ordered by date (then ``source_row_id`` when ``daily=False``);
    *today* = a row, *history* = the rows before it.  ``dod`` vs the previous
    row, ``wow`` vs the row 7 back else the first row (0 when the base is 0),
    ``avg_7d`` = mean of the last <=7 history rows.  Baseline = mean / sample
    std of same-weekday history rows when there are >= ``min_weekday_rows`` of
    them, else of all history; ``z`` = |today - mean| / std (0 when std is 0 or
    null).  ``latest_only`` keeps the newest row of each KPI with >= 2 rows.

    ``keys`` (default ``["kpi_name"]``) names the series, e.g. per tenant
    ``["department_id", "kpi_name"]``.

    Columns: keys, recorded_at, value, dod_pct, wow_pct, avg_7d, z_score,
    baseline_mean, baseline, status (numbers rounded to 2).
    """
    keys = keys or ["kpi_name"]
    ok = F.col("date").isNotNull() & F.col("value").isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    if daily:
        base = (frame.filter(ok).groupBy(*keys, F.to_date("date").alias("date"))
                .agg(F.sum("value").alias("value")).withColumn("__tie", F.lit(0)))
    else:
        base = frame.filter(ok).select(*keys, "date", "value", F.col("source_row_id").alias("__tie"))
    base = base.withColumn("__wd", F.weekday("date"))
    w = Window.partitionBy(*keys).orderBy("date", "__tie")
    hist = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    wd = Window.partitionBy(*keys, "__wd").orderBy("date", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    v = F.col("value")
    m = (base
         .withColumn("__rn", F.row_number().over(w))
         .withColumn("__n", F.count(F.lit(1)).over(whole))
         .withColumn("__prev", F.lag(v, 1).over(w))
         .withColumn("__lag7", F.lag(v, 7).over(w))
         .withColumn("__first", F.first(v).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
         .withColumn("__d", v - F.col("__first"))
         .withColumn("__avg7", F.avg(v).over(w.rowsBetween(-7, -1)))
         .withColumn("__mean_all", F.avg(v).over(hist))
         .withColumn("__std_all", _shifted_std(hist))
         .withColumn("__cnt_wd", F.count(v).over(wd))
         .withColumn("__mean_wd", F.avg(v).over(wd))
         .withColumn("__std_wd", _shifted_std(wd)))
    m = m.filter(F.col("__rn") >= 2)
    if latest_only:
        m = m.filter(F.col("__rn") == F.col("__n"))
    use_wd = F.col("__cnt_wd") >= min_weekday_rows
    mean = F.when(use_wd, F.col("__mean_wd")).otherwise(F.col("__mean_all"))
    std = F.when(use_wd, F.col("__std_wd")).otherwise(F.col("__std_all"))
    z = F.when(std > 0, F.abs(v - mean) / std).otherwise(F.lit(0.0))
    prev, wbase = F.col("__prev"), F.coalesce(F.col("__lag7"), F.col("__first"))
    dod = F.when(prev != 0, (v - prev) / prev * 100).otherwise(F.lit(0.0))
    wow = F.when(wbase != 0, (v - wbase) / wbase * 100).otherwise(F.lit(0.0))
    out = m.select(
        *keys,
        F.to_date("date").alias("recorded_at"),
        round_half_up(v, 2).alias("value"),
        round_half_up(dod, 2).alias("dod_pct"),
        round_half_up(wow, 2).alias("wow_pct"),
        round_half_up(F.col("__avg7"), 2).alias("avg_7d"),
        round_half_up(z, 2).alias("z_score"),
        round_half_up(mean, 2).alias("baseline_mean"),
        F.when(use_wd, F.lit("same_weekday")).otherwise(F.lit("all_history")).alias("baseline"),
        _z_status(z, critical_z, warning_z).alias("status"),
    )
    return out


def anomalies(metrics: DataFrame) -> DataFrame:
    """Non-NORMAL rows of W1 as anomaly records.

    Columns: kpi_name, recorded_at, severity, deviation, baseline, reason.
    The reason text says which baseline was used (D22).  Narrow: no shuffle.
    """
    base_txt = F.when(F.col("baseline") == "same_weekday", F.lit("same-weekday average")) \
        .otherwise(F.lit("historical average"))
    val, mean = fmt2(F.col("value")), fmt2(F.col("baseline_mean"))
    reason = F.when(
        F.col("status") == "CRITICAL",
        F.concat(F.lit("Value "), val, F.lit(" is exceptionally far from the "), base_txt, F.lit(" of "), mean),
    ).otherwise(
        F.concat(F.lit("Value "), val, F.lit(" is notable compared to the "), base_txt, F.lit(" of "), mean))
    keys = [c for c in metrics.columns if c in ("department_id", "user_id")]
    return (metrics.filter(F.col("status") != "NORMAL")
            .select(*keys, "kpi_name", "recorded_at", F.col("status").alias("severity"),
                    F.col("z_score").alias("deviation"), "baseline", reason.alias("reason")))


def latest_per(df: DataFrame, keys: list[str], order: list[str], mark_within: tuple[list[str], int] | None = None) -> DataFrame:
    """Newest row per ``keys`` by ``order`` (descending).

    ``max_by`` over a struct of the order columns with partial aggregation, so a
    hot key is pre-reduced before the shuffle.  ``mark_within=(tenant_cols, n)``
    adds ``within_newest``: whether the row is among its tenant's newest ``n``
    rows (ties: the greatest key), found by a per-tenant ``row_number <= n`` that
    is cut before its shuffle.  No key is left out.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in rest])
    ordkey = F.struct(*[F.col(c) for c in order])
    agg = df.groupBy(*keys).agg(F.max_by(packed, ordkey).alias("__row"))
    latest = agg.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])
    if mark_within is None:
        return latest
    tenant, n = mark_within
    by = list(dict.fromkeys([*order, *keys]))
    w = Window.partitionBy(*tenant).orderBy(*[F.col(c).desc() for c in by])
    newest = df.select(*dict.fromkeys([*tenant, *by])).withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
    marks = newest.select(*[F.col(c).alias(f"__{c}") for c in by], F.lit(True).alias("within_newest")).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return latest.join(marks, same, "left").select(*latest.columns, F.coalesce("within_newest", F.lit(False)).alias("within_newest"))
