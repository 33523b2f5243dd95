"""Proactive insights over the KPI frame.

All insight operators return rows ``(type, kpi, severity, title, explanation,
value)``.  They run on the daily-aggregated frame (KPIs × days), so their
windows are bounded by the number of days and KPIs, not rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autokpi.functions.core import ntz_literal, round_half_up, title_label
from autokpi.operators.kpi import daily_frame

INSIGHT_COLUMNS = ["type", "kpi", "severity", "title", "explanation", "value"]


def _fmt1(c: Column) -> Column:
    return F.format_string("%.1f", round_half_up(c, 1))


def trend_shift(frame: DataFrame, min_rows: int = 7, report: float = 0.15, warn: float = 0.30,
                report_only: bool = True, daily: bool = True) -> DataFrame:
    """mean of the first ⌊n/2⌋ values vs the rest, per KPI with >= 7 values
    and a positive first mean; reported when |change| > 0.15, a warning above
    0.30; value rounded to 4.  Shuffle key: kpi_name (days per KPI)."""
    d = daily_frame(frame) if daily else frame.select("kpi_name", "date", "value")
    w = Window.partitionBy("kpi_name").orderBy("date")
    d = d.withColumn("__rn", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("kpi_name")))
    half = F.floor(F.col("__n") / 2)
    g = d.groupBy("kpi_name").agg(
        F.max("__n").alias("n"),
        F.avg(F.when(F.col("__rn") <= half, F.col("value"))).alias("m1"),
        F.avg(F.when(F.col("__rn") > half, F.col("value"))).alias("m2"))
    g = g.filter((F.col("n") >= min_rows) & (F.col("m1") > 0))
    change = (F.col("m2") - F.col("m1")) / F.col("m1")
    g = g.withColumn("__c", change)
    if report_only:
        g = g.filter(F.abs("__c") > report)
    big = F.abs(F.col("__c")) > warn
    direction = F.when(F.col("__c") > 0, F.lit("upward")).otherwise(F.lit("downward"))
    expl = F.concat(F.lit("The second half of the observed period shows a "), _fmt1(F.abs(F.col("__c")) * 100),
                    F.lit("% "), direction, F.lit(" trend compared to the first half. "),
                    F.when(big, F.lit("This may indicate a structural change worth investigating."))
                    .otherwise(F.lit("Monitor closely.")))
    return g.select(F.lit("trend_shift").alias("type"), F.col("kpi_name").alias("kpi"),
                    F.when(big, "warning").otherwise("info").alias("severity"),
                    F.concat(F.lit("Trend shift detected in "), title_label("kpi_name")).alias("title"),
                    expl.alias("explanation"), round_half_up("__c", 4).alias("value"))


#: KPIs of a block, and days of a step after which pairs that cannot reach the threshold are left.
BLOCK_KPIS, STEP_DAYS = 512, 64


def _complete_days(frame: DataFrame) -> DataFrame:
    """Daily sums on the days on which every KPI has a value."""
    d = daily_frame(frame).filter(F.col("value").isNotNull())
    kpis = daily_frame(frame).agg(F.count_distinct("kpi_name")).scalar()
    full = d.groupBy("date").agg(F.count(F.lit(1)).alias("__k")).filter(F.col("__k") == kpis).select("date")
    return d.join(full, "date", "left_semi").select("kpi_name", "date", "value")


def _correlated_pairs(threshold: float | None, step: int):
    """A function for one pair of blocks: the pairs of KPIs whose |r| exceeds the threshold (None: all of them).

    A block is a matrix of unit rows (each KPI's values less their mean, divided by their norm), so r is a
    product of rows.  The product is built ``step`` days at a time; by the Cauchy-Schwarz bound on what is
    left of two rows, rows without a pair that may still pass are left out of the next step.
    """
    def pairs(left, right):
        import numpy as np
        import pyarrow as pa

        def block(table):
            names = [n for part in table.column("names").to_pylist() for n in part]
            rows = [np.frombuffer(x, dtype="<f8") for part in table.column("series").to_pylist() for x in part]
            return np.array(names, dtype=object), np.vstack(rows) if rows else np.zeros((0, 0))

        names_a, a = block(left)
        names_b, b = block(right)
        found = []
        if len(a) and len(b):
            live_a, live_b = np.arange(len(a)), np.arange(len(b))
            r = np.zeros((len(a), len(b)))
            rest_a, rest_b = (np.cumsum((m ** 2)[:, ::-1], axis=1)[:, ::-1] for m in (a, b))
            for at in range(0, a.shape[1], step):
                r += a[live_a, at:at + step] @ b[live_b, at:at + step].T
                if threshold is not None and at + step < a.shape[1]:
                    bound = np.abs(r) + np.sqrt(rest_a[live_a, at + step])[:, None] * np.sqrt(rest_b[live_b, at + step])[None, :]
                    may = bound > threshold - 1e-9
                    keep_a, keep_b = may.any(axis=1), may.any(axis=0)
                    r = r[keep_a][:, keep_b]
                    live_a, live_b = live_a[keep_a], live_b[keep_b]
            hit = np.argwhere(np.abs(r) > threshold) if threshold is not None else np.argwhere(np.ones(r.shape, dtype=bool))
            for i, j in hit.tolist():
                x, y = names_a[live_a[i]], names_b[live_b[j]]
                if left.column("block")[0].as_py() != right.column("block")[0].as_py() or x < y:
                    found.append((*sorted((x, y)), float(r[i, j])))
        columns = list(zip(*found)) or [[], [], []]
        return pa.table({"k1": pa.array(columns[0], pa.string()), "k2": pa.array(columns[1], pa.string()), "r": pa.array(columns[2], pa.float64())})
    return pairs


def kpi_correlation(frame: DataFrame, min_dates: int = 5, threshold: float = 0.75, report_only: bool = True,
                    block_kpis: int = BLOCK_KPIS, step_days: int = STEP_DAYS) -> DataFrame:
    """Pearson r between every pair of KPIs over the dates where every KPI
    has a value (>= ``min_dates`` such dates); reported when |r| > 0.75.

    A blocked Gram matrix: each KPI's daily sums become one unit row (its days
    in order), rows are dealt to blocks of about ``block_kpis`` by a hash of the
    name, and each pair of blocks is multiplied in a task of its own, which
    gives only the pairs above the threshold (all of them without
    ``report_only``).  Names never meet on the driver and there is no column per
    KPI; the number of KPIs, which fixes the number of blocks, is all that is
    read.  A block row is sent to every pair of blocks that it is part of:
    (KPIs / block_kpis) copies.  A constant series has no r and is skipped (D15).
    """
    d = _complete_days(frame)
    stats = Window.partitionBy("kpi_name")
    c = d.withColumn("__d", F.col("value") - F.avg("value").over(stats))
    series = c.groupBy("kpi_name").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("date", F.col("__d").alias("x")))), lambda s: s["x"]).alias("x"),
        (F.min("value") < F.max("value")).alias("varies"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    series = series.withColumn("n", norm).filter((F.size("x") >= min_dates) & F.col("varies") & (F.col("n") > 0))
    names = daily_frame(frame).agg(F.count_distinct("kpi_name")).first()[0]
    blocks = max(1, -(-names // block_kpis))
    unit = series.select("kpi_name", F.expr(f"cast(pmod(xxhash64(kpi_name), {blocks}) as int)").alias("block"),
                         F.transform("x", lambda v: v / F.col("n")).alias("unit"))
    packed = unit.groupBy("block").applyInArrow(_packed_rows(), "block int, names array<string>, series array<binary>")

    def sides(first: bool) -> DataFrame:
        others = F.sequence(F.col("block"), F.lit(blocks - 1)) if first else F.sequence(F.lit(0), F.col("block"))
        low, high = ("block", "other") if first else ("other", "block")
        return packed.select("block", "names", "series", F.explode(others).alias("other")).select(
            F.col(low).alias("low"), F.col(high).alias("high"), *[F.col(c).alias(c) for c in ("block", "names", "series")])

    work = _correlated_pairs(threshold if report_only else None, step_days)
    long = sides(True).groupBy("low", "high").cogroup(sides(False).groupBy("low", "high")).applyInArrow(work, "k1 string, k2 string, r double")
    expl = F.concat(F.lit("These two metrics move together with a correlation of "),
                    F.format_string("%.2f", round_half_up("r", 2)), F.lit(". "),
                    F.when(F.col("r") > 0, F.lit("They likely share a common driver."))
                    .otherwise(F.lit("They move inversely — a rise in one predicts a fall in the other.")))
    return long.select(F.lit("correlation").alias("type"), F.concat_ws(" ↔ ", "k1", "k2").alias("kpi"),
                       F.lit("info").alias("severity"),
                       F.concat(F.lit("Strong correlation: "), title_label("k1"), F.lit(" & "), title_label("k2"))
                       .alias("title"), expl.alias("explanation"), round_half_up("r", 3).alias("value"))


def _packed_rows():
    """A function that packs the KPIs of a block: their names, and their unit rows as bytes."""
    def pack(table):
        import numpy as np
        import pyarrow as pa

        names = table.column("kpi_name").to_pylist()
        rows = [np.array(x, dtype="<f8").tobytes() for x in table.column("unit").to_pylist()]
        return pa.table({"block": table.column("block").slice(0, 1), "names": pa.array([names], pa.list_(pa.string())),
                         "series": pa.array([rows], pa.list_(pa.binary()))})
    return pack


def concentration(frame: DataFrame, account: str = "customer_id", top: int = 5, threshold: float = 0.5,
                  report_only: bool = True) -> DataFrame:
    """share of total value held by the ``top`` accounts; reported when
    the total is positive and the share > 0.5; value rounded to 3.

    Per-account sums (partial aggregation absorbs a hot account), a top-5
    TakeOrdered, and the grand total as a scalar subquery.
    """
    per = frame.groupBy(account).agg(F.sum("value").alias("__v"))
    top5 = per.orderBy(F.col("__v").desc()).limit(top).agg(F.sum("__v").alias("__top"))
    total = frame.agg(F.sum("value")).scalar()
    s = top5.select(F.col("__top"), total.alias("__total"))
    s = s.filter(F.col("__total") > 0).withColumn("__share", F.col("__top") / F.col("__total"))
    if report_only:
        s = s.filter(F.col("__share") > threshold)
    expl = F.concat(F.lit("Top 5 accounts represent "), _fmt1(F.col("__share") * 100),
                    F.lit("% of total value. This concentration creates dependency risk — losing one key account "
                          "would have outsized impact."))
    return s.select(F.lit("concentration_risk").alias("type"), F.lit("revenue_concentration").alias("kpi"),
                    F.lit("warning").alias("severity"), F.lit("High revenue concentration risk").alias("title"),
                    expl.alias("explanation"), round_half_up("__share", 3).alias("value"))


def freshness(frame: DataFrame, as_of, info_days: int = 3, warn_days: int = 7, report_only: bool = True) -> DataFrame:
    """whole days from the newest ``date`` to ``as_of``; > 3 info, > 7 warning."""
    latest = frame.agg(F.max("date").alias("__latest"))
    ref = as_of if isinstance(as_of, Column) else ntz_literal(as_of)
    # wall-clock seconds between two zone-free timestamps, floored to days
    secs = F.timestamp_diff("SECOND", F.col("__latest").cast("timestamp_ntz"), ref.cast("timestamp_ntz"))
    s = latest.withColumn("__days", F.floor(secs / 86400).cast("bigint"))
    if report_only:
        s = s.filter(F.col("__days") > info_days)
    warn = F.col("__days") > warn_days
    expl = F.concat(F.lit("The most recent data point is from "), F.date_format("__latest", "yyyy-MM-dd"),
                    F.lit(". "), F.when(warn, F.lit("Consider triggering a sync to get current data."))
                    .otherwise(F.lit("Data is slightly stale.")))
    return s.select(F.lit("data_freshness").alias("type"), F.lit("data_age").alias("kpi"),
                    F.when(warn, "warning").otherwise("info").alias("severity"),
                    F.concat(F.lit("Data is "), F.col("__days").cast("string"), F.lit(" days old")).alias("title"),
                    expl.alias("explanation"), F.col("__days").cast("double").alias("value"))


def insights(frame: DataFrame, as_of, account: str = "customer_id") -> DataFrame:
    """F8: all insights (trend shifts, correlations, concentration, freshness)
    as one table with an ``ordinal`` giving the reference's order."""
    parts = [trend_shift(frame), kpi_correlation(frame), concentration(frame, account), freshness(frame, as_of)]
    parts = [p.withColumn("ordinal", F.lit(i + 1)) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, parts)
