"""7-day KPI forecast (F3), forecast widening (W7), history ∪ forecast.

F3 replaces the reference's Prophet model with a closed form that keeps its
interface and intent (weekly seasonality, 80 % band, 7 daily rows after the
last date, KPIs with >= 10 rows) — the numbers are not Prophet's:

* linear trend ``a + b·t`` by least squares on t = days since the KPI's first
  date (``regr_slope`` / ``regr_intercept``; a null slope counts as 0),
* weekday effect = mean residual per (KPI, weekday),
* band = ± z·std of the residuals left after the weekday effect
  (z = 1.2816 for 80 %).

Everything is window / grouped aggregates over the daily frame (KPIs × days)
and an ``explode(sequence(1, 7))``; no Python in executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from autokpi.functions.core import round_half_up
from autokpi.operators.kpi import daily_frame

Z80 = 1.2816


def forecast(frame: DataFrame, horizon: int = 7, min_rows: int = 10, z: float = Z80, daily: bool = True) -> DataFrame:
    """columns kpi_name, forecast_date, predicted_value, lower_bound, upper_bound.

    Plan: the daily frame is shuffled once by ``kpi_name``; the fit
    (``regr_slope``, means), residuals, weekday effects (window on
    (kpi_name, weekday) — same partitioning, Sort only) and the residual std
    are window / grouped aggregates on that partitioning; the per-KPI weekday
    effects travel as a 7-entry map, so the 7 forecast rows need no join.
    """
    d = daily_frame(frame) if daily else frame.select("kpi_name", F.to_date("date").alias("date"), "value")
    w = Window.partitionBy("kpi_name")
    d = (d.withColumn("__n", F.count(F.lit(1)).over(w))
         .withColumn("__d0", F.min("date").over(w))
         .withColumn("__last", F.max("date").over(w))
         .filter(F.col("__n") >= min_rows)
         .withColumn("__t", F.datediff("date", "__d0").cast("double"))
         .withColumn("__wd", F.weekday("date")))
    # a null slope (a constant day number cannot occur with >= 2 days, but
    # keep the rule) counts as 0; the intercept then is the mean
    d = (d.withColumn("__b", F.coalesce(F.regr_slope("value", "__t").over(w), F.lit(0.0)))
         .withColumn("__a", F.avg("value").over(w) - F.col("__b") * F.avg("__t").over(w))
         .withColumn("__res", F.col("value") - (F.col("__a") + F.col("__b") * F.col("__t")))
         .withColumn("__eff", F.avg("__res").over(Window.partitionBy("kpi_name", "__wd"))))
    fit = d.groupBy("kpi_name").agg(
        F.first("__d0").alias("__d0"), F.first("__last").alias("__last"), F.first("__a").alias("__a"),
        F.first("__b").alias("__b"),
        F.coalesce(F.stddev_samp(F.col("__res") - F.col("__eff")), F.lit(0.0)).alias("__sd"),
        F.map_from_entries(F.collect_set(F.struct("__wd", "__eff"))).alias("__effs"))
    steps = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("__h")) \
        .withColumn("forecast_date", F.date_add("__last", F.col("__h")))
    t = F.datediff("forecast_date", "__d0").cast("double")
    eff = F.coalesce(F.element_at(F.col("__effs"), F.weekday("forecast_date")), F.lit(0.0))
    yhat = F.col("__a") + F.col("__b") * t + eff
    return steps.select("kpi_name", "forecast_date",
                        round_half_up(yhat, 2).alias("predicted_value"),
                        round_half_up(yhat - z * F.col("__sd"), 2).alias("lower_bound"),
                        round_half_up(yhat + z * F.col("__sd"), 2).alias("upper_bound"))


def forecast_wide(fc: DataFrame, kpi_names: list[str] | None = None) -> DataFrame:
    """One row per forecast date with ``<kpi>``, ``<kpi>_lower``,
    ``<kpi>_upper`` columns (pivot with an explicit value list)."""
    if kpi_names is None:
        kpi_names = sorted(r[0] for r in fc.select("kpi_name").distinct().collect())
    aggs = []
    for k in kpi_names:
        hit = F.col("kpi_name") == k
        aggs += [F.max(F.when(hit, F.col("predicted_value"))).alias(k),
                 F.max(F.when(hit, F.col("lower_bound"))).alias(f"{k}_lower"),
                 F.max(F.when(hit, F.col("upper_bound"))).alias(f"{k}_upper")]
    return fc.groupBy(F.col("forecast_date").alias("date")).agg(*aggs)


def forecast_maps(fc: DataFrame) -> DataFrame:
    """W7 with the KPI names as data: one row per forecast date with ``kpis``, a MAP<kpi, (value, lower, upper)>."""
    entry = F.struct("kpi_name", F.struct(F.col("predicted_value").alias("value"), F.col("lower_bound").alias("lower"), F.col("upper_bound").alias("upper")))
    return fc.groupBy(F.col("forecast_date").alias("date")).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("kpis"))


def history_and_forecast(history: DataFrame, fc: DataFrame) -> DataFrame:
    """One series: history rows (date, kpi_name, value) and forecast rows
    (date, kpi_name, predicted_value, lower_bound, upper_bound)."""
    h = history.select(F.to_date("date").alias("date"), "kpi_name", "value").withColumn("kind", F.lit("history"))
    f = fc.select(F.col("forecast_date").alias("date"), "kpi_name", "predicted_value", "lower_bound",
                  "upper_bound").withColumn("kind", F.lit("forecast"))
    return h.unionByName(f, allowMissingColumns=True)
