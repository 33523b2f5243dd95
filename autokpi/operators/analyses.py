"""Table analyses run on discovered tables.

Each analysis is one aggregate over the table (partial aggregation map-side)
followed by work on the small aggregated result (months, weeks, values).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from autokpi.functions.core import event_time, quoted, round_half_up
from pyspark.sql import types as T


def time_series_sum(df: DataFrame, amount: str, date: str, n: int | None = 24) -> DataFrame:
    """A2: monthly ``SUM(amount)``; the newest ``n`` months (a top-n, not a
    sort of everything), oldest first; null and unparsable dates dropped (D4).  Columns bucket DATE, total.
    Scale: shuffle key = month; partial aggregation leaves one row per month
    per task; one job."""
    when = event_time(df, date)
    g = (df.filter(when.isNotNull())
         .groupBy(F.to_date(F.date_trunc("month", when)).alias("bucket"))
         .agg(F.sum(quoted(amount).try_cast("double")).alias("total")))
    if n is not None:
        g = g.orderBy(F.col("bucket").desc()).limit(n)
    return g.orderBy("bucket")


def count_over_time(df: DataFrame, date: str, n: int | None = 26) -> DataFrame:
    """A3: weekly row count (weeks start Monday), newest ``n`` weeks,
    oldest first.
    Scale: shuffle key = week (partial counts per task); one job."""
    when = event_time(df, date)
    g = (df.filter(when.isNotNull())
         .groupBy(F.to_date(F.date_trunc("week", when)).alias("bucket"))
         .agg(F.count(F.lit(1)).alias("total")))
    if n is not None:
        g = g.orderBy(F.col("bucket").desc()).limit(n)
    return g.orderBy("bucket")


def demographic(df: DataFrame, top: int | None = None, max_cols: int | None = None) -> DataFrame:
    """A4: value counts of text columns.

    For every string column with >= 2 distinct values: the count of each value
    (null is a value).  ``top`` keeps the ``top`` values of a column by count
    (ties: value ascending, null last, D19) and adds their ``rank``;
    ``max_cols`` keeps the first such columns in schema order.  One scan: the
    string columns are unpivoted and counted in one aggregate (partial
    aggregation absorbs hot values).  The cut is a ``row_number <= top``
    filter, planned with a partial WindowGroupLimit before its shuffle.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]
    rank = "" if top is None else ", rank int"
    if not text:
        return df.sparkSession.createDataFrame([], "column_name string, col_ordinal int, bucket string, total bigint" + rank)
    arr = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(c).alias("c"), quoted(c).cast("string").alias("v")) for i, c in enumerate(text)])
    counts = df.select(F.inline(arr)).groupBy("o", "c", "v").agg(F.count(F.lit(1)).alias("total"))
    kept = counts.groupBy("o").agg(F.count(F.lit(1)).alias("n_values")).filter(F.col("n_values") >= 2).select("o")
    if max_cols is not None:
        kept = kept.orderBy("o").limit(max_cols)
    if top is not None:
        w = Window.partitionBy("o").orderBy(F.col("total").desc(), F.col("v").asc_nulls_last())
        counts = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    out = counts.join(F.broadcast(kept), "o")  # at most a row per text column
    cols = [F.col("c").alias("column_name"), (F.col("o") + 1).alias("col_ordinal"), F.col("v").alias("bucket"), "total"]
    return out.select(*cols, *(["rank"] if top is not None else []))


def missing_recent(df: DataFrame, date: str) -> DataFrame:
    """A5: the newest date (text is parsed, so an unparsable one never wins) and
    ``COUNT(*)`` in one aggregate (partial per task, one row to the final
    stage); one job."""
    return df.agg(F.max(event_time(df, date)).alias("last_seen"), F.count(F.lit(1)).alias("total_records"))


def late_accounts(df: DataFrame, key: str, date: str, days: int = 60, as_of=None) -> DataFrame:
    """Accounts with no activity in the last ``days`` before ``as_of``
    (default: newest date in the data), with their usual cadence.

    The table is first reduced to distinct (account, day) pairs (map-side
    partial aggregation), so the gap window per account holds at most one row
    per active day — a hot account costs its number of days, not its rows.
    Columns: key, last_seen, active_days, median_gap_days, days_since.
    """
    when = event_time(df, date)
    ref = F.to_date(df.agg(F.max(when)).scalar()) if as_of is None else F.lit(as_of).cast("date")
    daysdf = df.filter(F.col(key).isNotNull() & when.isNotNull()).select(key, F.to_date(when).alias("__d")).distinct()
    w = Window.partitionBy(key).orderBy("__d")
    gaps = daysdf.withColumn("__gap", F.datediff("__d", F.lag("__d").over(w)))
    per = gaps.groupBy(key).agg(F.max("__d").alias("last_seen"), F.count(F.lit(1)).alias("active_days"),
                                F.median("__gap").alias("median_gap_days"))
    per = per.withColumn("days_since", F.datediff(ref, F.col("last_seen")))
    return per.filter(F.col("days_since") > days)


def value_outliers(df: DataFrame, amount: str, z: float = 2.5, limit: int | None = None,
                   sample: int | None = None, order_col: str | None = None) -> DataFrame:
    """Rows whose z-score of ``amount`` exceeds ``z`` in absolute value.

    Mean and sample std over the whole table (D12; std 0/null -> 1) come from
    one aggregate used as scalar subqueries (evaluated once, no join).  Adds
    ``_z`` plus the statistics ``mean``, ``stddev``, ``outlier_count`` (the
    true count, before any ``limit``).  ``sample``/``order_col`` reproduce the
    original "first N rows by column 1 desc" cut.
    """
    base = df
    if sample is not None:
        base = df.orderBy(F.col(order_col or df.columns[0]).desc()).limit(sample)
    x = quoted(amount).try_cast("double")
    stats = base.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    mean = stats.select("m").scalar()
    sd = stats.select(F.when(F.coalesce(F.col("s"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("s"))).scalar()
    scored = base.withColumn("_z", (x - mean) / sd)
    out = scored.filter(F.abs(F.col("_z")) > z)
    cnt = out.agg(F.count(F.lit(1))).scalar()
    out = out.withColumn("mean", mean).withColumn("stddev", sd).withColumn("outlier_count", cnt)
    if limit is not None:
        out = out.limit(limit)
    return out


def liability_forecast(df: DataFrame, amount: str, date: str, by: list[str] | None = None) -> DataFrame:
    """monthly history + 12-month projection.

    avg = mean of the newest <= 12 months; growth = Σlast12 / Σprev12 − 1 when
    >= 24 months and Σprev12 > 0, else 0; month i of 12: avg·(1+g)^(i/12),
    round 2.  Returns the newest 24 history months and the 12 forecast months
    (``kind`` history/forecast) with ``growth_yoy``.  Windows run over the
    monthly aggregate (one row per month and series).
    """
    by = by or []
    when = event_time(df, date)
    m = (df.filter(when.isNotNull())
         .groupBy(*by, F.to_date(F.date_trunc("month", when)).alias("bucket"))
         .agg(F.coalesce(F.sum(quoted(amount).try_cast("double")), F.lit(0.0)).alias("total")))
    w = Window.partitionBy(*by).orderBy(F.col("bucket").desc()) if by else Window.orderBy(F.col("bucket").desc())
    m = m.withColumn("__rn", F.row_number().over(w))
    g = m.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"),
        F.avg(F.when(F.col("__rn") <= 12, F.col("total"))).alias("__avg"),
        F.sum(F.when(F.col("__rn") <= 12, F.col("total"))).alias("__s1"),
        F.sum(F.when((F.col("__rn") > 12) & (F.col("__rn") <= 24), F.col("total"))).alias("__s2"),
        F.max("bucket").alias("__last"))
    growth = F.when((F.col("__n") >= 24) & (F.col("__s2") > 0), F.col("__s1") / F.col("__s2") - 1).otherwise(F.lit(0.0))
    g = g.withColumn("growth_yoy", growth)
    fc = g.select(*by, "growth_yoy", "__avg", "__last", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("__i"))
    fc = fc.select(*by, F.lit("forecast").alias("kind"), F.add_months("__last", F.col("__i")).alias("bucket"),
                   round_half_up(F.col("__avg") * F.pow(1 + F.col("growth_yoy"), F.col("__i") / 12.0), 2).alias("total"),
                   "growth_yoy")
    hist = m.filter(F.col("__rn") <= 24).join(g.select(*by, "growth_yoy"), by, "inner") if by else \
        m.filter(F.col("__rn") <= 24).withColumn("growth_yoy", g.select("growth_yoy").scalar())
    hist = hist.select(*by, F.lit("history").alias("kind"), "bucket", "total", "growth_yoy")
    return hist.unionByName(fc)
