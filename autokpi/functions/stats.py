"""Exact order statistics by distributed rank selection.

``median`` / ``mode`` aggregates keep every value (or value count) of a group
in one buffer, and a running sum over a group's sorted values puts the group in
one task; both fail on a hot group.  Here the distinct values are counted first
(partial aggregation absorbs repeats) and range-partitioned by group and value,
so one group spreads over as many tasks as it needs.  The partitions' totals, a
row each, say which partition holds the wanted rank; only that one is read
again, sorted and summed up.  Results equal ``percentile_cont`` (linear
interpolation) and ``mode`` with ties to the smallest value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autokpi.session import ensure_checkpoint_dir


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float], out: str = "quantiles") -> DataFrame:
    """Per ``keys`` (null is a key): array of the exact quantiles of non-null ``value``, in the order given.

    Groups without a value give no row; without keys there is always one, null if
    there is no value.  The counted values are kept in a
    checkpoint, so partition numbers mean the same in both readings.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    names = [f"__k{i}" for i in range(len(keys))]
    renamed = df.filter(F.col(value).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("double").alias("__v"))
    counts = renamed.groupBy(*names, "__v").agg(F.count(F.lit(1)).alias("__c"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.repartitionByRange(parts, *names, "__v").checkpoint(eager=True).withColumn("__p", F.spark_partition_id())

    totals = ranged.groupBy(*names, "__p").agg(F.sum("__c").alias("__t"))
    groups = totals.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("__p", "__t"))).alias("__parts"), F.sum("__t").alias("__n"))
    wanted = F.array(*[F.struct(F.lit(i).alias("__q"), ((F.col("__n") - 1) * F.lit(float(p))).alias("__pos")) for i, p in enumerate(probabilities)])
    ranks = groups.select(*names, "__parts", F.inline(wanted)).select(
        *names, "__parts", "__q", "__pos", F.explode(F.array_distinct(F.array(F.floor("__pos"), F.ceil("__pos")))).alias("__rank"))
    place = F.expr("""aggregate(__parts, named_struct('seen', 0L, 'p', -1, 'before', 0L),
        (s, x) -> if(s.p >= 0 or s.seen + x.__t <= __rank, named_struct('seen', s.seen + x.__t, 'p', s.p, 'before', s.before),
                     named_struct('seen', s.seen + x.__t, 'p', x.__p, 'before', s.seen)))""")
    ranks = ranks.withColumn("__at", place).select(
        *names, "__q", "__pos", "__rank", F.col("__at.p").alias("__p"), (F.col("__rank") - F.col("__at.before")).alias("__within"))

    def meets(a: DataFrame, b: DataFrame) -> Column:
        same = a["__p"] == b["__p"]
        for n in names:
            same = same & a[n].eqNullSafe(b[n])
        return same

    middle = ranks.select(*names, "__p").distinct().alias("t")
    held = ranged.alias("r").join(middle, meets(_of("r"), _of("t")), "left_semi")
    run = Window.partitionBy(*names, "__p").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("__cum", F.sum("__c").over(run)).alias("h")
    inside = meets(_of("h"), _of("k")) & (F.col("h.__cum") > F.col("k.__within")) & (F.col("h.__cum") - F.col("h.__c") <= F.col("k.__within"))
    found = ranks.alias("k").join(held, inside).select(*[F.col(f"k.{n}").alias(n) for n in names], "k.__q", "k.__pos", "k.__rank", "h.__v")
    each = found.groupBy(*names, "__q").agg(F.max("__pos").alias("__pos"), F.min_by("__v", "__rank").alias("__lo"), F.max_by("__v", "__rank").alias("__hi"))
    lo, hi = F.floor("__pos"), F.ceil("__pos")
    exact = F.when(lo == hi, F.col("__lo")).otherwise((hi - F.col("__pos")) * F.col("__lo") + (F.col("__pos") - lo) * F.col("__hi"))
    result = each.groupBy(*names).agg(F.transform(F.sort_array(F.collect_list(F.struct("__q", exact.alias("x")))), lambda s: s["x"]).alias(out))
    return result.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], out)


def _of(alias: str):
    """Columns of an aliased frame by subscript."""
    class Columns:
        def __getitem__(self, name: str) -> Column:
            return F.col(f"{alias}.{name}")
    return Columns()


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """Per ``keys``: the exact median of non-null ``value`` (mean of the two middle values for an even count)."""
    q = exact_quantiles(df, keys, value, [0.5], out)
    return q.select(*keys, F.get(F.col(out), 0).alias(out))


def mode_by(df: DataFrame, keys: list[str], value: str, out: str = "mode") -> DataFrame:
    """Per ``keys``: the most frequent non-null ``value`` (ties: smallest).
    Value counts, then the best count per group, both with partial aggregation: a task ships one row per group."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    return c.groupBy(*keys).agg(F.min_by("__v", F.struct(-F.col("__c"), F.col("__v"))).alias(out))
