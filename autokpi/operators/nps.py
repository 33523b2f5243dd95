"""Feedback / NPS analytics.

Feedback rows: id, customer_id, score 0-10, channel, submitted_at DATE,
feedback_text; customers carry the segment.  Every aggregate is one
conditional aggregation (partial aggregation map-side); the customer join is
a shuffle join on customer_id (customers grow with the data, so no blind
broadcast — AQE turns it into a broadcast when the runtime size allows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autokpi.functions.core import round_half_up
from autokpi.functions.stats import exact_median


def _nps_aggs(score: Column, digits: int | None) -> list[Column]:
    n = F.count(score)
    prom = F.sum(F.when(score >= 9, 1).otherwise(0))
    det = F.sum(F.when(score <= 6, 1).otherwise(0))
    val = (prom * 100.0 / n) - (det * 100.0 / n)
    if digits is not None:
        val = round_half_up(val, digits)
    return [n.alias("responses"), prom.alias("promoters"),
            F.sum(F.when((score >= 7) & (score <= 8), 1).otherwise(0)).alias("passives"),
            det.alias("detractors"), val.alias("nps_score")]


def nps(df: DataFrame, score: str = "score", by: list[str] | None = None, digits: int | None = 1) -> DataFrame:
    """Responses, promoters (>= 9), passives (7-8), detractors (<= 6) and
    score = % promoters - % detractors (``digits`` decimals; None = unrounded)."""
    return df.groupBy(*(by or [])).agg(*_nps_aggs(F.col(score), digits))


def weekly_median(df: DataFrame, value: str, date: str, by: list[str] | None = None) -> DataFrame:
    """Exact median of ``value`` per (Monday week, group), sort-based
    (``functions.stats.exact_median``), with the response count."""
    keys = ["week", *(by or [])]
    w = df.withColumn("week", F.to_date(F.date_trunc("week", F.col(date))))
    med = exact_median(w, keys, value, "median_value")
    n = w.groupBy(*keys).agg(F.count(F.lit(1)).alias("responses"))
    return n.join(med, keys, "left")


def segment_scores(feedback: DataFrame, customers: DataFrame, by: str = "segment") -> DataFrame:
    """Average score (round 2) and responses per customer segment."""
    j = feedback_by(feedback, customers)
    return j.groupBy(by).agg(round_half_up(F.avg("score"), 2).alias("avg_score"), F.count(F.lit(1)).alias("responses"))


def feedback_by(feedback: DataFrame, customers: DataFrame, key: str = "customer_id") -> DataFrame:
    """Feedback ⋈ customer (inner equi-join on the customer key)."""
    return feedback.join(customers, key, "inner")


def ranked_daily(df: DataFrame, by: str, date: str) -> DataFrame:
    """Daily responses per group ranked newest first
    (``ROW_NUMBER() OVER (PARTITION BY group ORDER BY day DESC)`` on the aggregate)."""
    daily = df.groupBy(by, F.to_date(F.col(date)).alias("day")).agg(*_nps_aggs(F.col("score"), 1))
    w = Window.partitionBy(by).orderBy(F.col("day").desc())
    return daily.withColumn("day_rank", F.row_number().over(w))


def detractors(feedback: DataFrame, customers: DataFrame, n: int = 10, contains: list[str] | None = None,
               since=None) -> DataFrame:
    """The ``n`` newest detractor responses (score <= 6) with customer
    details; optional case-insensitive text search (any term) and recency
    bound — built as ``score <= 6 AND (t1 OR t2 ...) AND recent``."""
    d = feedback.filter(F.col("score") <= 6)
    if contains:
        hit = F.lit(False)
        for t in contains:
            hit = hit | F.lower(F.col("feedback_text")).contains(t.lower())
        d = d.filter(hit)
    if since is not None:
        d = d.filter(F.col("submitted_at") >= F.lit(since).cast("date"))
    top = d.orderBy(F.col("submitted_at").desc(), F.col("id").desc()).limit(n)
    return top.join(customers, "customer_id", "left")
