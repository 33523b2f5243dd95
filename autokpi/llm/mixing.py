"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Every source is a queue of its documents in a shuffled order, once for each
allowed repeat.  A document copy's *virtual finish time* is the cumulative
number of its source's words up to its end, divided by the source's weight.
Sorting all copies by that time and cutting at the total budget serves the
sources in proportion to their weights; a source whose queue runs dry leaves
its share to the others.  The cut is the virtual time ``level`` at which

    sum over sources of min(weight * level, repeats * source_size) = budget,

so a source's target is min(weight * level, repeats * source_size).  The copy
that straddles the cut is taken if at least half of it lies before, so a source
misses its target by half a document at most.

The order within a source is that of md5(seed | doc_id).  Its first three hex
digits split every source into 4,096 even slices; slice totals give each
slice's offset and a window runs inside one slice only, so a source that holds
a third of all rows is never one task.  Only one row per source meets in one
place (targets).

Defined cases: a null text has size 0; a null source is a source of its own; a
source without a positive weight has target 0; documents of size 0 take 0 words;
repeated rows are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from autokpi.llm.frames import stored

BUDGET_SHARE = 1.5
REPEATS = 2
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
_SLICE_DIGITS = 3


def size_of(text: str = "text") -> Column:
    """Number of words of a text column (0 for null)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(docs: DataFrame, weights: list[float], source: str = "source") -> DataFrame:
    """(source, weight): the weights repeated over the sources by code point, null last."""
    names = docs.select(F.col(source).alias("source")).distinct()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    return names.select("source", pick.alias("weight"))


def targets(sizes: DataFrame, weights: DataFrame, budget_share: float = BUDGET_SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, weight, source_size, target) from per-source totals (source, source_size)."""
    w = weights.select(F.col("source").alias("__s"), F.col("weight").cast("double").alias("weight"))
    joined = sizes.join(w, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    live = F.col("weight") > 0
    cap = repeats * F.col("source_size")
    joined = joined.withColumn("__full", F.when(live, cap / F.col("weight")))
    every = Window.partitionBy(F.lit(1))
    order = Window.orderBy(F.col("__full").asc_nulls_first(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(F.when(live, cap)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.when(live, F.col("weight"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    budget = F.lit(float(budget_share)) * F.sum("source_size").over(every)
    joined = joined.withColumn("__level", F.when(live, (budget - before) / rest))
    level = F.max(F.when(F.col("__level") <= F.col("__full"), F.col("__level"))).over(every)
    target = F.when(live, F.least(cap.cast("double"), F.coalesce(F.col("weight") * level, cap.cast("double")))).otherwise(0.0)
    return joined.select("source", "weight", "source_size", target.alias("target"))


def schedule(rows: DataFrame, weights: DataFrame, budget_share: float = BUDGET_SHARE, repeats: int = REPEATS,
             seed: str = SEED) -> DataFrame:
    """(row, size, source, source_size, target, copies, taken) for rows (row, doc_id, source, size).

    ``copies`` lists (repeat, finish) of each copy that the mix takes.
    """
    keyed = rows.withColumn("__h", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")))
    keyed = keyed.withColumn("__slice", F.substring("__h", 1, _SLICE_DIGITS)).withColumn(
        "__key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
    slices = stored(keyed.groupBy("__key", "__slice").agg(F.sum("size").alias("__sum")))
    sizes = slices.groupBy("__key").agg(F.sum("__sum").alias("source_size")).withColumn(
        "source", F.when(F.col("__key") != "null", F.expr("substring(__key, 2)")))
    goal = targets(sizes.select("source", "source_size"), weights, budget_share, repeats)
    goal = goal.withColumn("__key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).drop("source")
    by_slice = Window.partitionBy("__key").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    start = slices.select("__key", "__slice", F.coalesce(F.sum("__sum").over(by_slice), F.lit(0)).alias("__offset")).join(goal, "__key")
    inside = Window.partitionBy("__key", "__slice").orderBy("__h", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("__start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(start, ["__key", "__slice"])
    first = F.col("__start") + F.col("__offset")
    copies = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda e: F.struct(
            e.alias("repeat"), (e * F.col("source_size") + first + F.col("size") / 2).alias("middle"),
            ((e * F.col("source_size") + first + F.col("size")) / F.col("weight")).alias("finish"))),
        lambda c: (F.col("weight") > 0) & (c["middle"] <= F.col("target")))
    placed = placed.withColumn("copies", copies)
    return placed.select("row", "size", "source", "source_size", "target", "copies",
                         (F.col("size") * F.size("copies")).cast("long").alias("taken"))


def _rows(docs: DataFrame, row: Column, doc_id: str, text: str, source: str) -> DataFrame:
    return docs.select(row.alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                       size_of(text).alias("size"))


def mix_report(docs: DataFrame, weights: DataFrame, budget_share: float = BUDGET_SHARE, repeats: int = REPEATS,
               doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, finish) per document, in order of virtual finish time."""
    rows = stored(_rows(docs, F.struct(F.col(doc_id).alias("id")), doc_id, text, source))
    plan = schedule(rows, weights, budget_share, repeats)
    return plan.select(F.col("row.id").alias("doc_id"), "size", "source_size", "target", "taken",
                       F.get("copies.finish", F.lit(0)).alias("finish")
                       ).orderBy(F.col("finish").asc_nulls_last(), "doc_id")


def mix(docs: DataFrame, weights: DataFrame, budget_share: float = BUDGET_SHARE, repeats: int = REPEATS,
        doc_id: str = "doc_id", text: str = "text", source: str = "source", ordered: bool = True) -> DataFrame:
    """The mixed documents: one row per taken copy with all columns of ``docs``, in queue order if ``ordered``."""
    plan = schedule(_rows(docs, F.struct(*[docs[c] for c in docs.columns]), doc_id, text, source), weights, budget_share, repeats)
    taken = plan.select("row", F.explode("copies").alias("copy"))
    if ordered:
        taken = taken.orderBy("copy.finish", F.xxhash64("row"))
    return taken.select(*[F.col("row")[c].alias(c) for c in docs.columns])
