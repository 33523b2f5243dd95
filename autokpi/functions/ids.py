"""Deterministic row identifiers.

* ``content_ids``: ``sha256`` of the row's text content plus an occurrence
  number among byte-identical rows.  Identical rows are counted, which combines
  them before the shuffle, and unfolded again with their numbers.
* ``positional_index``: 1-based position in a total order without a global
  single-partition window: range-partition + sort within partitions, cut lineage
  with a reliable checkpoint, count rows per partition (one tiny aggregate),
  prefix-sum the counts (one row per partition) and add the offset.  Jobs: the
  range sample, the checkpoint write, the count, the final read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from autokpi.session import ensure_checkpoint_dir

_SEP = "\u001f"
_NULL = "\\N"
#: Identical rows that are unfolded in one place.
UNFOLD = 100_000


def row_content(df: DataFrame, cols: list[str] | None = None):
    cols = cols or df.columns
    return F.concat_ws(_SEP, *[F.coalesce(F.col(c).cast("string"), F.lit(_NULL)) for c in cols])


def content_ids(df: DataFrame, name: str, cols: list[str] | None = None,
                content_col: str | None = None) -> DataFrame:
    """Add ``name`` = ``sha2(content) || '-' || occurrence``.

    ``content_col`` names a precomputed content string (e.g. taken before a
    coercion), else the content of ``cols`` is used.  Rows equal in every
    column become one row with their number, so neither a window nor a join
    meets them; the row is unfolded where it is, or, if it stands for more than
    ``UNFOLD`` rows, in pieces of that size dealt over the tasks.
    """
    h, n = "__content_sha", "__k"
    content = F.col(content_col) if content_col else row_content(df, cols)
    counted = df.withColumn(h, F.sha2(content, 256)).groupBy(h, *[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias(n))
    few = counted.filter(F.col(n) <= UNFOLD).withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
    many = counted.filter(F.col(n) > UNFOLD).withColumn("__from", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n), F.lit(UNFOLD).cast("long"))))
    many = many.repartition(h, "__from").withColumn(
        "__i", F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + UNFOLD - 1, F.col(n)))))
    rows = few.unionByName(many.drop("__from"))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], F.concat(F.col(h), F.lit("-"), F.col("__i").cast("string")).alias(name))


def positional_index(df: DataFrame, order_cols: list[str], name: str = "position",
                     num_partitions: int | None = None, tie: bool = True) -> DataFrame:
    """Add a 1-based ``name`` following ``order_cols`` (ties: full row content,
    then a seeded random number).  The random last key only orders
    byte-identical rows, which cannot be told apart, so the result is the
    same; it lets the range partitioner split a run of identical rows instead
    of sending all of them to one task."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    tcol = "__tie"
    keyed = df.withColumn(tcol, F.sha2(row_content(df), 256) if tie else F.lit(""))
    keyed = keyed.withColumn("__salt", F.rand(17))
    keys = [F.col(c).asc_nulls_first() for c in order_cols] + [F.col(tcol), F.col("__salt")]
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).checkpoint(eager=True)
    mid = "__mid"
    local = ranged.withColumn(mid, F.monotonically_increasing_id())
    pid = F.shiftright(F.col(mid), 33)
    counts = (local.groupBy(pid.alias("__pid")).agg(F.count(F.lit(1)).alias("__n"))
              .withColumn("__off", F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")))
    out = (local.withColumn("__pid", pid)
           .join(F.broadcast(counts.select("__pid", "__off")), "__pid")
           .withColumn(name, F.col("__off") + F.col(mid).bitwiseAND(F.lit((1 << 33) - 1)) + 1))
    return out.drop(mid, "__pid", "__off", tcol, "__salt")
