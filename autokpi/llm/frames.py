"""Shared helpers: reliable checkpoints, table paths and connected components."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

from autokpi.session import ensure_checkpoint_dir

#: Arrow batches of whole texts stay under this many bytes.
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()
_folders: list[tempfile.TemporaryDirectory] = []


def python_tasks(spark: SparkSession) -> None:
    """Prepare a session for Python tasks: ship this package once, bound the batches.

    Arrow batches that carry whole texts are bounded by bytes, not by rows
    alone.  The package goes to the executors as a zip file over Spark's own
    file server, so no shared folder has to hold it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.TemporaryDirectory(prefix="autokpi-tasks-")  # the driver serves the file until it ends
    _folders.append(folder)
    path = os.path.join(folder.name, "autokpi_tasks.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for where, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(where, name)
                    out.write(full, os.path.join("autokpi", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffles and checkpoints of finished steps.

    Its cleaner removes what no DataFrame refers to any more, but only notices
    when the driver's garbage is collected, which many small steps do not cause.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def connected_components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(id, class_id) for every id in ``links``: class_id is the smallest id reachable.

    Alternates two star contractions on the link table: every node hands its
    larger neighbours, then its smaller ones, to the smallest node it knows,
    until every node hangs on one root.  Links that are stars already need no
    round.  All work is grouped or joined on node ids (a hub's rows are combined
    before the shuffle and its join partition may be split); nothing is
    collected but a count.  Null ends and self-links are ignored.
    """
    def ordered(rows: DataFrame) -> DataFrame:
        rows = rows.where("u is not null and v is not null and u <> v")
        return stored(rows.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def settled(e: DataFrame) -> bool:
        """No node has two smaller neighbours, or one besides larger neighbours."""
        ends = e.select(F.inline(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above")),
                                         F.struct(F.col("v").alias("n"), F.lit(0).alias("below"), F.lit(1).alias("above")))))
        ends = ends.groupBy("n").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        return ends.where("below + above > 1 and below > 0").agg(F.count(F.lit(1))).first()[0] == 0

    e = ordered(links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")))
    for _ in range(most_rounds):
        if settled(e):
            break
        ends = e.select(F.inline(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("m")),
                                         F.struct(F.col("v").alias("n"), F.col("v").alias("m")))))
        low = ends.groupBy("n").agg(F.min("m").alias("m"))  # the larger neighbours of a node cannot be its minimum
        large = e.join(low, e.v == low.n).select("u", F.col("m").alias("v"))
        low = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = large.join(low, large.u == low.n).select(F.inline(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        e = ordered(small)
        ends = low = large = small = None
        release(links.sparkSession)
    else:
        raise RuntimeError("components did not settle; the link table changes between reads")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("class_id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("class_id")).unionAll(roots)
