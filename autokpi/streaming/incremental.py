"""Incremental (streaming) versions of extraction and ingest.

The reference re-runs its batch sync on a timer and appends, so repeated runs
duplicate rows.  Here the same results are maintained incrementally with
Structured Streaming: a file-source stream whose micro-batches read only their
new files, state kept by Spark's state store, and a table of daily totals that
is also the ledger of what was applied.

R1 turns a micro-batch into *changes of daily totals*.  Without a row id every
row adds its amount to its day.  With one, the state store keeps the newest
version of every row (its day and amount): a corrected row takes its old amount
off its old day and adds the new one, a row that comes again changes nothing,
and an older version that arrives late is passed over.  Rows of any lateness
count.  Each row of the totals carries the epoch that changed it last; a day is
changed only if its epoch is older, so a micro-batch that is replayed after a
crash is applied once, also where it had been applied in part.

The checkpoint location must be a shared folder; ``trigger(availableNow=True)``
processes what is there and stops, so the same code serves scheduled and
continuous runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from autokpi.functions.core import quoted
from autokpi.session import ensure_checkpoint_dir
from autokpi.sinks import tables as sinks
from autokpi.sources.readers import ingest_summary


def daily_totals_stream(stream: DataFrame, ts: str, amount: str, label: str, watermark: str = "2 days") -> DataFrame:
    """R1 (lazy part, append mode): ``sum(amount)`` per event-time day with a
    watermark; columns date, kpi_name, value.  State per open day only.  Event time
    must be a TIMESTAMP; a TIMESTAMP_NTZ column is read as session-time-zone
    wall clock."""
    if dict(stream.dtypes).get(ts) == "timestamp_ntz":
        stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return (stream.withWatermark(ts, watermark)
            .groupBy(F.window(F.col(ts), "1 day").alias("w"))
            .agg(F.sum(F.col(amount).cast("double")).alias("value"))
            .select(F.to_date(F.col("w.start")).alias("date"), F.lit(label).alias("kpi_name"), "value"))


def _rows(df: DataFrame, ts: str, amount: str, row_id: str | None, version: str | None) -> DataFrame:
    """(id, version, date, value) of source rows; the id is text, the version a long (null: older than any)."""
    return df.select((quoted(row_id).cast("string") if row_id else F.lit(None).cast("string")).alias("id"),
                     (quoted(version).cast("long") if version else F.lit(0).cast("long")).alias("version"),
                     F.to_date(quoted(ts)).alias("date"), quoted(amount).try_cast("double").alias("value"))


def row_changes(rows: DataFrame) -> DataFrame:
    """(date, delta, n) from a stream of (id, version, date, value): what each row changes, by the state of its id.

    State per id: its newest version's number, day and amount.  Among equal
    versions the later arrival wins; within a micro-batch the greatest day and
    amount.  Rows without an id are passed on as they are, without state.
    """
    def newest(key, batches, state):
        import pandas as pd

        rows_ = [r for part in batches for r in zip(part["version"], part["date"], part["value"])]
        if key[0] is None:
            got = [(d, v, 1) for _, d, v in rows_]
        else:
            rank = lambda r: tuple((not pd.isna(x), x) if not pd.isna(x) else (False, 0) for x in (r[0], None if pd.isna(r[1]) else r[1].toordinal(), r[2]))
            best = max(rows_, key=rank)
            number = None if pd.isna(best[0]) else int(best[0])
            old = state.get if state.exists else None
            if old is not None and old[0] is not None and (number is None or number < old[0]):
                return
            got = [] if old is None else [(old[1], None if old[2] is None else -old[2], -1)]
            day, value = (None if pd.isna(x) else x for x in best[1:])
            got.append((day, value, 1))
            state.update((number, day, value))
        yield pd.DataFrame({"date": pd.Series([d for d, _, _ in got], dtype="object"), "delta": pd.Series([v for _, v, _ in got], dtype="float64"),
                            "n": pd.Series([n for _, _, n in got], dtype="int64")})

    return rows.groupBy("id").applyInPandasWithState(
        newest, "date date, delta double, n bigint", "version bigint, date date, value double", "append", GroupStateTimeout.NoTimeout)


def apply_changes(spark: SparkSession, sink_path: str, changes: DataFrame, label: str, epoch: int) -> None:
    """Add (date, delta, n) to the totals at ``sink_path`` unless a day has this epoch already; days without rows leave no total.

    A day's total is null while none of its rows has a readable amount, as in A1.
    """
    sums = changes.filter(F.col("date").isNotNull()).groupBy("date").agg(
        F.coalesce(F.sum("delta"), F.lit(0.0)).alias("delta"), F.sum("n").alias("n"),
        F.sum(F.when(F.col("delta").isNotNull(), F.col("n")).otherwise(0)).alias("valued"))
    ensure_checkpoint_dir(spark)
    sums = sums.checkpoint(eager=True)  # a row per day: the micro-batch and its state are read once
    sinks.recover(spark, sink_path)
    schema = "date date, kpi_name string, value double, epoch bigint, row_count bigint, valued_count bigint"
    if sinks._exists(spark, sink_path):
        held = sinks._read(spark, sink_path, spark.createDataFrame([], schema)).select("date", F.col("value").alias("was"), F.col("epoch").alias("at"),
                                                                                 F.col("row_count").alias("had"), F.col("valued_count").alias("knew"))
        held = held.join(sums.select("date"), "date", "left_semi")
    else:
        held = spark.createDataFrame([], "date date, was double, at bigint, had bigint, knew bigint")
    both = sums.join(held, "date", "left").filter(F.col("at").isNull() | (F.col("at") < epoch))
    valued = F.col("valued") + F.coalesce("knew", F.lit(0))
    value = F.when(valued > 0, F.coalesce("was", F.lit(0.0)) + F.col("delta"))
    new = both.select("date", F.lit(label).alias("kpi_name"), value.alias("value"), F.lit(epoch).cast("bigint").alias("epoch"),
                      (F.col("n") + F.coalesce("had", F.lit(0))).alias("row_count"), valued.alias("valued_count"))
    sinks.upsert(spark, sink_path, new, ["kpi_name", "date"], "epoch", partition_by="date")


def read_totals(spark: SparkSession, sink_path: str) -> DataFrame:
    """(date, kpi_name, value): the daily totals of a sink, without days whose rows were all moved away by corrections."""
    return spark.read.parquet(sink_path).filter("row_count > 0").select("date", "kpi_name", "value")


def run_daily_totals(spark: SparkSession, source_path: str, schema: T.StructType | str, ts: str, amount: str,
                     label: str, sink_path: str, checkpoint: str, available_now: bool = True,
                     row_id: str | None = None, version: str | None = None) -> StreamingQuery:
    """Keep ``sink_path`` (partitioned by date) equal to batch A1 over all files.

    ``row_id`` names the rows' identity, so that a corrected or repeated row
    replaces its former self (the greatest ``version``, a whole number or a
    time, else the latest arrival); without it every row counts.  A micro-batch
    reads its new files only.
    """
    rows = _rows(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source_path), ts, amount, row_id, version)
    changes = row_changes(rows) if row_id else rows.select("date", F.col("value").alias("delta"), F.lit(1).cast("bigint").alias("n"))

    def apply(batch: DataFrame, epoch: int) -> None:
        apply_changes(batch.sparkSession, sink_path, batch, label, epoch)

    w = changes.writeStream.outputMode("append").foreachBatch(apply).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def run_ingest(spark: SparkSession, source_path: str, sink_path: str, checkpoint: str, today=None,
               available_now: bool = True) -> StreamingQuery:
    """R2: incremental ingest of department summaries (text files, one JSON
    document per line) into a report table keyed by (department, report_date).

    Rows are built by the batch code (S11).  Nothing is de-duplicated by time:
    the upsert lets the newest document of a key win, however late it comes."""
    stream = spark.readStream.text(source_path)

    def upsert_batch(batch: DataFrame, epoch: int) -> None:
        rows = ingest_summary(batch.withColumn("__line", F.monotonically_increasing_id()), "value", today, keep=["__line"])
        rows = rows.select("department", "report_date", F.to_json("combined_kpis").alias("combined_kpis"), "narrative",
                           F.struct(F.lit(epoch).cast("bigint").alias("epoch"), F.col("__line").alias("line")).alias("epoch"))
        sinks.upsert(batch.sparkSession, sink_path, rows, ["department", "report_date"], "epoch", partition_by="report_date")

    w = stream.writeStream.outputMode("append").foreachBatch(upsert_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
