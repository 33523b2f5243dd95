"""Result sinks and table maintenance (K1-K5).

Tables are plain Parquet folders partitioned by a date column.  Upserts and
purges rewrite only the partitions they touch.  The new images are written to a
staging folder first; renaming it to ``<path>__commit`` is the one step that
decides.  Before it the table is as it was; after it the new partitions are
moved in one by one, and if that breaks off, the next upsert, purge or
``recover`` of the table finishes it.  So a lost executor retries a task, and a
lost driver leaves the old or the new table, once recovered.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autokpi.functions import scan


def append(df: DataFrame, path: str, partition_by: str | list[str] | None = None) -> None:
    """K1: append a result batch, partitioned by its date column."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)


def upsert_frame(base: DataFrame, changes: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """K2 (lazy part): last write wins per key.

    ``unionByName`` then ``max_by(struct(*), order)`` per key: one hash
    aggregate with map-side partial aggregation; a hot key is pre-reduced.
    Changes win ties on ``order_col`` (they carry a higher tie-break rank).
    """
    both = (base.withColumn("__src", F.lit(0))
            .unionByName(changes.withColumn("__src", F.lit(1)), allowMissingColumns=True))
    rest = [c for c in both.columns if c not in keys and c != "__src"]
    row = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(F.col(order_col), F.col("__src")))
    agg = both.groupBy(*keys).agg(row.alias("__row"))
    return agg.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def upsert(spark, path: str, changes: DataFrame, keys: list[str], order_col: str,
           partition_by: str | None = None) -> None:
    """K2: merge ``changes`` into the Parquet table at ``path``.

    With ``partition_by`` among the keys only the partitions present in
    ``changes`` are read and rewritten (dynamic overwrite): a semi-join, which
    Spark turns into dynamic partition pruning.  If it is not a key, a changed
    row may have to leave another partition, so the whole table is merged and
    swapped in.  The new image is staged first.  Only a table that does not
    exist is created; a table that cannot be read raises.
    """
    if changes.isEmpty():
        return
    recover(spark, path)
    if not _exists(spark, path):
        append(upsert_frame(changes.limit(0), changes, keys, order_col), path, partition_by)
        return
    base = _read(spark, path, changes)
    by_partition = partition_by is not None and partition_by in keys
    if by_partition:
        touched = changes.select(partition_by).distinct()
        undated = base.filter(F.col(partition_by).isNull())
        base = base.join(touched, partition_by, "left_semi")  # never meets null
        if not changes.filter(F.col(partition_by).isNull()).isEmpty():
            base = base.unionByName(undated)
    merged = upsert_frame(base, changes, keys, order_col)
    stage = f"{path.rstrip('/')}__staging_{uuid.uuid4().hex}"
    _write(merged, stage, partition_by)
    if by_partition:
        _commit_partitions(spark, stage, path)
    else:
        _swap_folder(spark, stage, path)


def _fs(spark, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _read(spark, path: str, like: DataFrame | None = None) -> DataFrame:
    """Read a table with partition values as text, cast to the types of ``like``: '007' stays '007'."""
    df = spark.read.parquet(path) if like is None else _read_as_text(spark, path)
    types = {} if like is None else dict(like.dtypes)
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types and types[c] != t else F.col(c) for c, t in df.dtypes])


def _read_as_text(spark, path: str, folders: list[str] | None = None) -> DataFrame:
    """A table, or some of its partition folders, with partition values as the text they are named by."""
    name = "spark.sql.sources.partitionColumnTypeInference.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        types = spark.read.option("basePath", path).parquet(*(folders or [path])).schema
        types = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.NullType) else f.dataType) for f in types])
        return spark.read.schema(types).option("basePath", path).parquet(*(folders or [path]))  # nulls alone have no type
    finally:
        spark.conf.set(name, old)


def _write(df: DataFrame, path: str, partition_by: str | None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def _swap_folder(spark, stage: str, path: str) -> None:
    """Put a complete staged table in the place of ``path`` by two renames; ``_recover`` undoes half a swap."""
    fs, target = _fs(spark, path)
    old, new = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (_backup(path), stage))
    if not fs.rename(target, old) or not fs.rename(new, target):
        recover(spark, path)
        raise OSError(f"could not swap the staged table into {path}")
    fs.delete(old, True)


def _backup(path: str) -> str:
    return f"{path.rstrip('/')}__previous"


def _commit_folder(path: str) -> str:
    return f"{path.rstrip('/')}__commit"


def _commit_partitions(spark, stage: str, path: str) -> None:
    """Let the partitions staged in ``stage`` take the place of those in ``path``; an empty staged one removes its own."""
    fs, _ = _fs(spark, path)
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not fs.rename(Path(stage), Path(_commit_folder(path))):
        raise OSError(f"could not commit the staged partitions of {path}")
    recover(spark, path)


def recover(spark, path: str) -> None:
    """Finish what broke off: move committed partitions in, or put back a table whose swap stopped between its renames.

    Every step may run again: a partition still in the commit folder replaces
    the live one, one that is gone from it has replaced it already.
    """
    fs, target = _fs(spark, path)
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old = Path(_backup(path))
    if fs.exists(old):
        if fs.exists(target):
            fs.delete(old, True)
        else:
            fs.rename(old, target)
    commit = Path(_commit_folder(path))
    if fs.exists(commit):
        for entry in fs.listStatus(commit):
            if not entry.isDirectory():
                continue
            live = Path(target, entry.getPath().getName())
            if fs.exists(live):
                fs.delete(live, True)
            if len(fs.listStatus(entry.getPath())) and not fs.rename(entry.getPath(), live):
                raise OSError(f"could not move {entry.getPath()} into {path}")
        fs.delete(commit, True)


def purge_frame(df: DataFrame, predicate: Column) -> DataFrame:
    """K3 (lazy part): drop rows where ``predicate`` is true; null keeps the row."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def purge(spark, path: str, predicate: Column, partition_by: str | None = None) -> None:
    """K3: rewrite the table without the purged rows.

    With ``partition_by`` only partitions that hold a match are rewritten; the
    names of their folders, which a first pass over the predicate's columns
    finds, are all that the driver sees.  Partitions that the purge empties
    disappear.  Otherwise the kept rows are staged and the whole folder is
    swapped by two renames.  Rows where ``predicate`` is null stay.
    """
    recover(spark, path)
    df = spark.read.parquet(path)
    stage = f"{path.rstrip('/')}__staging_{uuid.uuid4().hex}"
    if partition_by is None:
        _write(purge_frame(df, predicate), stage, None)
        _swap_folder(spark, stage, path)
        return
    folder = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1)
    hit = df.filter(F.coalesce(predicate, F.lit(False))).select(folder.alias("folder")).distinct().collect()
    names = [unquote(r["folder"]) for r in hit]  # the file path is a URI
    if not names:
        return
    as_read, as_named = dict(df.dtypes)[partition_by], f"named_{uuid.uuid4().hex}"
    part = _read_as_text(spark, path, [f"{path.rstrip('/')}/{name}" for name in names])
    typed = part.withColumn(as_named, F.col(partition_by)).withColumn(partition_by, F.col(partition_by).cast(as_read))
    kept = purge_frame(typed, predicate).drop(partition_by).withColumnRenamed(as_named, partition_by)
    _write(kept, stage, partition_by)
    fs, staged = _fs(spark, stage)
    for name in names:
        fs.mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged, name))
    _commit_partitions(spark, stage, path)


def lineage(df: DataFrame, batch_col: str = "batch_source_id", id_col: str = "source_row_id",
            label_col: str = "record_label", date_col: str = "report_date",
            value_col: str = "value", kpi_col: str = "kpi_name") -> DataFrame:
    """K4: one lineage record per canonical row.

    ``record_value`` = numeric value, non-numeric/null -> 0.0; ``raw_payload``
    = the whole row as JSON.  Narrow: no shuffle.
    """
    payload = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    return df.select(
        F.col(batch_col).cast("string").alias("batch_source_id"),
        F.col(kpi_col).alias("kpi_name"),
        F.col(id_col).cast("string").alias("source_record_id"),
        F.col(label_col).alias("record_label"),
        F.col(date_col).alias("record_date"),
        F.coalesce(F.col(value_col).try_cast("double"), F.lit(0.0)).alias("record_value"),
        payload.alias("raw_payload"),
    )


def changed_only(df: DataFrame, keys: list[str], order: list[str], col: str) -> DataFrame:
    """K5: keep a row only when ``col`` differs (null-safe) from the previous
    row of the same key; the first row of a key is kept.  A key's history is
    cut into chunks of time with the last value carried over, so one key with a
    large part of all rows spreads over many tasks (see ``functions.scan``).
    """
    out = scan.with_previous(df, keys, order, col, "__prev", "__first")
    return out.filter(F.col("__first") | ~F.col("__prev").eqNullSafe(F.col(col))).drop("__prev", "__first")
