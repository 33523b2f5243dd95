"""K5 and P1 ids along an order, without a whole key in one task."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from autokpi.functions import ids, scan
from autokpi.sinks import tables as sinks


@pytest.mark.parametrize("kind", ["int", "date", "timestamp", "string"])
def test_previous_row_equals_a_window(spark, kind):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([1, None]), rng.randrange(400), i, rng.choice(["x", "y", None])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, j int, n int, tie int, v string")
    at = {"int": F.col("n"), "date": F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")),
          "timestamp": F.timestamp_seconds(F.col("n") * 3600), "string": F.lpad(F.col("n").cast("string"), 5, "0")}[kind]
    df = df.withColumn("t", F.when(F.col("n") % 50 != 0, at)).drop("n")
    w = Window.partitionBy("k", "j").orderBy("t", "tie")
    want = df.withColumn("p", F.lag("v").over(w)).withColumn("f", F.row_number().over(w) == 1)
    for chunks in (64, 7, 1):
        got = scan.with_previous(df, ["k", "j"], ["t", "tie"], "v", "p", "f", chunks)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_hot_key_is_cut_into_chunks(spark):
    df = spark.range(100000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), (F.col("id") % 1000 == 0).alias("v"))
    sizes = [r["count"] for r in df.withColumn("c", scan.chunk_of(df, "t")).groupBy("k", "c").count().collect()]
    assert len(sizes) > 50 and max(sizes) < 4000
    kept = sinks.changed_only(df, ["k"], ["t"], "v")
    assert kept.count() == 200
    assert sinks.changed_only(df.limit(0), ["k"], ["t"], "v").count() == 0


def test_content_ids_number_identical_rows(spark, monkeypatch):
    rows = [("a", 1)] * 5 + [("b", None), ("c", 2), ("c", 2), (None, None)]
    df = spark.createDataFrame(rows, "x string, y int").repartition(3)
    for most in (100_000, 2):
        monkeypatch.setattr(ids, "UNFOLD", most)
        got = ids.content_ids(df, "rid").collect()
        assert sorted((r.x or "", int(r.rid.split("-")[1])) for r in got) == [("", 1)] + [("a", i) for i in range(1, 6)] + [("b", 1), ("c", 1), ("c", 2)]
        assert len({r.rid for r in got}) == 9 and len({r.rid.split("-")[0] for r in got}) == 4
    assert "Join" not in ids.content_ids(df, "rid")._jdf.queryExecution().optimizedPlan().toString()
