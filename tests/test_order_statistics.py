"""Exact quantiles and modes by rank selection, against plain Python."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from autokpi.functions.stats import exact_median, exact_quantiles, mode_by


def test_quantiles_per_key_equal_numpy(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, None]), rng.choice([None, float(rng.randint(0, 40)), rng.random() * 100])) for _ in range(3000)]
    rows += [("one", 1, 5.0), ("none", 1, None), ("two", 1, 1.0), ("two", 1, 2.0)]
    df = spark.createDataFrame(rows, "k string, j int, v double").repartition(7)
    probabilities = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {(r.k, r.j): r.q for r in exact_quantiles(df, ["k", "j"], "v", probabilities, "q").collect()}
    want = {}
    for k, j, v in rows:
        if v is not None:
            want.setdefault((k, j), []).append(v)
    assert set(got) == set(want)
    for key, values in want.items():
        assert got[key] == pytest.approx(list(np.quantile(values, probabilities)))


def test_median_of_one_hot_column_spreads_over_tasks(spark):
    df = spark.range(300000).select((F.col("id") * 7919 % 300007).cast("double").alias("v"))
    med = exact_median(df, [], "v")
    assert med.first()[0] == statistics.median([i * 7919 % 300007 for i in range(300000)])
    plan = med._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(__p#" in plan.replace("windowspecdefinition(__k", "") and "windowspecdefinition(__v" not in plan
    assert [r[0] for r in exact_median(df.limit(0), [], "v").collect()] == [None]


def test_mode_takes_the_smallest_of_ties(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("a", "x"), ("b", None), (None, "z")], "k string, v string")
    assert {(r.k, r.m) for r in mode_by(df, ["k"], "v", "m").collect()} == {("a", "x"), (None, "z")}
    assert mode_by(df, [], "v").first()[0] == "x"
    assert "Window" not in mode_by(df, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
