"""Late, corrected, repeated and replayed rows give the batch result; a batch reads its new files only."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from autokpi.operators import extract
from autokpi.streaming import incremental

SCHEMA = "id string, ver long, ts timestamp, amount string"


def run(spark, base, **more):
    q = incremental.run_daily_totals(spark, f"{base}/src", SCHEMA, "ts", "amount", "Sales", f"{base}/out", f"{base}/ck", **more)
    q.awaitTermination()
    return q


def totals(spark, base):
    return {(r.date, r.kpi_name): None if r.value is None else round(r.value, 6) for r in incremental.read_totals(spark, f"{base}/out").collect()}


def batch(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.date, r.kpi_name): None if r.value is None else round(r.value, 6)
            for r in extract.daily_totals(df, "amount", "ts", "Sales", days=None).collect()}


def drop(spark, base, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{base}/src/{name}")


def test_late_corrected_and_repeated_rows(spark, tmpdir_path):
    rng = random.Random(6)
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=5)
    newest, plain = {}, []
    for turn in range(4):
        rows = []
        for _ in range(30):
            i = str(rng.randrange(40))
            ver = rng.choice([turn, turn, turn + 5, None])
            rows.append((i, ver, day(rng.randrange(12)), rng.choice(["1.5", "2", "40", "n/a"])))
        rows = list({r[0]: r for r in rows}.values())
        rows += [(None, 0, day(rng.randrange(12)), "7"), (f"undated{turn}", 0, None, "5")]
        drop(spark, tmpdir_path, f"d{turn}", rows)
        if turn == 2:
            drop(spark, tmpdir_path, "again", rows)  # the same file under another name
            plain.append(next(r for r in rows if r[0] is None))  # a row without an id has no former self
        for r in rows:
            if r[0] is None:
                plain.append(r)
            elif r[0] not in newest or newest[r[0]][1] is None or (r[1] is not None and r[1] >= newest[r[0]][1]):
                newest[r[0]] = r
        run(spark, tmpdir_path, row_id="id", version="ver")
        assert totals(spark, tmpdir_path) == batch(spark, list(newest.values()) + plain)


def test_a_batch_reads_its_new_files_only(spark, tmpdir_path):
    for k in range(3):
        drop(spark, tmpdir_path, f"d{k}", [(str(k * 10 + i), 0, dt.datetime(2024, 1, 1 + i % 4), "1") for i in range(10)])
        q = run(spark, tmpdir_path)
        assert sum(p["numInputRows"] for p in q.recentProgress) == 10
    assert sum(totals(spark, tmpdir_path).values()) == 30
    names = [os.path.join(d, f) for d, _, fs in os.walk(f"{tmpdir_path}/src/d0") for f in fs if f.endswith(".parquet")]
    os.rename(names[0], f"{tmpdir_path}/gone.parquet")  # read once, not needed again
    drop(spark, tmpdir_path, "d3", [("x", 0, dt.datetime(2024, 1, 1), "5")])
    run(spark, tmpdir_path)
    assert sum(totals(spark, tmpdir_path).values()) == 35


def test_replayed_epoch_is_applied_once_even_in_part(spark, tmpdir_path):
    sink = f"{tmpdir_path}/out"
    change = spark.createDataFrame([(dt.date(2024, 1, 1), 2.0, 1), (dt.date(2024, 1, 2), 3.0, 1)], "date date, delta double, n bigint")
    incremental.apply_changes(spark, sink, change, "Sales", 0)
    incremental.apply_changes(spark, sink, change, "Sales", 0)
    assert sorted(totals(spark, tmpdir_path).values()) == [2.0, 3.0]
    incremental.apply_changes(spark, sink, change.limit(1).filter(F.col("date") == dt.date(2024, 1, 1)), "Sales", 1)
    incremental.apply_changes(spark, sink, change, "Sales", 1)  # one day of epoch 1 had been applied
    assert totals(spark, tmpdir_path) == {(dt.date(2024, 1, 1), "Sales"): 4.0, (dt.date(2024, 1, 2), "Sales"): 6.0}
