"""Queries and operators give whole results: no cut that the oracle does not have."""

from pyspark.sql import functions as F

from autokpi.plans import q_rollups
from autokpi.plans.fixtures import fixture
from autokpi.plans.registry import QUERIES, load_all

from conftest import SF_MID, SF_SMALL

load_all()


def test_validation_logs_are_all_returned(spark):
    logs = fixture(spark, SF_MID, "fx_validation_logs").where("check_type = 'null' AND department_id = 1").count()
    assert logs > 100 and QUERIES["p14_validation_logs"](spark, SF_MID).count() == logs


def test_kpi_lineage_keeps_more_than_100_rows_a_key(spark, monkeypatch):
    real = q_rollups.table

    def many(spark, sf, name):
        t = real(spark, sf, name)
        return t.crossJoin(spark.range(120).select()) if name == "orders" else t

    monkeypatch.setattr(q_rollups, "table", many)
    found = QUERIES["j7_kpi_lineage"](spark, SF_SMALL).where("found is not null")
    keys = ["department_id", "user_id", "kpi_name", "recorded_at"]
    got = found.groupBy(*keys).agg(F.max("found").alias("found"), F.count("source_record_id").alias("rows"))
    assert got.count() > 0 and got.where("found <= 100 or rows <> found").count() == 0
