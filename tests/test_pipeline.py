"""End-to-end checks in the shape of the reference's own tests."""

import datetime as dt

from pyspark.sql import functions as F

from autokpi.operators import discover, frame, prepare, quality, report
from autokpi.plans import sync
from autokpi.sources import catalog as cat


def dirty_rows(spark):
    good = [(f"2024-01-{d:02d}", "revenue", float(100 + d), f"C{d % 3}") for d in range(1, 15)]
    bad = [("not-a-date", "revenue", 5.0, "C1"), ("2024-01-20", "revenue", None, "C1"),
           ("2024-01-21", None, 7.0, "C2")]
    return spark.createDataFrame(good + bad, "date string, kpi_name string, value double, customer_id string")


def test_whole_pipeline_on_dirty_input(spark):
    canon = frame.canonicalise(dirty_rows(spark))
    assert canon.count() == 14
    nulls = canon.select([F.sum(F.col(c).isNull().cast("int")).alias(c) for c in canon.columns]).first()
    assert all(v == 0 for v in nulls.asDict().values())
    fields = spark.createDataFrame([(1, 1, "revenue", "currency", True)],
                                   "id int, template_id int, global_field_name string, data_type string, required boolean")
    out = sync.sync(canon, fields=fields)
    checks = {r.check_type for r in out["validation"].collect()}
    assert checks == {"schema", "null", "anomaly"}
    kpis = out["kpis"].collect()
    assert len(kpis) == 1 and kpis[0].kpi_name == "revenue" and kpis[0].source_record_count == 14
    cleaned, _ = prepare.auto_prepare(canon)
    assert cleaned.count() == 14
    roles, _ = prepare.auto_model(cleaned)
    assert roles.count() == len(cleaned.columns)
    gov = quality.governance(canon, out["validation"], F.lit(1), F.lit(True)).first()
    assert 0 <= gov.overall <= 100


def test_introspect_suggest_run_summarise(spark):
    rows = [(i, (dt.date(2024, 1, 1) + dt.timedelta(days=i)).isoformat(), 10.0 + i, "north") for i in range(35)]
    contributions = spark.createDataFrame(rows, "id int, paid_at string, amount double, region string") \
        .withColumn("paid_at", F.col("paid_at").cast("date"))
    tables = {"contributions": contributions}
    catalog = cat.catalog_columns(spark, tables)
    assert cat.count_tables(catalog).first().table_count == 1
    specs = discover.suggest_analyses(catalog, cat.table_profile(tables)).orderBy("seq").collect()
    assert specs[0].kind == "time_series_sum" and specs[0].amount_column == "amount"
    res = discover.run_analysis(tables, specs[0].asDict())
    assert res.count() > 0
    kpi = discover.summarise(res, "time_series_sum").first()
    assert kpi.value > 0 and kpi.status == "NORMAL"
    kpis = discover.analyse_all(spark, tables, as_of="2024-02-05").collect()
    assert {k.status for k in kpis} <= {"NORMAL", "WARNING", "WATCH", "CRITICAL"} and len(kpis) == len(specs)


def test_list_tables_finds_the_table(spark):
    tables = {"rna_sequences": spark.createDataFrame([(1, "A1", "ACGT")], "id int, accession string, sequence string")}
    names = [r.table_name for r in cat.list_tables(cat.catalog_columns(spark, tables)).collect()]
    assert names == ["rna_sequences"]


def test_overview_fallback_when_nothing_is_extractable(spark):
    tables = {"rna_sequences": spark.createDataFrame([(1, "A1", "ACGT"), (2, "B2", "GG")],
                                                     "id int, accession string, sequence string")}
    assert sync.extract(spark, tables).count() == 0
    out = sync.overview(spark, tables)
    k = out["kpis"].collect()
    assert len(k) >= 1 and k[0].kpi_name == "Table rows: rna_sequences" and k[0].value == 2.0
    assert out["validation"].count() == 1


def test_chart_specs(spark):
    snap = spark.createDataFrame([("net_sales", 10.0, "NORMAL"), ("orders", 20.0, "WARNING")],
                                 "kpi_name string, value double, status string")
    assert [r.name for r in report.snapshot(snap).collect()] == ["orders", "net sales"]
    rows = spark.createDataFrame([("2024-01", 10), ("2024-02", 20)], "month string, total int")
    pts = report.chart_series(rows).collect()
    assert len(pts) == 2 and pts[0].chart_type == "bar" and pts[0].x_column == "month"
    # two text columns: y falls back to the second column, every point is dropped -> no chart
    assert report.chart_series(spark.createDataFrame([("a", "b")], "x string, y string")).count() == 0
    # a single column has no y at all -> table only
    assert report.chart_series(spark.createDataFrame([("a",)], "x string")).first().chart_type == "table_only"


def test_chart_picks_y_from_first_row_values(spark):
    df = spark.createDataFrame([("2024-01", None, "12", 5), ("2024-02", 3.0, "x", 6)],
                               "month string, maybe double, amount_text string, total int")
    pts = report.chart_series(df).orderBy("position").collect()
    # first row: maybe is null (not numeric), amount_text "12" parses -> y; "x" is dropped after the cut
    assert pts[0].y_column == "amount_text" and [p.value for p in pts] == [12.0]
