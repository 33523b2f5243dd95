"""End-to-end compositions.

Each returns a dict of lazy DataFrames; sinks are separate (``autokpi.sinks``).
``extract_isolated`` stores the extracted daily totals in the shared checkpoint
folder, so the sources are scanned once however many results follow.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from autokpi.functions.core import event_time, quoted
from autokpi.operators import discover
from autokpi.operators import extract as ex
from autokpi.operators import forecast as fc
from autokpi.operators import frame as fr
from autokpi.operators import insights, isolation, kpi, mapping, prepare, quality, report, rollups
from autokpi.sinks import tables as sinks
from autokpi.sources import catalog as cat


def sync(canonical: DataFrame, fields: DataFrame | None = None, mappings: DataFrame | None = None,
         null_threshold: float = 0.10, anomaly_threshold: float = 0.50, batch_id: str | None = None,
         depts: DataFrame | None = None, department_id=None) -> dict[str, DataFrame]:
    """L1: map -> validate -> metrics/anomalies -> forecast -> lineage ->
    briefing -> combined report, from an extracted canonical KPI frame.

    Returns DataFrames: ``frame`` (mapped), ``validation``, ``kpis`` (W1 +
    A8 row counts), ``anomalies``, ``forecasts``, ``lineage``, ``briefing``
    and, when ``depts`` is given, ``combined``.  The metric input is the
    unmapped frame, as in the reference.  A schema failure is softened to a
    warning when no fields were defined for the tenant.
    """
    spark = canonical.sparkSession
    if fields is None:
        fields = spark.createDataFrame([], "id int, template_id int, global_field_name string, data_type string, "
                                           "required boolean")
    mapped = canonical
    if mappings is not None:
        mapped = mapping.apply_mappings(canonical, mapping.mapping_rules(mappings, fields))
    soften = fields.limit(1).count() == 0
    validation = quality.validate_long(mapped, fields, null_threshold, anomaly_threshold, soften_schema=soften)
    metrics = kpi.kpi_metrics(canonical)
    kpis = quality.kpi_row_counts(canonical, metrics)
    if department_id is not None:
        kpis = kpis.withColumn("department_id", F.lit(department_id))
    anomalies = kpi.anomalies(metrics)
    forecasts = fc.forecast(canonical)
    bid = batch_id or _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%dT%H%M%S")
    lineage = sinks.lineage(canonical.withColumn("batch_source_id", F.lit(bid)))
    briefing = report.briefing(metrics, anomalies)
    out = {"frame": mapped, "validation": validation, "kpis": kpis, "anomalies": anomalies,
           "forecasts": forecasts, "lineage": lineage, "briefing": briefing}
    if depts is not None and department_id is not None:
        out["combined"] = rollups.combined_report(kpis.withColumn("user_id", F.lit(None).cast("int")), depts)
    return out


def _extractable(spark: SparkSession, tables: dict[str, DataFrame]) -> list[tuple[str, str | None, str | None, str]]:
    """(table, amount, date, label) of every table that is no view; bounded metadata, by table name."""
    summary = discover.table_summary(cat.catalog_columns(spark, tables)).filter(~F.col("is_view")).select(
        "table_name", F.get(F.col("amount_columns"), 0).alias("amt"), F.get(F.col("date_columns"), 0).alias("dt"),
        F.get(F.col("labels"), 0).alias("label")).orderBy("table_name").collect()
    return [(r["table_name"], r["amt"], r["dt"], (r["label"] or r["table_name"]).title()) for r in summary]


def extract(spark: SparkSession, tables: dict[str, DataFrame], days: int = 30, as_of=None) -> DataFrame:
    """L1 extraction: A1 for every discovered table with an amount and a date
    column (views skipped; label = first domain label title-cased, else the
    table name), unioned (U1) and canonicalised (P1)."""
    frames = [ex.daily_totals(tables[t], amt, dt, label, days, as_of) for t, amt, dt, label in _extractable(spark, tables) if amt and dt]
    if not frames:
        return fr.empty_kpi_frame(spark)
    return fr.canonicalise(ex.union_frames(frames))


EXTRACT_STATUS = "table_name string, label string, outcome string, days bigint, rows_read bigint, rows_rejected bigint, error string"


def extract_isolated(spark: SparkSession, tables: dict[str, DataFrame], days: int | None = 30, as_of=None) -> dict[str, DataFrame]:
    """L1 extraction in which a failing table ends nothing but itself: ``frame``, ``status``, ``rejects``.

    Each table's daily totals are an action of their own and stored (days, not
    rows).  Outcomes: synced, skipped (no amount or date column, or no day in
    the window) or failed; read and rejected rows are observed on the way.
    """
    found = _extractable(spark, tables)
    specs = [{"kind": "time_series_sum", "table_name": t, "amount_column": amt, "date_column": dt, "label": label}
             for t, amt, dt, label in found if amt and dt]

    def run(spec: dict) -> isolation.Outcome:
        def plan(seen):
            df = tables[spec["table_name"]]
            bad = [c for _, c in discover.unparsable(df, spec["amount_column"], spec["date_column"])]
            hit = reduce(lambda a, b: a | b, bad).cast("long") if bad else F.lit(0).cast("long")
            names = dict.fromkeys([spec["amount_column"], spec["date_column"]])
            read = df.select(*[quoted(c) for c in names]).observe(
                seen, F.count(F.lit(1)).alias("rows_read"), F.coalesce(F.sum(hit), F.lit(0)).alias("rows_rejected"))
            newest = as_of
            if newest is None and days is not None:
                newest = df.agg(F.max(event_time(df, spec["date_column"])).cast("string")).first()[0]
            return ex.daily_totals(read, spec["amount_column"], spec["date_column"], spec["label"], days if newest is not None else None, newest)
        return isolation.stored(plan)

    rows, frames = [], []
    for sp, got in zip(specs, isolation.in_turn(spark, run, specs)):
        n = got.frame.count() if got.frame is not None else None
        if n:
            frames.append(got.frame)
        rows.append((sp["table_name"], sp["label"], "failed" if got.error else "synced" if n else "skipped", n,
                     got.seen.get("rows_read"), got.seen.get("rows_rejected"), got.error))
    rows += [(t, label, "skipped", None, None, None, None) for t, amt, dt, label in found if not (amt and dt)]
    frame = fr.canonicalise(ex.union_frames(frames)) if frames else fr.empty_kpi_frame(spark)
    return {"frame": frame, "status": spark.createDataFrame(rows, EXTRACT_STATUS), "rejects": discover.rejects(tables, specs)}


def overview(spark: SparkSession, tables: dict[str, DataFrame], n: int = 10) -> dict[str, DataFrame]:
    """L2: when nothing is extractable: table-size KPIs (A19) and a schema
    validation row saying so."""
    profile = cat.table_profile(tables)
    kpis = cat.overview_kpis(profile, n).withColumn("status", F.lit("NORMAL"))
    check = spark.createDataFrame([("schema", "warning", "No KPI columns found; reporting table sizes instead.")],
                                  quality.RESULT_SCHEMA)
    return {"kpis": kpis, "validation": check, "profile": profile}


def analyst(frame: DataFrame, logs: DataFrame, days_since_sync, mapped: bool, as_of, top: int = 3,
            account: str = "customer_id") -> dict[str, DataFrame]:
    """L4: prepare -> model -> insights -> governance -> explanations (top 3
    KPIs by |z|, newest day)."""
    cleaned, actions = prepare.auto_prepare(frame)
    roles, suggestions = prepare.auto_model(cleaned)
    ins = insights.insights(frame, as_of, account)
    days = days_since_sync if isinstance(days_since_sync, Column) else F.lit(days_since_sync)
    gov = quality.governance(frame, logs, days, F.lit(bool(mapped)))
    metrics = kpi.kpi_metrics(frame)
    expl = report.explain_kpi(metrics).orderBy(F.col("z_score").desc(), "kpi_name").limit(top)
    return {"prepared": cleaned, "actions": actions, "roles": roles, "suggestions": suggestions,
            "insights": ins, "governance": gov, "explanations": expl}


def dashboard(kpis: DataFrame, anomalies: DataFrame, depts: DataFrame, reports: DataFrame | None = None) -> dict[str, DataFrame]:
    """Dashboard / executive summary: newest KPI per name (W3), snapshot (T1), all roll-ups (A9-A11) in one pass,
    department summaries (W4) with names (J2)."""
    return {
        "latest": kpi.latest_per(kpis, ["department_id", "kpi_name"], ["recorded_at", "user_id"]),
        "snapshot": report.snapshot(kpis, 12),
        "rollups": rollups.dashboard_rollups(kpis, depts),
        "departments": rollups.department_summaries(depts, kpis, anomalies, reports),
        "named": rollups.with_department(kpis, depts),
    }


DASHBOARD_COLUMNS = ["section", "period", "department_id", "department_name", "kpi_name", "value", "row_count", "anomaly_count",
                     "department_count", "rank", "status"]


def dashboard_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """L5 in long form: the roll-ups, and the sections ``latest``, ``snapshot`` and ``department_top`` (W4's newest KPIs)."""
    def section(name: str, df: DataFrame, **of) -> DataFrame:
        return df.select(F.lit(name).alias("section"), *[of[c].alias(c) if c in of else F.col(c) if c in df.columns else F.lit(None).alias(c)
                                                         for c in DASHBOARD_COLUMNS[1:]])

    rows = parts["rollups"].select(*[F.col(c) if c in parts["rollups"].columns else F.lit(None).cast("int" if c == "rank" else "string").alias(c)
                                     for c in DASHBOARD_COLUMNS])
    latest = section("latest", parts["latest"], period=F.col("recorded_at"), row_count=F.col("source_record_count"))
    top = parts["snapshot"].drop("department_id")
    snapshot = section("snapshot", top, period=F.col("recorded_at"), kpi_name=F.col("name"))
    newest = section("department_top", parts["departments"], period=F.col("recorded_at"))
    for part in (latest, snapshot, newest):
        rows = rows.unionByName(part)
    return rows
