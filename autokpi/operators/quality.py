"""Data-quality checks, validation frame, scorecards.

Every check is one aggregate over the frame (a single scan), its per-column
result unpivoted from one row; results are long rows
``(check_type, status, message)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autokpi.functions.core import quoted, round_half_up
from pyspark.sql import types as T

from autokpi.operators.frame import KPI_COLUMNS, RETIRED_KPI_NAMES

RESULT_SCHEMA = "check_type string, status string, message string"


def _pct0(x: float) -> str:
    return f"{x * 100:.0f}"


_q = quoted


# --------------------------------------------------------------------- A7 / A8

def validation_frame(df: DataFrame, kpi_names: list[str] | None = None) -> DataFrame:
    """Wide frame, one row per (report_date, customer_id), one column per KPI.

    ``sum(coalesce(value, 0))`` per KPI (absent combination -> null); defaults
    ``report_date`` '' and ``customer_id`` 'ACCOUNT-PRIMARY'; every extra column
    -> its first non-null value by ``source_row_id`` (D8).  No ``kpi_name`` ->
    distinct keys only.  The pivot value list is the distinct KPI names
    (bounded metadata, collected once unless given).  Scale: one shuffle on
    (report_date, customer_id) with partial aggregation; largest group = the
    rows of one account-day; one job (+1 to list the KPI names).
    """
    base, keys = _keyed(df), ["report_date", "customer_id"]
    if "kpi_name" not in df.columns:
        return base.select(*keys).dropDuplicates()
    if kpi_names is None:
        kpi_names = sorted(r[0] for r in base.select("kpi_name").distinct().dropna().collect())
    if not kpi_names:
        return base.select(*keys).dropDuplicates()
    val = F.coalesce(F.col("value").try_cast("double"), F.lit(0.0))
    aggs = [F.sum(F.when(F.col("kpi_name") == k, val)).alias(k) for k in kpi_names]
    extras = [c for c in df.columns if c not in KPI_COLUMNS and c not in kpi_names]
    order = F.col("source_row_id") if "source_row_id" in df.columns else F.lit(0)
    aggs += [F.min_by(_q(c), F.when(_q(c).isNotNull(), order)).alias(c) for c in extras]
    return base.groupBy(*keys).agg(*aggs)


def _keyed(df: DataFrame) -> DataFrame:
    """``df`` with the validation keys filled: report_date (text) and customer_id."""
    if "report_date" in df.columns:
        rd = F.coalesce(F.col("report_date").cast("string"), F.lit(""))
    elif "date" in df.columns:
        rd = F.coalesce(F.to_date(F.col("date")).cast("string"), F.lit(""))
    else:
        rd = F.current_date().cast("string")
    cid = F.coalesce(F.col("customer_id").cast("string"), F.lit("ACCOUNT-PRIMARY")) \
        if "customer_id" in df.columns else F.lit("ACCOUNT-PRIMARY")
    return df.withColumn("report_date", rd).withColumn("customer_id", cid)


def validation_rows(df: DataFrame) -> DataFrame:
    """A7 in long form: (report_date, customer_id, kpi_name, value), the sum of each KPI of each account-day.

    KPI names stay data: nothing is listed on the driver and no column is made
    of a name, so their number and spelling do not matter.
    """
    return _keyed(df).filter(F.col("kpi_name").isNotNull()).groupBy("report_date", "customer_id", "kpi_name").agg(
        F.sum(F.coalesce(F.col("value").try_cast("double"), F.lit(0.0))).alias("value"))


def validation_extras(df: DataFrame) -> DataFrame:
    """The other part of A7: one row per account-day with the first non-null value (by ``source_row_id``) of every extra column."""
    extras = [c for c in df.columns if c not in KPI_COLUMNS]
    order = F.col("source_row_id") if "source_row_id" in df.columns else F.lit(0)
    base = _keyed(df)
    if not extras:
        return base.select("report_date", "customer_id").distinct()
    return base.groupBy("report_date", "customer_id").agg(*[F.min_by(_q(c), F.when(_q(c).isNotNull(), order)).alias(c) for c in extras])


def validation_maps(df: DataFrame) -> DataFrame:
    """A7 with one row per account-day: its extra columns and ``kpis``, a MAP<kpi, sum> (absent KPIs have no entry)."""
    rows = validation_rows(df).groupBy("report_date", "customer_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("kpi_name", "value")))).alias("kpis"))
    return validation_extras(df).join(rows, ["report_date", "customer_id"], "left")


def kpi_row_counts(frame: DataFrame, results: DataFrame) -> DataFrame:
    """Attach the number of source rows per KPI to KPI results."""
    counts = frame.groupBy("kpi_name").agg(F.count(F.lit(1)).alias("source_record_count"))
    return results.join(counts, "kpi_name", "left")


# ------------------------------------------------------------------------- V1

def schema_check(df: DataFrame, fields: DataFrame, soften: bool = False, names: DataFrame | None = None) -> DataFrame:
    """V1: required field names must be columns of ``df``, or rows of ``names`` (kpi_name) where that is given.

    ``fields`` has ``global_field_name``, ``required``.  No requirements ->
    pass; missing -> fail (``soften`` turns it into a warning, used when the
    tenant defined no fields of its own).  The column list is schema metadata;
    the check is one ``isin`` against that bounded list and one aggregate.
    """
    req = fields.filter(F.coalesce(F.col("required"), F.lit(False)) & F.col("global_field_name").isNotNull()) \
        .select(F.col("global_field_name").cast("string").alias("global_field_name"),
                F.col("id") if "id" in fields.columns else F.lit(0).alias("id"))
    known = F.col("global_field_name").isin(df.columns)
    if names is not None:
        held = names.select(F.col("kpi_name").alias("__held")).distinct()
        req = req.join(held, F.col("global_field_name") == F.col("__held"), "left")
        known = known | F.col("__held").isNotNull()
    flagged = req.withColumn("__missing", ~known)
    agg = flagged.agg(
        F.count(F.lit(1)).alias("n_required"),
        F.sort_array(F.collect_list(F.when(F.col("__missing"), F.struct("id", "global_field_name"))))
        .alias("missing"))
    missing = F.transform(F.col("missing"), lambda s: s["global_field_name"])
    status = (F.when(F.col("n_required") == 0, "pass")
              .when(F.size(missing) > 0, "warning" if soften else "fail").otherwise("pass"))
    msg = (F.when(F.col("n_required") == 0, F.lit("No required fields defined — skipping schema check."))
           .when(F.size(missing) > 0, F.concat(F.lit("Missing required fields: "), F.array_join(missing, ", ")))
           .otherwise(F.concat(F.lit("All "), F.col("n_required").cast("string"), F.lit(" required fields present."))))
    return agg.select(F.lit("schema").alias("check_type"), status.alias("status"), msg.alias("message"))


# ------------------------------------------------------------------------- V2

def null_profile(df: DataFrame, threshold: float = 0.10) -> DataFrame:
    """V2 detail: per column null count, total, % (1 dp), flagged (rate > threshold).

    One aggregate (count of nulls of every column) -> one row -> ``stack``.
    """
    t = min(max(float(threshold), 0.0), 1.0)
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__total")]
    aggs += [F.sum(F.when(_q(c).isNull(), 1).otherwise(0)).alias(f"__n{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"__n{i}").cast("bigint").alias("null_count")) for i, c in enumerate(cols)])
    return _null_rates(one.select("__total", F.inline(each)), t)


def _null_rates(long: DataFrame, t: float) -> DataFrame:
    rate = F.try_divide(F.col("null_count"), F.col("__total"))
    return long.select(
        "column_name", "null_count", F.col("__total").alias("total_rows"),
        round_half_up(rate * 100, 1).alias("null_pct"),
        F.coalesce(rate > F.lit(t), F.lit(False)).alias("flagged"),
        F.col("__total"))


def null_check(df: DataFrame, threshold: float = 0.10) -> DataFrame:
    """V2: one result row: warning when any column's null rate exceeds the
    threshold (clamped to 0..1), pass otherwise or when empty."""
    t = min(max(float(threshold), 0.0), 1.0)
    return _null_result(null_profile(df, t), t)


def _null_result(prof: DataFrame, t: float) -> DataFrame:
    agg = prof.agg(F.max("__total").alias("total"),
                   F.sum(F.col("flagged").cast("int")).alias("n_flag"),
                   F.max(F.when(F.col("flagged"), F.col("null_pct"))).alias("worst"))
    status = F.when(F.coalesce(F.col("total"), F.lit(0)) == 0, "pass") \
        .when(F.col("n_flag") > 0, "warning").otherwise("pass")
    msg = (F.when(F.coalesce(F.col("total"), F.lit(0)) == 0, F.lit("No data to check for nulls."))
           .when(F.col("n_flag") > 0,
                 F.concat(F.col("n_flag").cast("string"), F.lit(f" column(s) exceed {_pct0(t)}% null threshold. Worst: "),
                          F.col("worst").cast("string"), F.lit("% nulls.")))
           .otherwise(F.lit(f"All columns below {_pct0(t)}% null threshold.")))
    return agg.select(F.lit("null").alias("check_type"), status.alias("status"), msg.alias("message"))


# --------------------------------------------------------------------- V3 / V4

def split_latest(vf: DataFrame, col: str = "report_date") -> tuple[DataFrame, DataFrame]:
    """V4: current = rows of the newest ``col``; history = earlier rows.

    The newest value is a scalar subquery (evaluated once).
    """
    mx = vf.agg(F.max(col)).scalar()
    return vf.filter(F.col(col) == mx), vf.filter(F.col(col) < mx)


def _numeric_cols(df: DataFrame) -> list[str]:
    retired = set(RETIRED_KPI_NAMES)
    out = []
    for f in df.schema.fields:
        if f.name in ("report_date", "customer_id") or f.name in retired:
            continue
        if f.name.replace("_", " ").title() in retired:
            continue
        if isinstance(f.dataType, T.NumericType):
            out.append(f.name)
    return out


def magnitude_profile(cur: DataFrame, hist: DataFrame, threshold: float = 0.50) -> DataFrame:
    """V3 detail: per numeric column Σcurrent vs Σhistory (nulls as 0).

    Columns missing from history are skipped; previous total 0 is skipped.
    Both sides are tagged and unioned, then one aggregate of conditional sums
    -> one row -> ``stack``.
    """
    t = min(max(float(threshold), 0.0), 10.0)
    cols = [c for c in _numeric_cols(cur) if c in hist.columns]
    if not cols:
        return cur.sparkSession.createDataFrame(
            [], "column_name string, current_total double, previous_total double, change_pct double, "
                "flagged boolean, n_cur bigint, n_hist bigint")
    side = F.col("__side")
    tagged = (cur.select(*[_q(c) for c in cols]).withColumn("__side", F.lit(1))
              .unionByName(hist.select(*[_q(c) for c in cols]).withColumn("__side", F.lit(0))))

    def total(c, s):
        return F.coalesce(F.sum(F.when(side == s, F.coalesce(_q(c).try_cast("double"), F.lit(0.0)))), F.lit(0.0))
    aggs = [F.sum(F.when(side == 1, 1).otherwise(0)).alias("c_n"), F.sum(F.when(side == 0, 1).otherwise(0)).alias("h_n")]
    aggs += [total(c, 1).alias(f"c{i}") for i, c in enumerate(cols)]
    aggs += [total(c, 0).alias(f"h{i}") for i, c in enumerate(cols)]
    both = tagged.agg(*aggs)
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("current_total"), F.col(f"h{i}").alias("previous_total"))
                     for i, c in enumerate(cols)])
    return _changes(both.select(F.col("c_n").alias("n_cur"), F.col("h_n").alias("n_hist"), F.inline(each)), t)


def _changes(long: DataFrame, t: float) -> DataFrame:
    change = F.try_divide(F.abs(F.col("current_total") - F.col("previous_total")), F.abs(F.col("previous_total")))
    return (long.filter(F.col("previous_total") != 0)
            .select("column_name", round_half_up("current_total", 2).alias("current_total"),
                    round_half_up("previous_total", 2).alias("previous_total"),
                    round_half_up(change * 100, 1).alias("change_pct"), (change > F.lit(t)).alias("flagged"),
                    "n_cur", "n_hist"))


def magnitude_check(cur: DataFrame, hist: DataFrame, threshold: float = 0.50) -> DataFrame:
    """V3: warning when any KPI's total moved more than ``threshold`` vs history
    (D18: message says "vs history"); pass when history or current is empty."""
    t = min(max(float(threshold), 0.0), 10.0)
    return _magnitude_result(magnitude_profile(cur, hist, t), cur.agg(F.count(F.lit(1))).scalar(), hist.agg(F.count(F.lit(1))).scalar(), t)


def _magnitude_result(prof: DataFrame, n_cur: Column, n_hist: Column, t: float) -> DataFrame:
    j = prof.filter("flagged").agg(
        F.count(F.lit(1)).alias("n_flag"),
        F.array_join(F.sort_array(F.collect_list("column_name")), ", ").alias("names"))
    empty = (n_cur == 0) | (n_hist == 0)
    status = F.when(empty, "pass").when(F.col("n_flag") > 0, "warning").otherwise("pass")
    msg = (F.when(empty, F.lit("Insufficient historical data for anomaly magnitude check."))
           .when(F.col("n_flag") > 0, F.concat(F.lit(f"Change vs history exceeds {_pct0(t)}% for: "), F.col("names")))
           .otherwise(F.lit(f"No KPIs exceed {_pct0(t)}% change vs history.")))
    return j.select(F.lit("anomaly").alias("check_type"), status.alias("status"), msg.alias("message"))


def validate(vf: DataFrame, fields: DataFrame, null_threshold: float = 0.10,
             anomaly_threshold: float = 0.50, soften_schema: bool = False) -> DataFrame:
    """V5: schema, null, magnitude checks in that order, as long rows with ``seq``.
    Scale: each check is one aggregate over the validation frame (shared
    exchange), the newest date one scalar subquery; one action."""
    cur, hist = split_latest(vf)
    parts = [schema_check(vf, fields, soften_schema), null_check(cur, null_threshold),
             magnitude_check(cur, hist, anomaly_threshold)]
    parts = [p.withColumn("seq", F.lit(i + 1)) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, parts)


def validate_long(df: DataFrame, fields: DataFrame, null_threshold: float = 0.10, anomaly_threshold: float = 0.50,
                  soften_schema: bool = False) -> DataFrame:
    """V5 of a KPI frame with its KPI names as data: the rows that ``validate`` gives for its wide validation frame.

    Each KPI's rows of the newest day, its totals then and before come from one
    aggregate by name; an account-day of the newest day without the KPI is a
    null of it.  Only extra columns, which the schema bounds, are handled as columns.
    """
    nt, at = min(max(float(null_threshold), 0.0), 1.0), min(max(float(anomaly_threshold), 0.0), 10.0)
    sums, extras = validation_rows(df), validation_extras(df)
    newest = extras.agg(F.max("report_date")).scalar()
    cur, hist = extras.filter(F.col("report_date") == newest), extras.filter(F.col("report_date") < newest)
    n_cur, n_hist = cur.agg(F.count(F.lit(1))).scalar(), hist.agg(F.count(F.lit(1))).scalar()
    now, past = F.col("report_date") == newest, F.col("report_date") < newest
    of = sums.groupBy("kpi_name").agg(
        F.count(F.when(now, 1)).alias("present"), F.coalesce(F.sum(F.when(now, F.col("value"))), F.lit(0.0)).alias("current_total"),
        F.coalesce(F.sum(F.when(past, F.col("value"))), F.lit(0.0)).alias("previous_total"))
    nulls = of.select(n_cur.alias("__total"), F.col("kpi_name").alias("column_name"), (n_cur - F.col("present")).alias("null_count"))
    nulls = null_profile(cur, nt).unionByName(_null_rates(nulls, nt))
    retired = F.col("kpi_name").isin(*RETIRED_KPI_NAMES) | F.initcap(F.replace("kpi_name", F.lit("_"), F.lit(" "))).isin(*RETIRED_KPI_NAMES)
    moved = of.filter(~retired).select(n_cur.alias("n_cur"), n_hist.alias("n_hist"), F.col("kpi_name").alias("column_name"), "current_total", "previous_total")
    moved = magnitude_profile(cur, hist, at).unionByName(_changes(moved, at))
    parts = [schema_check(extras, fields, soften_schema, of), _null_result(nulls, nt), _magnitude_result(moved, n_cur, n_hist, at)]
    return reduce(DataFrame.unionByName, [p.withColumn("seq", F.lit(i + 1)) for i, p in enumerate(parts)])


# ----------------------------------------------------------------- A12 / A13

def _score() -> Column:
    return F.when(F.col("status") == "pass", 100).when(F.col("status") == "warning", 70).otherwise(0)


def newest_logs(logs: DataFrame, n: int, key: str = "department_id") -> DataFrame:
    """Newest ``n`` logs per ``key`` by (created_at, id) desc.  ``row_number <= n``
    is planned with a partial WindowGroupLimit before the shuffle, so a hot
    department ships at most ``n`` rows per map task."""
    w = Window.partitionBy(key).orderBy(F.col("created_at").desc(), F.col("id").desc())
    return logs.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)


def scorecard(depts: DataFrame, logs: DataFrame, within: int | None = None) -> DataFrame:
    """Per department, newest log per check type (of its newest ``within`` logs, if given); pass=100, warning=70, else 0; score = half-even rounded mean (D16),
    -1 without logs; ``checks`` = 'type=status' pairs sorted by type;
    ``last_validation`` = newest log time.  Departments are a small dimension.
    """
    top = logs if within is None else newest_logs(logs, within)
    per_type = (top.groupBy("department_id", "check_type")
                .agg(F.max_by(F.col("status"), F.struct(F.col("created_at"), F.col("id"))).alias("status")))
    dept_scores = per_type.groupBy("department_id").agg(
        F.bround(F.avg(_score()), 0).cast("int").alias("score"),
        F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "check_type", "status"))), ",").alias("checks"))
    last = top.groupBy("department_id").agg(F.max("created_at").alias("last_validation"))
    out = (depts.select(F.col("id").alias("department_id"), F.col("name").alias("department_name"))
           .join(dept_scores, "department_id", "left").join(last, "department_id", "left"))
    return out.select("department_id", "department_name",
                      F.coalesce(F.col("score"), F.lit(-1)).alias("score"),
                      F.coalesce(F.col("checks"), F.lit("")).alias("checks"), "last_validation")


def pass_rate(depts: DataFrame, logs: DataFrame, n: int = 10) -> DataFrame:
    """% of ``pass`` among each department's newest ``n`` logs (1 dp);
    null when the department has none."""
    top = newest_logs(logs, n)
    rate = top.groupBy("department_id").agg(
        round_half_up(F.avg(F.when(F.col("status") == "pass", 100.0).otherwise(0.0)), 1).alias("pass_rate"),
        F.count(F.lit(1)).alias("n_logs"))
    return (depts.select(F.col("id").alias("department_id"), F.col("name").alias("department_name"))
            .join(rate, "department_id", "left")
            .select("department_id", "department_name", "pass_rate",
                    F.coalesce(F.col("n_logs"), F.lit(0)).alias("n_logs")))


def department_heartbeat(depts: DataFrame, logs: DataFrame, kpis: DataFrame, roles: DataFrame) -> DataFrame:
    """A13 (department status): schedule, last sync (newest KPI date),
    ``active`` when the department has KPI rows else ``pending``, number of
    role rows, and the validation score of its newest 10 logs (null when
    none).  Each input is pre-aggregated to one row per department before
    the left joins, so no department's rows meet in one place."""
    last = kpis.groupBy("department_id").agg(F.max("recorded_at").alias("last_sync"))
    users = roles.groupBy("department_id").agg(F.count(F.lit(1)).alias("user_count"))
    score = pass_rate(depts, logs, 10).select("department_id", F.col("pass_rate").alias("validation_score"))
    d = depts.select(F.col("id").alias("department_id"), F.col("name").alias("department_name"), "heartbeat_schedule")
    out = d.join(last, "department_id", "left").join(users, "department_id", "left").join(score, "department_id", "left")
    return out.select("department_id", "department_name", "heartbeat_schedule", "last_sync",
                      F.when(F.col("last_sync").isNotNull(), "active").otherwise("pending").alias("status"),
                      F.coalesce(F.col("user_count"), F.lit(0)).alias("user_count"), "validation_score")


def rag_status(kpis: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Any CRITICAL -> RED, any WARNING -> AMBER, else GREEN (per group).
    Scale: one aggregate by ``by`` (partial max per task); one job."""
    rank = F.max(F.when(F.col("status") == "CRITICAL", 2).when(F.col("status") == "WARNING", 1).otherwise(0))
    g = kpis.groupBy(*(by or [])).agg(rank.alias("__r"))
    return g.select(*(by or []), F.when(F.col("__r") == 2, "RED").when(F.col("__r") == 1, "AMBER")
                    .otherwise("GREEN").alias("overall_status"))


# ------------------------------------------------------------------------- F9

# Governance advice lines.
ADVICE_COMPLETENESS = "High null rates detected — review source data quality and consider imputation rules."
ADVICE_FRESHNESS = "Data is stale — trigger a sync or check your scheduled sync configuration."
ADVICE_VALIDITY = "Validation checks are failing — review schema mappings and data types."
ADVICE_TRACEABILITY = ("Semantic mappings are incomplete — configure field mappings in Settings for better "
                       "lineage tracking.")
ADVICE_GOOD = "Governance health is good. Continue monitoring regularly."


def governance(frame: DataFrame, checks: DataFrame, days_since_sync: Column, mapped: Column) -> DataFrame:
    """completeness, freshness, validity, traceability -> overall (1 dp), grade, advice.

    ``checks`` has a ``status`` column (validation results); ``days_since_sync``
    and ``mapped`` are columns of a one-row frame or literals.  One null-count
    aggregate over ``frame``; everything else is one-row arithmetic.
    """
    cols = frame.columns
    nulls = reduce(lambda a, b: a + b, [F.sum(F.when(_q(c).isNull(), 1).otherwise(0)) for c in cols])
    comp = frame.agg(F.count(F.lit(1)).alias("__rows"), nulls.alias("__nulls"))
    size = F.col("__rows") * F.lit(len(cols))
    rate = F.try_divide(F.col("__nulls").cast("double"), F.greatest(size, F.lit(1)).cast("double"))
    completeness = F.when(F.col("__rows") == 0, F.lit(0.0)) \
        .otherwise(round_half_up(F.greatest(F.lit(0.0), 1.0 - rate * 10) * 100, 1))
    n_checks = checks.agg(F.count(F.lit(1))).scalar()
    n_pass = checks.agg(F.sum(F.when(F.col("status") == "pass", 1).otherwise(0))).scalar()
    validity = F.when(n_checks == 0, F.lit(50.0)).otherwise(round_half_up(n_pass / n_checks * 100, 1))
    d = days_since_sync
    freshness = (F.when(d <= 1, 100.0).when(d <= 3, 80.0).when(d <= 7, 60.0).when(d <= 30, 30.0).otherwise(0.0))
    trace = F.when(mapped, 100.0).otherwise(40.0)
    s = comp.select(completeness.alias("completeness"), freshness.alias("freshness"),
                                   validity.alias("validity"), trace.alias("traceability"))
    overall = round_half_up((F.col("completeness") + F.col("freshness") + F.col("validity") + F.col("traceability")) / 4, 1)
    s = s.withColumn("overall", overall)
    grade = (F.when(F.col("overall") >= 90, "A").when(F.col("overall") >= 75, "B").when(F.col("overall") >= 60, "C")
             .when(F.col("overall") >= 40, "D").otherwise("F"))
    advice = F.filter(F.array(
        F.when(F.col("completeness") < 70, F.lit(ADVICE_COMPLETENESS)),
        F.when(F.col("freshness") < 60, F.lit(ADVICE_FRESHNESS)),
        F.when(F.col("validity") < 70, F.lit(ADVICE_VALIDITY)),
        F.when(F.col("traceability") < 60, F.lit(ADVICE_TRACEABILITY))), lambda x: x.isNotNull())
    advice = F.when(F.size(advice) == 0, F.array(F.lit(ADVICE_GOOD))).otherwise(advice)
    return s.withColumn("grade", grade).withColumn("recommendations", F.array_join(advice, " | "))
