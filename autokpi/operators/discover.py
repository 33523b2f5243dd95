"""Schema discovery: domain classification, column roles, suggested
analyses, running them, and reducing each result to one KPI
(V8-V12, A20, L3).

Classification and roles work on the catalog DataFrame (one row per table
and column; bounded metadata) with built-in array and regex functions.  The
analyses themselves are Spark jobs over the tables (see ``analyses``).
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autokpi.functions.core import quoted, round_half_up
from autokpi.operators import analyses, isolation
from autokpi.sources import catalog as cat

# Business-domain keywords (English and French), in label order.
DOMAIN_KEYWORDS: list[tuple[str, list[str]]] = [
    ("contribution", ["contribution", "cotisation", "cotisations", "contribut", "premium", "prime", "dues",
                      "deposit"]),
    ("payment", ["payment", "paiement", "paie", "payout", "versement", "pay", "transaction", "transactions",
                 "transfer", "remittance"]),
    ("beneficiary", ["beneficiary", "beneficiaire", "beneficiaires", "insured", "assure", "assures", "member",
                     "adherent", "adherents"]),
    ("employer", ["employer", "employeur", "company", "entreprise", "societe", "patron", "organization"]),
    ("employee", ["employee", "employe", "employes", "worker", "travailleur", "salarie", "staff", "personnel"]),
    ("claim", ["claim", "claims", "reclamation", "demande", "request", "application", "dossier", "dossiers"]),
    ("pension", ["pension", "pensions", "retirement", "retraite", "retired", "retraite", "rente"]),
    ("benefit", ["benefit", "benefits", "prestation", "prestations", "allocation", "allowance", "subsidy",
                 "indemnite", "indemnites"]),
    ("invoice", ["invoice", "facture", "factures", "bill", "billing"]),
    ("customer", ["customer", "client", "clients", "account", "compte", "comptes"]),
    ("product", ["product", "produit", "produits", "item", "article", "sku"]),
    ("inventory", ["inventory", "stock", "stocks", "warehouse", "entrepot"]),
    ("ticket", ["ticket", "tickets", "support", "incident", "case"]),
    ("audit", ["audit", "log", "logs", "history", "historique", "trace"]),
    ("user", ["user", "users", "utilisateur", "utilisateurs", "auth", "session", "sessions"]),
]

# Column-name patterns (searched anywhere in the name, case-insensitive).
AMOUNT_PATTERN = ("(?i)(amount|montant|valeur|value|price|prix|total|salary|salaire|"
                  "contribution|cotisation|paiement|payment|net|gross|brut)")
DATE_PATTERN = "(?i)(date|time|created|updated|recorded|timestamp|at$|_at|_on$|_dt$)"
ID_PATTERN = "(?i)(^id$|_id$|uuid|code|number|num$|reference)"


def _ordered_names(col: str, cond=None):
    """Names of a table's columns in schema order (optionally filtered)."""
    s = F.struct(F.col("ordinal"), F.col(col))
    item = s if cond is None else F.when(cond, s)
    return F.transform(F.sort_array(F.collect_list(item)), lambda x: x[col])


def table_summary(catalog: DataFrame) -> DataFrame:
    """V8 + V9: one row per table: ``labels`` (domains whose keyword is a
    substring of 'table col1 col2 ...', lower case; multi-label, label
    order), ``amount_columns``, ``date_columns``, ``id_columns`` (schema
    order).  Tables without a label get none here ('other' in A20/V10)."""
    per = catalog.groupBy("table_name", "table_ordinal", "is_view").agg(
        _ordered_names("column_name").alias("columns"),
        _ordered_names("column_name", F.col("column_name").rlike(AMOUNT_PATTERN)).alias("amount_columns"),
        _ordered_names("column_name", F.col("column_name").rlike(DATE_PATTERN)).alias("date_columns"),
        _ordered_names("column_name", F.col("column_name").rlike(ID_PATTERN)).alias("id_columns"))
    hay = F.lower(F.concat_ws(" ", F.col("table_name"), F.array_join(F.col("columns"), " ")))
    rules = F.array(*[F.struct(F.lit(lbl).alias("label"), F.array(*[F.lit(k) for k in kws]).alias("kw"))
                      for lbl, kws in DOMAIN_KEYWORDS])
    labels = F.transform(F.filter(rules, lambda r: F.exists(r["kw"], lambda k: F.instr(hay, k) > 0)),
                         lambda r: r["label"])
    return per.withColumn("labels", labels)


def classify(catalog: DataFrame) -> DataFrame:
    """V8: (table_name, labels) — labels joined by ',' in label order."""
    t = table_summary(catalog)
    return t.select("table_name", "table_ordinal", F.array_join("labels", ",").alias("labels"))


def column_roles(catalog: DataFrame) -> DataFrame:
    """V9: per column, whether the name marks an amount, a date, an id."""
    return catalog.select("table_name", "ordinal", "column_name",
                          F.col("column_name").rlike(AMOUNT_PATTERN).alias("is_amount"),
                          F.col("column_name").rlike(DATE_PATTERN).alias("is_date"),
                          F.col("column_name").rlike(ID_PATTERN).alias("is_id"))


def tables_by_domain(catalog: DataFrame) -> DataFrame:
    """Tables grouped by domain label ('other' when none), table order kept."""
    t = table_summary(catalog)
    ex = t.select("table_name", "table_ordinal",
                  F.explode(F.when(F.size("labels") > 0, F.col("labels")).otherwise(F.array(F.lit("other"))))
                  .alias("label"))
    return ex.groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("table_ordinal", "table_name"))), lambda x: x["table_name"])
        .alias("tables")).select("label", F.array_join("tables", ",").alias("tables"),
                                 F.size("tables").alias("table_count"))


# Fixed values, rule table of V10: (order, label, fallback label, max tables, kind, needs amount, needs date, title prefix)
_RULES = [
    (1, "contribution", None, 3, "time_series_sum", True, True, "Contribution trend over time"),
    (1, "contribution", None, 3, "missing_recent", True, True, "Late / missing contribution detection"),
    (2, "payment", None, 3, "anomaly_zscore", True, True, "Payment anomaly detection"),
    (3, "claim", None, 3, "count_over_time", False, True, "Claim processing throughput"),
    (4, "beneficiary", "employee", 1, "demographic", False, False, "Demographic distribution"),
    (5, "pension", "benefit", 2, "liability_forecast", True, True, "Pension/benefit liability forecast"),
]
_SUB = {"time_series_sum": 1, "missing_recent": 2}


def suggest_analyses(catalog: DataFrame, profile: DataFrame, n_overview: int = 5) -> DataFrame:
    """The analyses to run, in the reference's order.

    Per rule, the first ``max`` tables carrying the label (table order; the
    fallback label is used only when no table carries the first) that have the
    needed amount/date columns; then an overview of the ``n_overview``
    largest non-empty tables.  Columns: seq, kind, table_name, amount_column,
    date_column, title.  Everything runs on the per-table summary.
    """
    t = table_summary(catalog).select("table_name", "table_ordinal", "labels",
                                      F.get(F.col("amount_columns"), 0).alias("amt"),
                                      F.get(F.col("date_columns"), 0).alias("dt"))
    lab = t.select("table_name", "table_ordinal", "amt", "dt", F.explode("labels").alias("label"))
    w = Window.partitionBy("label").orderBy("table_ordinal")
    lab = lab.withColumn("label_rank", F.row_number().over(w))
    spark = catalog.sparkSession
    present = {r["label"] for r in lab.select("label").distinct().collect()}  # <= 15 labels
    rules = []
    for order, label, fallback, mx, kind, na, nd, title in _RULES:
        use = label if label in present else (fallback if fallback in present else None)
        if use is not None:
            rules.append((order, _SUB.get(kind, 1), use, mx, kind, na, nd, title))
    rdf = spark.createDataFrame(rules, "rule_order int, sub int, label string, max_tables int, kind string, "
                                       "needs_amount boolean, needs_date boolean, title_prefix string")
    s = lab.join(F.broadcast(rdf), "label").filter(F.col("label_rank") <= F.col("max_tables"))
    s = s.filter((~F.col("needs_amount") | F.col("amt").isNotNull()) & (~F.col("needs_date") | F.col("dt").isNotNull()))
    s = s.select(F.col("rule_order"), F.col("label_rank"), F.col("sub"), "kind", "table_name",
                 F.when(F.col("kind").isin("time_series_sum", "anomaly_zscore", "liability_forecast"),
                        F.col("amt")).alias("amount_column"),
                 F.when(F.col("kind") != "demographic", F.col("dt")).alias("date_column"),
                 F.concat(F.col("title_prefix"), F.lit(" ("), F.col("table_name"), F.lit(")")).alias("title"))
    big = cat.largest(profile, n_overview).join(t.select("table_name", "table_ordinal"), "table_name")
    wo = Window.orderBy(F.col("row_count").desc(), "table_ordinal")
    big = big.withColumn("label_rank", F.row_number().over(wo))
    ov = big.select(F.lit(6).alias("rule_order"), "label_rank", F.lit(1).alias("sub"), F.lit("overview").alias("kind"),
                    "table_name", F.lit(None).cast("string").alias("amount_column"),
                    F.lit(None).cast("string").alias("date_column"),
                    F.concat(F.lit("Table overview: "), F.col("table_name")).alias("title"))
    allr = s.unionByName(ov)
    wseq = Window.orderBy("rule_order", "label_rank", "sub")
    return allr.withColumn("seq", F.row_number().over(wseq)).drop("rule_order", "label_rank", "sub")


def run_analysis(tables: dict[str, DataFrame], spec: dict) -> DataFrame:
    """Run one analysis spec (kind, table_name, amount_column, date_column)."""
    df = tables[spec["table_name"]]
    kind, amt, dt = spec["kind"], spec.get("amount_column"), spec.get("date_column")
    if kind == "time_series_sum":
        return analyses.time_series_sum(df, amt, dt, 24)
    if kind == "count_over_time":
        return analyses.count_over_time(df, dt, 26)
    if kind == "anomaly_zscore":
        return analyses.value_outliers(df, amt, 2.5)
    if kind == "missing_recent":
        return analyses.missing_recent(df, dt)
    if kind == "demographic":
        return analyses.demographic(df)
    if kind == "liability_forecast":
        return analyses.liability_forecast(df, amt, dt)
    if kind == "overview":
        return cat.preview(df, 10)
    raise ValueError(f"Unknown analysis kind: {kind}")


def summarise(result: DataFrame, kind: str, as_of=None) -> DataFrame:
    """Reduce an analysis result to one KPI row ``(value, status)``.

    time series / weekly count: the newest bucket's total; outliers: their
    count (>= 5 WARNING, > 0 WATCH); recency: days since the last date (> 30
    CRITICAL, > 7 WARNING; ``as_of`` default today); demographic: Σ totals;
    liability: Σ forecast; overview: rows of ``result``, which is the table
    itself here and not its preview.  Empty -> no row.
    """
    if kind in ("time_series_sum", "count_over_time"):
        out = result.agg(F.count(F.lit(1)).alias("__n"), F.max_by("total", "bucket").alias("__v")) \
            .filter(F.col("__n") > 0).select(F.coalesce(F.col("__v").cast("double"), F.lit(0.0)).alias("value"))
        return out.withColumn("status", F.lit("NORMAL"))
    if kind == "anomaly_zscore":
        c = result.agg(F.count(F.lit(1)).cast("double").alias("value"))
        return c.withColumn("status", F.when(F.col("value") >= 5, "WARNING").when(F.col("value") > 0, "WATCH")
                            .otherwise("NORMAL"))
    if kind == "missing_recent":
        ref = F.current_date() if as_of is None else F.lit(as_of).cast("date")
        d = result.filter(F.col("last_seen").isNotNull()).select(
            F.datediff(ref, F.to_date("last_seen")).cast("double").alias("value"))
        return d.withColumn("status", F.when(F.col("value") > 30, "CRITICAL").when(F.col("value") > 7, "WARNING")
                            .otherwise("NORMAL"))
    if kind == "demographic":
        return result.agg(F.coalesce(F.sum("total"), F.lit(0)).cast("double").alias("value")) \
            .withColumn("status", F.lit("NORMAL"))
    if kind == "liability_forecast":
        f = result.filter(F.col("kind") == "forecast")
        return f.agg(F.count(F.lit(1)).alias("__n"), F.sum("total").alias("__v")).filter(F.col("__n") > 0) \
            .select(F.col("__v").cast("double").alias("value"), F.lit("NORMAL").alias("status"))
    if kind == "overview":
        return result.agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("status", F.lit("NORMAL"))
    raise ValueError(f"Unknown analysis kind: {kind}")


RESULT_SCHEMA = "seq int, kpi_name string, value double, status string, recorded_at date"
STATUS_SCHEMA = ("seq int, kpi_name string, kind string, table_name string, outcome string, value double, status string, "
                 "rows_read bigint, rows_rejected bigint, error string, recorded_at date")


def suggested_specs(spark: SparkSession, tables: dict[str, DataFrame]) -> list[dict]:
    """The suggested analyses in order: bounded metadata."""
    found = suggest_analyses(cat.catalog_columns(spark, tables), cat.table_profile(tables)).orderBy("seq").collect()
    return [r.asDict() | {"name": r["title"] or r["kind"]} for r in found]


def _kpi(tables: dict[str, DataFrame], spec: dict, as_of) -> DataFrame:
    """V11 and V12 of one spec: at most one row (value, status)."""
    result = tables[spec["table_name"]] if spec["kind"] == "overview" else run_analysis(tables, spec)
    return summarise(result, spec["kind"], as_of).select(round_half_up("value", 2).alias("value"), "status")


def analyse_all(spark: SparkSession, tables: dict[str, DataFrame], as_of=None, recorded_at=None) -> DataFrame:
    """L3: discover -> suggest -> run -> summarise every analysis into KPI rows
    (kpi_name = title, value rounded to 2, status, recorded_at).  Each analysis
    is its own lazy plan and all of them are unioned into one result, so one
    action runs everything; a spec that cannot be planned gives a row with
    status 'FAILED'.  ``sync_analyses`` also isolates what fails while running (D26)."""
    day = recorded_at or _dt.date.today().isoformat()
    parts = []
    for sp in suggested_specs(spark, tables):
        try:
            kpi = _kpi(tables, sp, as_of)
        except Exception as exc:  # noqa: BLE001 -- reported per analysis
            kpi = spark.createDataFrame([(None, f"FAILED: {type(exc).__name__}")], "value double, status string")
        parts.append(kpi.select(F.lit(sp["seq"]).alias("seq"), F.lit(sp["name"]).alias("kpi_name"), "value", "status",
                                F.lit(day).cast("date").alias("recorded_at")))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], RESULT_SCHEMA)


def read_columns(df: DataFrame, spec: dict) -> list[str]:
    """The columns that an analysis reads."""
    named = [c for c in (spec.get("amount_column"), spec.get("date_column")) if c]
    if spec["kind"] == "demographic":
        return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return [] if spec["kind"] == "overview" else named


def unparsable(df: DataFrame, amount: str | None, date: str | None) -> list[tuple[str, Column]]:
    """(column, condition) for the text columns among them: a value that is neither null nor readable."""
    out = []
    for name, kind in ((amount, "double"), (date, "timestamp_ntz")):
        if name and isinstance(df.schema[name].dataType, T.StringType):
            out.append((name, quoted(name).isNotNull() & quoted(name).try_cast(kind).isNull()))
    return out


def rejects(tables: dict[str, DataFrame], specs: list[dict]) -> DataFrame:
    """(table_name, column_name, text, row): every row whose amount or date some analysis cannot read, as JSON, once per column."""
    spark = next(iter(tables.values())).sparkSession
    found = {}
    for sp in specs:
        df = tables[sp["table_name"]]
        for name, bad in unparsable(df, sp.get("amount_column"), sp.get("date_column")):
            found.setdefault((sp["table_name"], name), df.filter(bad).select(
                F.lit(sp["table_name"]).alias("table_name"), F.lit(name).alias("column_name"), quoted(name).alias("text"),
                F.to_json(F.struct(*[quoted(c) for c in df.columns])).alias("row")))
    return reduce(DataFrame.unionByName, found.values()) if found else spark.createDataFrame(
        [], "table_name string, column_name string, text string, row string")


def sync_analyses(spark: SparkSession, tables: dict[str, DataFrame], as_of=None, recorded_at=None) -> dict[str, DataFrame]:
    """L3 run to its end: ``kpis``, ``status`` (a row per analysis) and ``rejects``.

    Every analysis is an action in its own try, so one that fails leaves the
    others intact.  Outcomes: synced (a KPI row), skipped (nothing to report) or
    failed (with the error's class).  ``rows_read`` and ``rows_rejected`` (an
    amount or date that cannot be read) are observed while it runs.  What meets
    on the driver is a row per analysis; the rejected rows stay a lazy frame.
    """
    specs = suggested_specs(spark, tables)
    day = _dt.date.fromisoformat(recorded_at) if recorded_at else _dt.date.today()

    def observe(spec: dict, seen: Observation) -> DataFrame:
        df = tables[spec["table_name"]]
        bad = [c for _, c in unparsable(df, spec.get("amount_column"), spec.get("date_column"))]
        hit = reduce(lambda a, b: a | b, bad).cast("long") if bad else F.lit(0).cast("long")
        return df.select(*[quoted(c) for c in read_columns(df, spec)]).observe(
            seen, F.count(F.lit(1)).alias("rows_read"), F.coalesce(F.sum(hit), F.lit(0)).alias("rows_rejected"))

    def run(spec: dict) -> list:
        def plan(seen: Observation) -> DataFrame:
            return _kpi({spec["table_name"]: observe(spec, seen)}, spec, as_of)
        return isolation.collected(plan)

    rows = []
    for sp, got in zip(specs, isolation.in_turn(spark, run, specs)):
        first = got.rows[0] if got.rows else None
        outcome = "failed" if got.error else "synced" if first is not None else "skipped"
        rows.append((sp["seq"], sp["name"], sp["kind"], sp["table_name"], outcome, first and first["value"], first and first["status"],
                     got.seen.get("rows_read"), got.seen.get("rows_rejected"), got.error, day))
    status = spark.createDataFrame(rows, STATUS_SCHEMA)
    kpis = status.filter("outcome = 'synced'").select("seq", "kpi_name", "value", "status", "recorded_at")
    return {"kpis": kpis, "status": status, "rejects": rejects(tables, specs)}
