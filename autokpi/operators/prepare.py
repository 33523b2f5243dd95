"""Automatic data preparation and modelling.

Both operators read the table in one statistics pass: a single aggregate
with a handful of expressions per column, whose one-row result (bounded by
the column count) is read on the driver to decide the per-column rules.
Medians and modes (only for columns that need imputing) are exact and found
for all those columns at once (``functions.stats``), never in a per-group
buffer or a window over one column.  The cleaned frame is then one projection; the
action log one more aggregate (outlier counts need the bounds).  No
per-column jobs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autokpi.functions.stats import exact_median, mode_by

# Name hints of the preparation and modelling rules.
DATE_NAME_HINTS = ("date", "time", "at", "_on", "created", "updated")
NUMERIC_ID_HINTS = ("id", "code", "num", "ref", "key")
TEXT_ID_HINTS = ("id", "_id", "code", "ref", "key", "uuid")

ACTION_SCHEMA = ("col string, action string, filled bigint, coerced_nulls bigint, value string, capped bigint, "
                 "range_lo double, range_hi double")


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _is_string(t) -> bool:
    return isinstance(t, (T.StringType, T.VarcharType, T.CharType))


def _is_numeric(t) -> bool:
    return isinstance(t, T.NumericType)


def prepare_stats(df: DataFrame) -> dict:
    """Pass 1: one aggregate over all columns (driver reads one row):
    counts, coercible counts, mean and sample std.  Medians and modes are
    computed afterwards, only for the columns that need imputing."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(df.schema.fields):
        c, t = _q(f.name), f.dataType
        aggs.append(F.count(c).alias(f"nn{i}"))
        if _is_string(t) or _is_numeric(t):
            x = c.try_cast("double") if _is_string(t) else c.cast("double")
            aggs += [F.count(x).alias(f"nx{i}"), F.avg(x).alias(f"mu{i}"), F.stddev_samp(x).alias(f"sd{i}")]
    return df.agg(*aggs).first().asDict()


def _medians(df: DataFrame, cols: dict[int, Column]) -> dict[int, float | None]:
    """Exact medians of several columns at once (unpivoted, by rank selection)."""
    if not cols:
        return {}
    arr = F.array(*[F.struct(F.lit(i).alias("i"), x.cast("double").alias("x")) for i, x in cols.items()])
    long = df.select(F.inline(arr))
    return {r["i"]: r["median"] for r in exact_median(long, ["i"], "x").collect()}


def _modes(df: DataFrame, cols: dict[int, Column]) -> dict[int, str | None]:
    """Modes (ties: smallest) of several columns in one job, as text."""
    if not cols:
        return {}
    arr = F.array(*[F.struct(F.lit(i).alias("i"), x.cast("string").alias("x")) for i, x in cols.items()])
    long = df.select(F.inline(arr))
    return {r["i"]: r["mode"] for r in mode_by(long, ["i"], "x").collect()}


def auto_prepare(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V6: (cleaned frame, action log).

    Per column: a string column becomes numeric when more than half of its
    non-null values coerce (D11: only strings are coerced).  Numeric: every
    null after coercion is imputed with the median (0 when none), then values
    are capped at mean ± 3·std of the un-imputed values when any lies outside
    (D10).  Other columns: nulls -> mode (ties: smallest; 'UNKNOWN' when
    none); a string column whose name hints a date is parsed when more than
    half of all rows parse.

    Jobs: pass 1 (statistics), pass 2 (outlier and parse counts, which need
    pass 1's bounds and fills); the cleaned frame stays lazy.
    """
    s = prepare_stats(df)
    rows = s["__rows"]
    spark = df.sparkSession
    fields = df.schema.fields
    is_num = {i: _is_numeric(f.dataType) or (_is_string(f.dataType) and s[f"nx{i}"] > s[f"nn{i}"] * 0.5)
              for i, f in enumerate(fields)}
    need_md = {i: (_q(f.name).try_cast("double") if _is_string(f.dataType) else _q(f.name))
               for i, f in enumerate(fields) if rows and is_num[i] and rows - s[f"nx{i}"] > 0}
    s.update({f"md{i}": v for i, v in _medians(df, need_md).items()})
    need_mo = {i: _q(f.name) for i, f in enumerate(fields) if rows and not is_num[i] and rows - s[f"nn{i}"] > 0}
    s.update({f"mo{i}": v for i, v in _modes(df, need_mo).items()})
    exprs: dict[str, Column] = {}
    static, bounds, date_cands = [], [], []
    for i, f in enumerate(df.schema.fields):
        name, t, c = f.name, f.dataType, _q(f.name)
        nulls = rows - s[f"nn{i}"]
        exprs[name] = c
        if rows == 0:
            continue
        if is_num[i]:
            raw = c.try_cast("double") if _is_string(t) else c
            x = raw
            after = rows - s[f"nx{i}"]
            if after > 0:
                fill = 0.0 if s.get(f"md{i}") is None else float(s[f"md{i}"])
                x = F.coalesce(raw.cast("double"), F.lit(fill))
                static.append((name, "impute_median", int(after), int(after - nulls), str(round(fill, 4)),
                               None, None, None))
            exprs[name] = x
            mu, sd = s[f"mu{i}"], s[f"sd{i}"]
            if sd is not None and sd > 0:
                bounds.append((name, mu - 3 * sd, mu + 3 * sd, raw.cast("double")))
        else:
            if nulls > 0:
                mode = s.get(f"mo{i}")
                fill = "UNKNOWN" if mode is None else mode
                exprs[name] = F.coalesce(c, F.lit(fill).try_cast(t))
                static.append((name, "impute_mode", int(nulls), 0, str(fill), None, None, None))
            if _is_string(t) and any(h in name.lower() for h in DATE_NAME_HINTS):
                date_cands.append(name)
    two = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count(exprs[c].try_cast("timestamp_ntz")).alias(f"p{j}") for j, c in enumerate(date_cands)],
                 *[F.sum(F.when((r < lo) | (r > hi), 1).otherwise(0)).alias(f"o{j}")
                   for j, (_, lo, hi, r) in enumerate(bounds)]).first().asDict()
    acts = list(static)
    for j, (name, lo, hi, _) in enumerate(bounds):
        if two[f"o{j}"]:
            x = exprs[name].cast("double")
            exprs[name] = F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
            acts.append((name, "cap_outliers", None, None, None, int(two[f"o{j}"]), round(lo, 2), round(hi, 2)))
    for j, name in enumerate(date_cands):
        if two[f"p{j}"] > rows * 0.5:
            exprs[name] = exprs[name].try_cast("timestamp_ntz")
            acts.append((name, "parse_datetime", None, None, None, None, None, None))
    order = {c: k for k, c in enumerate(df.columns)}
    kind = {"impute_median": 0, "cap_outliers": 1, "impute_mode": 2, "parse_datetime": 3}
    acts.sort(key=lambda a: (order[a[0]], kind[a[1]]))
    cleaned = df.select(*[exprs[c].alias(c) for c in df.columns])
    return cleaned, spark.createDataFrame(acts, ACTION_SCHEMA)


def auto_model(df: DataFrame, distinct_cap: int = 20) -> tuple[DataFrame, DataFrame]:
    """V7: (column roles, suggested aggregations).

    Roles: empty; date; boolean; numeric -> identifier (name hint), metric
    (std/mean > 0.1; mean 0 -> 0, D21), else dimension_numeric; text ->
    category (<= 20 distinct), identifier (name hint; ``likely_references``
    when it ends in _id/_code), else text.  Distinct counts: one sketch
    aggregate, exact ``count_distinct`` only for columns the sketch puts near
    the cap.  Suggestions: first 3 metrics × first date (time_series) and ×
    first 2 categories (group_by).
    """
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        c = _q(f.name)
        aggs.append(F.count(c).alias(f"nn{i}"))
        if _is_numeric(f.dataType) and not isinstance(f.dataType, T.BooleanType):
            aggs += [F.avg(c.cast("double")).alias(f"mu{i}"), F.stddev_samp(c.cast("double")).alias(f"sd{i}")]
        elif _is_string(f.dataType):
            aggs.append(F.approx_count_distinct(c, 0.05).alias(f"ad{i}"))
    s = df.agg(*aggs).first().asDict()
    # the sketch (5 % error, near-exact at small cardinalities) only rules out
    # columns far above the cap; the exact count decides the rest
    near = [i for i, f in enumerate(fields) if _is_string(f.dataType) and s[f"ad{i}"] <= distinct_cap * 2 + 10]
    exact = {}
    if near:
        e = df.agg(*[F.count_distinct(_q(fields[i].name)).alias(f"cd{i}") for i in near]).first().asDict()
        exact = {i: e[f"cd{i}"] for i in near}
    roles = []
    for i, f in enumerate(fields):
        name, low, t = f.name, f.name.lower(), f.dataType
        hint = None
        if s[f"nn{i}"] == 0:
            role = "empty"
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            role = "date"
        elif isinstance(t, T.BooleanType):
            role = "boolean"
        elif _is_numeric(t):
            mu, sd = s[f"mu{i}"], s[f"sd{i}"]
            cv = (sd or 0.0) / mu if mu not in (0, None) else 0.0
            if sd is None:
                cv = float("nan")
            if any(k in low for k in NUMERIC_ID_HINTS):
                role = "identifier"
            elif cv > 0.1:
                role = "metric"
            else:
                role = "dimension_numeric"
        else:
            nd = exact.get(i, s.get(f"ad{i}", distinct_cap + 1))
            if nd <= distinct_cap:
                role = "category"
            elif any(k in low for k in TEXT_ID_HINTS):
                role = "identifier"
                if low.endswith("_id") or low.endswith("_code"):
                    hint = low.replace("_id", "").replace("_code", "")
            else:
                role = "text"
        roles.append((i + 1, name, role, hint))
    spark = df.sparkSession
    roles_df = spark.createDataFrame(roles, "ordinal int, column_name string, role string, likely_references string") \
        .withColumn("row_count", F.lit(s["__rows"]).cast("bigint")).withColumn("column_count", F.lit(len(fields)))
    metrics = [r[1] for r in roles if r[2] == "metric"]
    dates = [r[1] for r in roles if r[2] == "date"]
    cats = [r[1] for r in roles if r[2] == "category"]
    sugg = []
    for m in metrics[:3]:
        for d in dates[:1]:
            sugg.append(("time_series", m, d, None, "sum"))
        for c in cats[:2]:
            sugg.append(("group_by", m, None, c, "sum"))
    sugg_df = spark.createDataFrame([(k + 1, *x) for k, x in enumerate(sugg)],
                                    "ordinal int, type string, metric string, date string, dimension string, agg string")
    return roles_df, sugg_df


def kpi_candidates(roles: DataFrame) -> DataFrame:
    """V7: the columns that make KPIs (role metric), in column order."""
    return roles.filter(F.col("role") == "metric").select("ordinal", "column_name")


def run_suggestion(df: DataFrame, kind: str, metric: str, by: str) -> DataFrame:
    """The modeller's roll-up: ``sum(metric)`` by the date or category column."""
    key = F.to_date(_q(by)).alias(by) if kind == "time_series" else _q(by)
    return df.groupBy(key).agg(F.sum(_q(metric).cast("double")).alias(f"sum_{metric}"))


def run_suggestions(df: DataFrame, suggestions: DataFrame) -> DataFrame:
    """A18 for a whole suggestion list (bounded metadata): one aggregate per
    suggestion, unioned into long rows (suggestion ordinal, bucket, total)."""
    parts = []
    for r in suggestions.orderBy("ordinal").collect():
        by = r["date"] if r["type"] == "time_series" else r["dimension"]
        key = F.to_date(_q(by)).cast("string") if r["type"] == "time_series" else _q(by).cast("string")
        parts.append(df.groupBy(key.alias("bucket")).agg(F.sum(_q(r["metric"]).cast("double")).alias("total"))
                     .select(F.lit(r["ordinal"]).alias("ordinal"), "bucket", "total"))
    if not parts:
        return df.sparkSession.createDataFrame([], "ordinal int, bucket string, total double")
    return reduce(DataFrame.unionByName, parts)
