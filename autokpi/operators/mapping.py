"""Semantic fields and field mappings.

Fields, mappings and templates are small configuration tables; they are read
as DataFrames.  Only P2 collects: the list of mapping rules (bounded by the
number of configured mappings) to build one projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from autokpi.functions.core import round_half_up


def mapping_rules(mappings: DataFrame, fields: DataFrame) -> DataFrame:
    """Mapping ⋈ field definition on ``template_field_id = id``; mappings
    without a field are dropped.  Rule JSON is parsed into ``rule_type``,
    ``factor`` (default 1), ``offset`` (default 0).  Scale: configuration
    tables; the planner broadcasts the field side by measured size."""
    rule = F.col("transformation_rule")
    f = fields.select(F.col("id").alias("template_field_id"), "global_field_name", "data_type")
    return (mappings.join(f, "template_field_id", "inner")
            .select("template_field_id", "local_column_name", "global_field_name", "data_type",
                    F.get_json_object(rule, "$.type").alias("rule_type"),
                    F.coalesce(F.get_json_object(rule, "$.factor").try_cast("double"), F.lit(1.0)).alias("factor"),
                    F.coalesce(F.get_json_object(rule, "$.offset").try_cast("double"), F.lit(0.0)).alias("offset")))


def apply_mappings(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Copy each mapped local column to its global name, then apply the
    rule: multiply(factor), add(offset), uppercase, lowercase; anything else
    copies.  A missing local column skips that mapping; the raw column stays.
    Arithmetic uses ``try_cast`` so one bad mapping never discards the others,
    and upper/lower keep nulls null (D9).  Rules apply in
    ``template_field_id`` order (a later rule for the same name wins).
    Scale: one job to read the (bounded) rule list; the mapping itself is a
    narrow projection — no shuffle.
    """
    rows = rules.orderBy("template_field_id", "local_column_name").collect()
    out = df
    for r in rows:
        if r["local_column_name"] not in df.columns:
            continue
        src = F.col(f"`{r['local_column_name']}`")
        t = r["rule_type"]
        if t == "multiply":
            expr = src.try_cast("double") * F.lit(r["factor"])
        elif t == "add":
            expr = src.try_cast("double") + F.lit(r["offset"])
        elif t == "uppercase":
            expr = F.upper(src.cast("string"))
        elif t == "lowercase":
            expr = F.lower(src.cast("string"))
        else:
            expr = src
        out = out.withColumn(r["global_field_name"], expr)
    return out


def unmapped_fields(fields: DataFrame, mappings: DataFrame) -> DataFrame:
    """Fields with no mapping (anti-join), with their ``required`` flag."""
    m = mappings.select(F.col("template_field_id").alias("id")).distinct()
    return fields.join(m, "id", "left_anti")


def without_role(users: DataFrame, roles: DataFrame, key: str = "user_id") -> DataFrame:
    """Users with no role row (anti-join)."""
    return users.join(roles.select(key).distinct(), key, "left_anti")


def mapping_status(fields: DataFrame, mappings: DataFrame) -> DataFrame:
    """Mapping completeness per template: totals, mapped, missing
    required / optional names, and ``valid`` = no required field missing."""
    mapped_ids = mappings.select(F.col("template_field_id").alias("id")).distinct().withColumn("__m", F.lit(True))
    j = fields.join(mapped_ids, "id", "left")
    is_m = F.coalesce(F.col("__m"), F.lit(False))
    req = F.coalesce(F.col("required"), F.lit(False))
    g = j.groupBy("template_id").agg(
        F.count(F.lit(1)).alias("total_fields"),
        F.sum(is_m.cast("int")).alias("mapped_fields"),
        F.sum(req.cast("int")).alias("required_fields"),
        F.array_join(F.sort_array(F.collect_list(F.when(req & ~is_m, F.col("global_field_name")))), ",")
        .alias("missing_required"),
        F.array_join(F.sort_array(F.collect_list(F.when(~req & ~is_m, F.col("global_field_name")))), ",")
        .alias("missing_optional"))
    return g.withColumn("valid", F.col("missing_required") == "")


def kpi_mode(fields: DataFrame, mappings: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Per template, ``configured`` as soon as any field is mapped,
    ``configured-unmapped`` when fields exist but none is mapped, ``auto``
    when no fields are defined; with field and mapping counts.  ``templates``
    (``id``) names the templates to tell about; without it only those with
    fields are known, and none is ``auto``."""
    st = mapping_status(fields, mappings)
    if templates is not None:
        st = templates.select(F.col("id").alias("template_id")).distinct().join(st, "template_id", "left")
    total, mapped = (F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total_fields", "mapped_fields"))
    mode = F.when(total == 0, "auto").when(mapped > 0, "configured").otherwise("configured-unmapped")
    return st.select("template_id", mode.alias("mode"), total, mapped)


def runtime_config(departments: DataFrame, templates: DataFrame) -> DataFrame:
    """Effective validation thresholds per department from the template
    config JSON; defaults null 0.10, anomaly 0.50, critical z 3.0."""
    t = templates.select(F.col("id").alias("template_id"), "config")
    vr = "$.validation_rules"
    j = departments.join(t, "template_id", "left")
    return j.select(
        F.col("id").alias("department_id"), F.col("name").alias("company_name"),
        F.coalesce(F.get_json_object("config", f"{vr}.null_threshold").try_cast("double"), F.lit(0.10))
        .alias("null_threshold"),
        F.coalesce(F.get_json_object("config", f"{vr}.anomaly_threshold").try_cast("double"), F.lit(0.50))
        .alias("anomaly_threshold"),
        F.coalesce(F.get_json_object("config", f"{vr}.critical_anomaly_zscore").try_cast("double"), F.lit(3.0))
        .alias("critical_anomaly_zscore"))


def match_fields(fields: DataFrame, columns: DataFrame, top: int = 3) -> DataFrame:
    """Suggest columns for each semantic field by name tokens.

    score = number of field-name tokens ``[a-z0-9]+`` (with repeats) contained
    in the lower-cased column name; keep score > 0, the ``top`` best per field
    (ties: catalog order ``table_ordinal, ordinal``); confidence =
    min(1, 0.4 + 0.2·score) rounded to 2.

    Containment is turned into an equi-join: every distinct substring of a
    column name up to the longest token length is exploded and joined to the
    tokens on equality — no cartesian product of fields × columns.  Shuffle key:
    the token; the top-k per field is a window over matches only.
    """
    toks = (fields.select("id", "global_field_name",
                          F.posexplode(F.regexp_extract_all(F.lower("global_field_name"), F.lit("([a-z0-9]+)"), 1))
                          .alias("__tp", "token")))
    maxlen = toks.agg(F.max(F.length("token"))).first()[0] or 1  # one number from the field config
    name = F.lower(F.col("column_name"))
    n = F.length(name)
    subs = F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.lit(maxlen), n - i + 1), F.lit(1))),
                              lambda k: F.substring(name, i, k))))
    cols = columns.select("table_name", "column_name", "table_ordinal", "ordinal",
                          F.explode(F.array_distinct(subs)).alias("token"))
    hits = toks.join(cols, "token")
    scored = hits.groupBy("id", "global_field_name", "table_name", "column_name", "table_ordinal", "ordinal") \
        .agg(F.count(F.lit(1)).alias("score"))
    w = Window.partitionBy("id").orderBy(F.col("score").desc(), "table_ordinal", "ordinal")
    ranked = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return ranked.select(F.col("global_field_name").alias("semantic_field"), F.col("id").alias("semantic_field_id"),
                         "table_name", "column_name", "score", "rank",
                         round_half_up(F.least(F.lit(1.0), 0.4 + F.col("score") * 0.2), 2).alias("confidence"))
