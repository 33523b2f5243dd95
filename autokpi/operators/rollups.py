"""Cross-department roll-ups, tenancy joins and drill-downs
(A9-A11, A19 via sources.catalog, A21, W4, J2, J4, J5, J7, J8).

KPI result rows: department_id, user_id, kpi_name, recorded_at, value,
source_record_count, status.  Departments, roles and templates are small
dimensions (broadcast); KPI results, lineage and reports are the large sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from autokpi.functions.core import round_half_up

UNASSIGNED = "Unassigned"


def with_department(kpis: DataFrame, depts: DataFrame) -> DataFrame:
    """KPI rows with their department name; missing -> 'Unassigned'.
    Left equi-join; the department dimension is broadcast by the planner /
    AQE when its measured size is small (no unchecked hint)."""
    d = depts.select(F.col("id").alias("department_id"), F.col("name").alias("department_name"))
    return (kpis.join(d, "department_id", "left")
            .withColumn("department_name", F.coalesce(F.col("department_name"), F.lit(UNASSIGNED))))


def department_breakdown(kpis: DataFrame, depts: DataFrame) -> DataFrame:
    """A9 (long form): per report date, department -> KPI -> sum.
    Scale: shuffle key (date, department, kpi) with partial sums; one job."""
    k = with_department(kpis, depts)
    return (k.groupBy(F.col("recorded_at").alias("report_date"), "department_name", "kpi_name")
            .agg(F.sum("value").alias("value")))


def combined_report(kpis: DataFrame, depts: DataFrame, report_date=None) -> DataFrame:
    """One row per report date: ``department_breakdown`` MAP<dept, MAP<kpi, sum>>,
    ``combined_kpis`` MAP<kpi, sum> and the narrative line (KPIs by name,
    ``{v:,.2f}``).  Two aggregation levels over the (date, dept, kpi) sums;
    ``report_date`` restricts to one date (pushed to the scan)."""
    if report_date is not None:
        kpis = kpis.filter(F.col("recorded_at") == F.lit(report_date).cast("date"))
    b = department_breakdown(kpis, depts)
    per_dept = b.groupBy("report_date", "department_name").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("kpi_name", "value")))).alias("__m"))
    by_name = lambda a, b: F.when(a["department_name"] < b["department_name"], -1) \
        .when(a["department_name"] > b["department_name"], 1).otherwise(0)
    dmap = per_dept.groupBy("report_date").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("department_name", "__m")), by_name))
        .alias("department_breakdown"))
    comb = b.groupBy("report_date", "kpi_name").agg(F.sum("value").alias("value"))
    cmap = comb.groupBy("report_date").agg(
        F.sort_array(F.collect_list(F.struct("kpi_name", "value"))).alias("__e"))
    text = F.array_join(F.transform(F.col("__e"), lambda e: F.concat(
        e["kpi_name"], F.lit(" "), F.format_number(round_half_up(e["value"], 2), 2))), ", ")
    cmap = cmap.select("report_date", F.map_from_entries("__e").alias("combined_kpis"),
                       F.concat(F.lit("Combined governed-mesh snapshot for "), F.col("report_date").cast("string"),
                                F.lit(": "), text).alias("narrative"))
    return dmap.join(cmap, "report_date")


def combined_kpis(kpis: DataFrame, newest: int | None = None) -> DataFrame:
    """A10: per KPI total (round 2) and number of distinct non-null departments,
    descending by total.  ``newest`` reproduces the reference's cut to the
    newest N rows (a TakeOrdered top-N); default: all rows.  ``count_distinct``
    is planned as a two-level aggregate (expand + partial)."""
    if newest is not None:
        kpis = kpis.orderBy(F.col("recorded_at").desc()).limit(newest)
    return (kpis.groupBy("kpi_name")
            .agg(round_half_up(F.sum("value"), 2).alias("total_value"),
                 F.count_distinct("department_id").alias("department_count")))


def timeline(kpis: DataFrame, depts: DataFrame) -> DataFrame:
    """Per recorded_at, total value and department -> value map.
    Scale: two aggregation levels (date, department) then date; the map holds
    at most one entry per department."""
    k = with_department(kpis, depts)
    per = k.groupBy("recorded_at", "department_name").agg(F.sum("value").alias("value"))
    return per.groupBy(F.col("recorded_at").alias("period")).agg(
        F.sum("value").alias("total_value"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("department_name", "value"))))
        .alias("department_breakdown"))


def timeline_long(kpis: DataFrame, depts: DataFrame) -> DataFrame:
    """A11 (long form): period, department_name, value."""
    k = with_department(kpis, depts)
    return k.groupBy(F.col("recorded_at").alias("period"), "department_name").agg(F.sum("value").alias("value"))


#: Sections of the dashboard's roll-up: what each is grouped by (of period, department id, department name, KPI).
ROLLUP_SECTIONS = {
    "department_kpi_day": ["period", "department_name", "kpi_name"],
    "kpi_day": ["period", "kpi_name"],
    "department_day": ["period", "department_name"],
    "day": ["period"],
    "kpi": ["kpi_name"],
    "department_kpi": ["department_id", "kpi_name"],
    "department": ["department_id"],
}
_ROLLUP_KEYS = ["period", "department_id", "department_name", "kpi_name"]


def dashboard_rollups(kpis: DataFrame, depts: DataFrame) -> DataFrame:
    """A9, A10, A11 and the counts of W4 in one pass: ``GROUPING SETS`` over one scan.

    Long form: ``section`` (a name of ``ROLLUP_SECTIONS``, told by its grouping
    id), the section's keys (the others null), ``value`` (sum), ``row_count``,
    ``anomaly_count`` (rows that are not NORMAL) and, for ``kpi`` rows,
    ``department_count`` (distinct non-null departments).  Only sums and counts
    are kept while grouping: hash aggregates, combined before each shuffle (by
    section, keys and department first, for the distinct count, then by section
    and keys), so a hot key costs a row per task.
    """
    k = with_department(kpis, depts).select(
        F.col("recorded_at").alias("period"), "department_id", "department_name", "kpi_name", "value",
        F.coalesce((F.col("status") != "NORMAL").cast("long"), F.lit(0)).alias("odd"))
    sets = [[F.col(c) for c in keys] for keys in ROLLUP_SECTIONS.values()]
    grouped = k.groupingSets(sets, *[F.col(c) for c in _ROLLUP_KEYS]).agg(
        F.grouping_id().alias("gid"), F.sum("value").alias("value"), F.count(F.lit(1)).alias("row_count"), F.sum("odd").alias("anomaly_count"), F.count_distinct("department_id").alias("departments"))
    number = {name: sum(0 if c in keys else 1 << (len(_ROLLUP_KEYS) - 1 - i) for i, c in enumerate(_ROLLUP_KEYS))
              for name, keys in ROLLUP_SECTIONS.items()}
    names = F.create_map(*[F.lit(x) for name, gid in number.items() for x in (gid, name)])
    section = names[F.col("gid").cast("int")]
    return grouped.select(section.alias("section"), *_ROLLUP_KEYS, "value", "row_count", "anomaly_count",
                          F.when(section == "kpi", F.col("departments")).alias("department_count"))


def department_summaries(depts: DataFrame, kpis: DataFrame, anomalies: DataFrame,
                         reports: DataFrame | None = None, n: int = 6, preview: int | None = None) -> DataFrame:
    """Per department the newest ``n`` KPI rows (``row_number <= n``, a
    partial WindowGroupLimit before the shuffle), its anomaly count, and the
    newest report's narrative (or its first ``preview`` characters) and date.  Long form: one row
    per (department, rank); departments without KPIs keep one row."""
    w = Window.partitionBy("department_id").orderBy(F.col("recorded_at").desc(), "kpi_name", "user_id")
    top = (kpis.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
           .select("department_id", "rank", "kpi_name", "recorded_at", "value", "status"))
    ac = anomalies.groupBy("department_id").agg(F.count(F.lit(1)).alias("anomaly_count"))
    d = depts.select(F.col("id").alias("department_id"), F.col("name").alias("department_name"))
    out = d.join(ac, "department_id", "left").withColumn("anomaly_count", F.coalesce("anomaly_count", F.lit(0)))
    if reports is not None:
        last = reports.groupBy("department_id").agg(
            F.max_by(F.struct("report_date", "narrative"), "report_date").alias("__r"))
        out = out.join(last, "department_id", "left").select(
            "*", (lambda t: t if preview is None else F.substring(t, 1, preview))(
                F.coalesce(F.col("__r.narrative"), F.lit(""))).alias("narrative_preview"),
            F.col("__r.report_date").alias("last_sync")).drop("__r")
    return out.join(top, "department_id", "left")


def department_directory(depts: DataFrame, roles: DataFrame, kpis: DataFrame, templates: DataFrame) -> DataFrame:
    """Departments ⟕ user counts ⟕ last report date ⟕ template config.
    Each right side is pre-aggregated to one row per department first."""
    users = roles.filter(F.col("department_id").isNotNull()).groupBy("department_id") \
        .agg(F.count_distinct("user_id").alias("user_count"))
    last = kpis.groupBy("department_id").agg(F.max("recorded_at").alias("last_report_date"))
    t = templates.select(F.col("id").alias("template_id"), F.col("config").alias("template_config"))
    d = depts.select(F.col("id").alias("department_id"), "name", "template_id", "heartbeat_schedule")
    return (d.join(users, "department_id", "left").join(last, "department_id", "left")
            .join(t, "template_id", "left")
            .withColumn("user_count", F.coalesce("user_count", F.lit(0))))


def user_directory(users: DataFrame, roles: DataFrame, depts: DataFrame) -> DataFrame:
    """Users ⟕ role ⟕ department name (equi-joins on user and department)."""
    d = depts.select(F.col("id").alias("department_id"), F.col("name").alias("department_name"))
    return users.join(roles, "user_id", "left").join(d, "department_id", "left")


def tenant_scope(df: DataFrame, roles: DataFrame, user_id) -> DataFrame:
    """J5 for one viewer: admins see every row; others see rows of their
    departments or rows they own.  The admin test is an uncorrelated scalar
    subquery; the department test a left join on the viewer's role rows."""
    mine = roles.filter(F.col("user_id") == F.lit(user_id))
    is_admin = mine.agg(F.max(F.when(F.col("role") == "admin", 1).otherwise(0))).scalar()
    depts = mine.filter(F.col("department_id").isNotNull()).select("department_id").distinct() \
        .withColumn("__hit", F.lit(True))
    j = df.join(depts, "department_id", "left")
    return j.filter((F.coalesce(is_admin, F.lit(0)) == 1) | F.col("__hit").isNotNull() |
                    (F.col("user_id") == F.lit(user_id))).drop("__hit")


def row_visibility(df: DataFrame, roles: DataFrame) -> DataFrame:
    """J5 for every row and viewer at once: ``df`` with ``visible_to`` (how many viewers see the row) and ``viewers``.

    ``viewers`` is an array of (bucket, bitmap): viewer v has bit
    ``bitmap_bit_position(v)`` of bucket ``bitmap_bucket_number(v)``, where v is
    the user id as a number.  A row is seen by admins, by the members of its
    department and by its owner, so all rows of one (department, owner) share
    their bitmaps: these are built by ``bitmap_construct_agg`` from the viewers
    of departments, the admins and the owners, without a pair of row and viewer,
    and joined to the rows.  ``sees`` tests one viewer.
    """
    kinds = df.select("department_id", "user_id").distinct()
    admins = roles.filter(F.col("role") == "admin").select(F.col("user_id").alias("__v")).distinct()
    members = roles.filter(F.col("department_id").isNotNull()).select("department_id", F.col("user_id").alias("__v")).distinct()
    known = roles.select(F.col("user_id").alias("__v")).distinct()
    by_department = kinds.join(members, "department_id").select("department_id", "user_id", "__v")
    by_owner = kinds.join(known, kinds["user_id"] == known["__v"]).select("department_id", "user_id", "__v")
    bit, bucket = F.bitmap_bit_position(F.col("__v").cast("bigint")), F.bitmap_bucket_number(F.col("__v").cast("bigint"))
    own = by_department.unionByName(by_owner).groupBy("department_id", "user_id", bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bitmap"))
    every = admins.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bitmap"))  # a row per 32,768 ids
    everywhere = kinds.withColumn("__all", every.agg(F.collect_list(F.struct("bucket", "bitmap"))).scalar()).select(
        "department_id", "user_id", F.inline("__all"))
    both = own.unionByName(everywhere).groupBy("department_id", "user_id", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    seen = both.groupBy(F.col("department_id").alias("__d"), F.col("user_id").alias("__u")).agg(
        F.sum(F.bitmap_count("bitmap")).alias("visible_to"), F.sort_array(F.collect_list(F.struct("bucket", "bitmap"))).alias("viewers"))
    same = df["department_id"].eqNullSafe(seen["__d"]) & df["user_id"].eqNullSafe(seen["__u"])
    return df.join(seen, same, "left").select(*[df[c] for c in df.columns], F.coalesce("visible_to", F.lit(0)).cast("bigint").alias("visible_to"), "viewers")


def sees(viewers, user_id: int):
    """Whether one viewer's bit is set in the ``viewers`` of ``row_visibility``."""
    number, place = F.bitmap_bucket_number(F.lit(int(user_id)).cast("bigint")), F.bitmap_bit_position(F.lit(int(user_id)).cast("bigint"))
    mine = F.filter(viewers, lambda x: x["bucket"] == number)
    byte = F.conv(F.hex(F.substring(F.get(mine, 0)["bitmap"], (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (F.size(mine) > 0) & (byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) > 0)


def visible_row_counts(df: DataFrame, roles: DataFrame) -> DataFrame:
    """J5 for every user at once: how many rows each user may see.

    No (user, row) pairs are formed: rows are pre-counted per department and
    per (owner, department); a user's count = admin ? all rows : Σ counts of
    their departments + their own rows outside those departments.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    per_dept = df.groupBy("department_id").agg(F.count(F.lit(1)).alias("n"))
    per_owner = df.groupBy("user_id", "department_id").agg(F.count(F.lit(1)).alias("n"))
    member = roles.filter(F.col("department_id").isNotNull()).select("user_id", "department_id").distinct()
    via_dept = member.join(per_dept, "department_id").groupBy("user_id").agg(F.sum("n").alias("__d"))
    own = per_owner.join(member, ["user_id", "department_id"], "left_anti").groupBy("user_id") \
        .agg(F.sum("n").alias("__o"))
    users = roles.groupBy("user_id").agg(F.max(F.when(F.col("role") == "admin", 1).otherwise(0)).alias("__admin"))
    out = users.join(via_dept, "user_id", "left").join(own, "user_id", "left")
    vis = F.when(F.col("__admin") == 1, total).otherwise(F.coalesce("__d", F.lit(0)) + F.coalesce("__o", F.lit(0)))
    return out.select("user_id", vis.cast("bigint").alias("visible_rows"))


def kpi_lineage(kpis: DataFrame, lineage: DataFrame, keys: list[str], order: list[str], n: int | None = None) -> DataFrame:
    """For every KPI row its source rows, or the first ``n`` by ``order``
    (join on ``keys``; ``row_number <= n`` per KPI is a partial WindowGroupLimit
    before the shuffle).  ``found`` = the number of source rows (the KPI's
    count falls back to it)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = lineage if n is None else lineage.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
    found = lineage.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
    return kpis.join(found, keys, "left").join(ranked, keys, "left")


def related_kpis(kpis: DataFrame, group: list[str], order: list[str], n: int = 20) -> DataFrame:
    """For every KPI row, up to ``n`` other KPI rows of the same group
    (department, date).  Each group keeps only its first ``n + 1`` rows
    (WindowGroupLimit), so the join emits at most ``n + 1`` partners per row —
    never all pairs of a large group."""
    w = Window.partitionBy(*group).orderBy(*order)
    head = kpis.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n + 1)
    rel = head.select(*group, *[F.col(c).alias(f"related_{c}") for c in order], "__rn",
                      F.col("value").alias("related_value"))
    me = kpis.select(*group, *order)
    j = me.join(rel, group)
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"related_{c}"))
    j = j.filter(~same)
    w2 = Window.partitionBy(*group, *order).orderBy("__rn")
    return j.withColumn("related_rank", F.row_number().over(w2)).filter(F.col("related_rank") <= n).drop("__rn")


def report_kpis(reports: DataFrame, kpis: DataFrame, fallback: int = 20) -> DataFrame:
    """Each report with the KPI rows of its date; a report with none gets
    the ``fallback`` newest KPI rows overall.  The fallback set is a bounded
    top-N (TakeOrdered) joined as a broadcast to the unmatched reports only."""
    k = kpis.withColumnRenamed("recorded_at", "report_date")
    matched = reports.join(k, "report_date", "inner").withColumn("fallback", F.lit(False))
    missing = reports.join(k.select("report_date").distinct(), "report_date", "left_anti")
    order = [F.col("recorded_at").desc(), "department_id", "user_id", "kpi_name"]
    newest = kpis.orderBy(*order).limit(fallback).withColumn("__rank", F.row_number().over(Window.orderBy(*order)))
    # each unmatched report fans out to ranks 1..n and meets the n newest rows
    # on an equi-join (the n-row side is broadcast: its size is the parameter)
    fb = (missing.withColumn("__rank", F.explode(F.sequence(F.lit(1), F.lit(fallback))))
          .join(F.broadcast(newest), "__rank").drop("__rank", "recorded_at").withColumn("fallback", F.lit(True)))
    return matched.unionByName(fb)


def template_list(templates: DataFrame, fields: DataFrame, depts: DataFrame) -> DataFrame:
    """Templates with their field count and department count (each side
    pre-aggregated to one row per template before the joins)."""
    fc = fields.groupBy("template_id").agg(F.count(F.lit(1)).alias("field_count"))
    dc = depts.groupBy("template_id").agg(F.count(F.lit(1)).alias("department_count"))
    t = templates.withColumnRenamed("id", "template_id")
    return (t.join(fc, "template_id", "left").join(dc, "template_id", "left")
            .select("template_id", F.coalesce("field_count", F.lit(0)).alias("field_count"),
                    F.coalesce("department_count", F.lit(0)).alias("department_count")))
