"""Sources (S1, S2, S3, S10, S11).

* ``read_source``: JDBC (PostgreSQL, MySQL, Oracle, SQLite, SQL Server, or
  any JDBC URL such as embedded Derby) with partitioned parallel reads, or
  files (Parquet, CSV, JSON).  Filters, projections and aggregates on the
  result are pushed into the source by Spark's JDBC / Parquet readers.
* ``read_documents``: document collections (JSON) reduced to KPI rows.
* ``run_sql``: a user's read-only query over registered tables, capped.
* ``ingest_summary``: department summary documents -> combined-report rows.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autokpi.functions.core import lenient_timestamp

# JDBC driver classes per dialect.
JDBC_DRIVERS = {
    "postgresql": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "oracle": "oracle.jdbc.OracleDriver",
    "sqlite": "org.sqlite.JDBC",
    "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "derby": "org.apache.derby.jdbc.EmbeddedDriver",
}


def detect_dialect(url: str | None, explicit: str | None = None) -> str:
    """Dialect from an explicit type, else from the URL text (default postgresql)."""
    if explicit:
        e = explicit.lower().strip()
        return "sqlserver" if e in {"sqlserver", "mssql", "microsoft sql server"} else e
    u = (url or "").lower().strip()
    if not u:
        return "postgresql"
    for key, name in (("derby", "derby"), ("sqlite", "sqlite"), ("oracle", "oracle"), ("mysql", "mysql"),
                      ("mariadb", "mysql"), ("mssql", "sqlserver"), ("sqlserver", "sqlserver")):
        if key in u:
            return name
    return "postgresql"


def jdbc_target(url: str, dialect: str) -> tuple[str, str | None, str | None]:
    """(JDBC URL, user, password) of a connection string.

    Connection strings name a library's driver after the dialect
    (``mysql+pymysql://``) and carry ``user:password@`` (percent-encoded), which
    JDBC drivers take as options; a JDBC URL stays as it is.  SQL Server and
    Oracle have URL forms of their own; a SQLite path stays relative unless it
    starts with ``//`` after the empty host.  Without ``://`` the text is a host and path.
    """
    u = url.strip()
    if u.lower().startswith("jdbc:"):
        return u, None, None
    if dialect == "sqlite":
        path = u.split(":///", 1)[1] if ":///" in u else u.split("://", 1)[-1]
        return f"jdbc:sqlite:{path}", None, None
    parts = urlsplit(u if "://" in u else f"{dialect}://{u}")
    user, password = (None if x is None else unquote(x) for x in (parts.username, parts.password))
    place = parts.netloc.rsplit("@", 1)[-1]
    query = f"?{parts.query}" if parts.query else ""
    name = parts.path.lstrip("/")
    if dialect == "sqlserver":
        options = [x for x in parts.query.split("&") if x and not x.lower().startswith("driver=")]
        return f"jdbc:sqlserver://{place}" + "".join(f";{x}" for x in ([f"databaseName={name}"] if name else []) + options), user, password
    if dialect == "oracle":
        service = next((x.split("=", 1)[1] for x in parts.query.split("&") if x.lower().startswith("service_name=")), name)
        return f"jdbc:oracle:thin:@//{place}/{service}", user, password
    scheme = {"postgresql": "postgresql", "mysql": "mysql"}.get(dialect, parts.scheme.split("+")[0])
    return f"jdbc:{scheme}://{place}{parts.path}{query}", user, password


def jdbc_url(url: str, dialect: str) -> str:
    """The JDBC URL of a connection string, without its user and password."""
    return jdbc_target(url, dialect)[0]


def read_source(spark: SparkSession, spec: dict) -> DataFrame:
    """Read one table.

    ``spec``: ``format`` ('jdbc', 'parquet', 'csv', 'json'; default parquet),
    ``path`` for files, or ``url`` + ``table`` (or ``query``) for JDBC,
    optional ``type`` (dialect), ``user``, ``password``, ``options`` and, for a
    parallel JDBC read, ``partition_column`` + ``lower_bound`` +
    ``upper_bound`` + ``num_partitions`` (each partition is one range query;
    without them the whole table comes through one connection).
    """
    fmt = (spec.get("format") or "parquet").lower()
    opts = dict(spec.get("options") or {})
    if fmt != "jdbc":
        reader = spark.read.format(fmt).options(**opts)
        if fmt == "csv":
            reader = reader.option("header", opts.get("header", "true"))
        if spec.get("schema"):
            reader = reader.schema(spec["schema"])
        return reader.load(spec["path"])
    dialect = detect_dialect(spec.get("url"), spec.get("type"))
    target, user, password = jdbc_target(spec["url"], dialect)
    spec = {"user": user, "password": password} | {k: v for k, v in spec.items() if v is not None}
    reader = spark.read.format("jdbc").option("url", target)
    if dialect in JDBC_DRIVERS and "driver" not in opts:
        reader = reader.option("driver", JDBC_DRIVERS[dialect])
    if spec.get("query"):
        reader = reader.option("query", spec["query"])
    else:
        reader = reader.option("dbtable", spec["table"])
    for k in ("user", "password"):
        if spec.get(k):
            reader = reader.option(k, spec[k])
    if spec.get("partition_column"):
        reader = (reader.option("partitionColumn", spec["partition_column"])
                  .option("lowerBound", str(spec["lower_bound"])).option("upperBound", str(spec["upper_bound"]))
                  .option("numPartitions", str(spec.get("num_partitions", 8))))
    reader = reader.option("fetchsize", str(opts.pop("fetchsize", 10000)))
    return reader.options(**opts).load()


def jdbc_catalog(spark: SparkSession, name: str, url: str, type: str | None = None, user: str | None = None,
                 password: str | None = None, options: dict | None = None) -> None:
    """S1 with full push-down: register a JDBC source as a DataSource V2
    catalog, so ``spark.table(f"{name}.<schema>.<table>")`` pushes filters,
    column pruning, aggregates (``SUM ... GROUP BY``), limits and top-N into the
    source database — the in-source daily aggregation of the extraction step,
    without writing dialect SQL.  Session configuration only; read-only use."""
    dialect = detect_dialect(url, type)
    prefix = f"spark.sql.catalog.{name}"
    spark.conf.set(prefix, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
    target, own_user, own_password = jdbc_target(url, dialect)
    user, password = user or own_user, password or own_password
    spark.conf.set(f"{prefix}.url", target)
    if dialect in JDBC_DRIVERS:
        spark.conf.set(f"{prefix}.driver", JDBC_DRIVERS[dialect])
    for k, v in (("user", user), ("password", password)):
        if v:
            spark.conf.set(f"{prefix}.{k}", v)
    opts = {"pushDownAggregate": "true", "pushDownLimit": "true", "pushDownOffset": "true", **(options or {})}
    for k, v in opts.items():
        spark.conf.set(f"{prefix}.{k}", str(v))


# Fixed value: the date-like name hints of document collections.
DOC_DATE_HINTS = ("date", "time", "at")


def document_kpis(collection: str, df: DataFrame, sample: int | None = None) -> DataFrame | None:
    """S2 for one collection: the first date-like column (name contains
    date/time/at) and the first other column whose values coerce to numbers
    for >= max(3, 50 %) of the rows -> rows (date, value, kpi_name =
    'collection.column').  ``sample`` caps the documents read (the reference
    reads 100); default: all.  One aggregate decides the column (driver reads
    one row); ``None`` when the collection has no usable pair."""
    if sample is not None:
        df = df.limit(sample)
    cols = df.columns
    date_col = next((c for c in cols if any(h in c.lower() for h in DOC_DATE_HINTS)), None)
    if date_col is None:
        return None
    others = [c for c in cols if c != date_col]
    if not others:
        return None
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.count(F.col(f"`{c}`").cast("string").try_cast("double")).alias(f"c{i}") for i, c in enumerate(others)]
    st = df.agg(*aggs).first()
    n = st["__n"]
    num = [c for i, c in enumerate(others) if st[f"c{i}"] >= max(3, n * 0.5)]
    if not num:
        return None
    v = num[0]
    return df.select(F.col(f"`{date_col}`").alias("date"),
                     F.col(f"`{v}`").cast("string").try_cast("double").alias("value"),
                     F.lit(f"{collection}.{v}").alias("kpi_name"))


def read_documents(spark: SparkSession, collections: dict, sample: int | None = None) -> DataFrame:
    """Every collection (name -> DataFrame or JSON path) reduced to KPI
    rows and unioned (U1).  Empty frame when no collection qualifies."""
    frames = []
    for name, src in collections.items():
        df = spark.read.json(src) if isinstance(src, str) else src
        k = document_kpis(name, df, sample)
        if k is not None:
            frames.append(k.select(lenient_timestamp(F.col("date"), k.schema["date"].dataType).alias("date"),
                                   "value", "kpi_name"))
    if not frames:
        return spark.createDataFrame([], "date timestamp_ntz, value double, kpi_name string")
    return reduce(lambda a, b: a.unionByName(b), frames)


# What a read-only query may be made of, as the analysed plan names it.
_QUERY_NODES = {
    "Project", "Filter", "Aggregate", "Join", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Deduplicate", "Union",
    "Intersect", "Except", "Window", "WithCTE", "CTERelationDef", "CTERelationRef", "SubqueryAlias", "View", "Generate", "Expand",
    "Sample", "LateralJoin", "UnionLoop", "UnionLoopRef", "ResolvedHint", "OneRowRelation", "LocalRelation", "ResolvedInlineTable", "Range", "UnresolvedSubqueryColumnAliases",
}
# Expressions that reach outside the query.
_BARRED_EXPRESSIONS = {
    "CallMethodViaReflection", "TryReflect", "ScalaUDF", "PythonUDF", "PythonUDAF", "HiveSimpleUDF", "HiveGenericUDF", "HiveUDAFFunction",
    "InputFileName", "InputFileBlockStart", "InputFileBlockLength", "CurrentUser", "CurrentDatabase", "CurrentCatalog", "SparkVersion",
}
# Expressions that hold a plan of their own.
_SUBQUERIES = {"ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"}


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None, limit: int | None = None) -> DataFrame:
    """Run a read-only query over the given tables; all rows, or ``limit``.

    The text is analysed in a session of its own, which knows only ``tables``
    (as temporary views that end with it), and the analysed plan is walked: every
    node must be one that queries are made of, every relation one of the given
    views, and no expression may call into the JVM, run a registered function
    or tell about files and users.  So commands, paths, tables of the catalog and
    several statements are refused by what they mean; a column called
    ``created_at`` or an alias with the name of a table is fine (D17).
    """
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            session.conf.set(key, value)
    given = tables or {}
    for name, df in given.items():
        handed = f"handed_{uuid.uuid4().hex}"
        df.createGlobalTempView(handed)
        try:
            session.table(f"global_temp.{handed}").createOrReplaceTempView(name)
        finally:
            spark.catalog.dropGlobalTempView(handed)
    text = sql.strip().rstrip(";")
    state = session._jsparkSession.sessionState()
    _check_plan(state.analyzer().execute(state.sqlParser().parsePlan(text)), {n.lower() for n in given})
    out = session.sql(text)
    return out if limit is None else out.limit(int(limit))


def _items(scala_seq) -> list:
    return [scala_seq.apply(i) for i in range(scala_seq.size())]


def _check_plan(plan, views: set[str]) -> None:
    """Refuse an analysed plan that is no query over ``views`` alone."""
    kind = plan.getClass().getSimpleName().rstrip("$")
    if kind not in _QUERY_NODES:
        raise ValueError(f"Unknown table: {plan.name()}" if kind == "UnresolvedRelation" else f"Not allowed in a query: {kind}")
    if kind == "View":
        name = plan.desc().identifier()
        if name.database().isDefined() or name.table().lower() not in views:
            raise ValueError(f"Unknown table: {name.unquotedString()}")
        return
    for expression in _items(plan.expressions()):
        _check_expression(expression, views)
    for child in _items(plan.children()):
        _check_plan(child, views)


def _check_expression(expression, views: set[str]) -> None:
    kind = expression.getClass().getSimpleName()
    if kind in _BARRED_EXPRESSIONS:
        raise ValueError(f"Not allowed in a query: {kind}")
    if kind in _SUBQUERIES:
        _check_plan(expression.plan(), views)
    for child in _items(expression.children()):
        _check_expression(child, views)


SUMMARY_SCHEMA = T.StructType([
    T.StructField("department", T.StringType()),
    T.StructField("report_date", T.StringType()),
    T.StructField("kpis", T.ArrayType(T.StructType([T.StructField("kpi_name", T.StringType()),
                                                    T.StructField("value", T.DoubleType())]))),
    T.StructField("validation", T.MapType(T.StringType(), T.StringType())),
    T.StructField("narrative", T.StringType()),
])


def ingest_summary(payloads: DataFrame, col: str = "payload", today=None, keep: list[str] = ()) -> DataFrame:
    """Department summary documents -> combined-report rows.

    ``report_date`` defaults to ``today`` (default: the current date);
    ``combined_kpis`` = kpi -> value map; narrative defaults to
    'Ingested summary for <department> on <date>.'  One projection."""
    p = payloads.select(F.from_json(F.col(col), SUMMARY_SCHEMA).alias("p"), *keep).select("p.*", *keep)
    day = F.coalesce(F.col("report_date"), (F.current_date() if today is None else F.lit(today).cast("date"))
                     .cast("string"))
    kp = F.filter(F.coalesce(F.col("kpis"), F.array().cast(SUMMARY_SCHEMA["kpis"].dataType)),
                  lambda k: k["kpi_name"].isNotNull())
    # a repeated KPI name keeps its last value (later entries win, as in a dict)
    last = F.filter(kp, lambda k, i: ~F.exists(F.slice(kp, i + 2, F.greatest(F.size(kp) - i - 1, F.lit(0))),
                                               lambda x: x["kpi_name"] == k["kpi_name"]))
    return p.select(
        "department", day.alias("report_date"),
        F.map_from_entries(F.transform(last, lambda k: F.struct(k["kpi_name"], k["value"]))).alias("combined_kpis"),
        F.coalesce(F.col("narrative"), F.concat(F.lit("Ingested summary for "), F.col("department"), F.lit(" on "),
                                                day, F.lit("."))).alias("narrative"), *keep)
