"""URL filter rules by a sort-merge range join; DataFrame functions only.

A rule is a host and a path prefix.  It fits its host and all subdomains if the
path starts with its path; of several the longest (host plus path) wins, then
the longer host.  With the host's labels reversed (``example.org`` becomes
``org.example.``) the hosts under a rule are one interval of keys, and rules of
the same path form nested intervals.

1. Urls are reduced to distinct (host, path prefix) probes, one for each rule
   path that the url's path starts with; a url without any needs no probe.
2. Rules and probes are sorted together by (rule path, reversed host), range-
   partitioned with a tie-breaker, so a common host is not one task.
3. A sweep down each partition carries the stack of the rule that opened last:
   itself and the rules around it.  A rule that opened in an earlier partition
   is carried in by one row per partition.  The probe's rule is the innermost
   stack entry whose interval still holds the probe's key.
4. Probes join back to their urls and the longest rule gives the verdict.

Defined cases: a null url or one without ``://`` has an empty host and path and
fits no rule with a host; without a fitting rule the verdict is ``allow`` and
the rule null; repeated rows are each judged; an empty rule table allows all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from autokpi.llm.frames import stored

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def reversed_host(host: Column) -> Column:
    """Labels from the last to the first, each followed by a dot."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _stacks(rules: DataFrame) -> DataFrame:
    """Rules with their reversed host ``key`` and the ``stack`` of rules of the same path around them.

    A host's enclosing hosts are its own suffixes, so the stack is found by an
    equi-join over at most as many rows as the host has labels.
    """
    r = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict")
    r = r.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # a rule stated twice: block beats allow
    r = r.select("path", reversed_host(F.col("host")).alias("key"), F.concat("host", "path").alias("rule"), "verdict",
                 F.length("host").alias("host_len"))
    labels = F.split("key", r"\.")
    ends = F.sequence(F.lit(0), F.size(labels) - 1)
    up = r.select("path", "key", F.explode(F.transform(ends, lambda n: F.when(n == 0, "").otherwise(
        F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit("."))))).alias("outer"))
    own = r.select("path", F.col("key").alias("outer"), "rule", "verdict", "host_len")
    stack = F.array_sort(F.collect_list(F.struct("host_len", F.col("outer").alias("key"), "rule", "verdict")))
    return up.join(own, ["path", "outer"]).groupBy("path", "key").agg(stack.alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow",
          partitions: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict): one row per row of ``pages``."""
    spark = pages.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    u = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url).cast("string")).alias("host"),
                     path_of(F.col(url).cast("string")).alias("path"))
    stacks = _stacks(rules)
    paths = stacks.select(F.col("path").alias("rule_path")).distinct()
    lengths = F.array_sort(F.collect_set(F.length("rule_path")))
    lengths = [n for n in (paths.agg(lengths.alias("n")).first().n or [])]  # one number per distinct rule-path length
    cuts = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array(F.lit(None).cast("string"))
    cuts = F.filter(cuts, lambda c: c.isNotNull())
    probes = (u.select("host", F.explode(cuts).alias("rule_path")).distinct()
              .join(paths, "rule_path", "left_semi")
              .select("rule_path", "host", reversed_host(F.col("host")).alias("key")))
    kind = "array<struct<host_len:int,key:string,rule:string,verdict:string>>"
    events = probes.select("rule_path", "key", F.lit(1).alias("turn"), "host", F.lit(None).cast(kind).alias("opened")).unionAll(
        stacks.select(F.col("path").alias("rule_path"), "key", F.lit(0).alias("turn"), F.lit(None).cast("string").alias("host"),
                      F.col("stack").cast(kind).alias("opened")))
    order = ["rule_path", "key", "turn", "host"]
    swept = stored(events.repartitionByRange(partitions, *order).withColumn("part", F.spark_partition_id()))
    down = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = swept.withColumn("here", F.last(F.when(F.col("turn") == 0, F.struct("rule_path", "opened")), ignorenulls=True).over(down))
    last = stored(swept.where("turn = 0").groupBy("part").agg(F.max(F.struct("rule_path", "key", "opened")).alias("m")))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = spark.range(partitions).select(F.col("id").cast("int").alias("part")).join(last, "part", "left")
    carried = parts.select("part", F.last("m", ignorenulls=True).over(earlier).alias("carry"))
    stack = F.coalesce("here", F.struct(F.col("carry.rule_path").alias("rule_path"), F.col("carry.opened").alias("opened")))
    found = swept.where("turn = 1").join(carried, "part").withColumn("top", stack)
    open_here = F.filter(F.when(F.col("top.rule_path") == F.col("rule_path"), F.col("top.opened")),
                         lambda s: F.col("key").startswith(s["key"]))
    found = found.select("host", "rule_path", F.try_element_at(open_here, F.lit(-1)).alias("best")).where("best is not null")
    per_host = found.groupBy("host").agg(F.collect_list(F.struct(
        F.length("best.rule").alias("n"), F.col("best.host_len").alias("host_len"), "rule_path",
        F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))).alias("found"))
    fits = F.filter("found", lambda s: F.col("path").startswith(s["rule_path"]))
    best = F.array_max(fits)
    return (u.join(per_host, "host", "left").withColumn("best", best)
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
