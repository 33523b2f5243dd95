"""One registered query per operator, with its DuckDB oracle where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from autokpi.llm import (bpe_replay, decontaminate, forest, license_scan, line_dedup, mixing, near_dup, periodic_runs,
                         pipelined_search, quality, token_shards, toxicity, url_rules)
from autokpi.llm.frames import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MIX_WEIGHTS = [3, 1, 2]


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


_WORDS = r"regexp_extract_all(lower(text), '(?:[a-z0-9]|[^\x00-\x7F])+')"


@register("op1_decontaminate", rf"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) AS s FROM dw WHERE len(w) >= 5)),
isx AS (SELECT DISTINCT item_id, s FROM (SELECT item_id, unnest([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) AS s FROM iw WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS item_shingles FROM isx GROUP BY 1),
hit AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN isx USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment
FROM hit JOIN n USING (item_id) WHERE shared >= 0.8 * item_shingles - 1e-9""")
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair whose exact shingle containment reaches 0.8."""
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op2_mix_sources", rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0)::BIGINT AS size,
                  md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
b AS (SELECT *, 2 * source_size / weight AS full_at FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY full_at, source ASC NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
          sum(weight) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM b),
t AS (SELECT source, source_size, weight, least(2.0::DOUBLE * source_size, coalesce(weight * (max(CASE WHEN lev <= full_at THEN lev END) OVER ()),
          2.0::DOUBLE * source_size)) AS target FROM l),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT doc_id, size, source_size, target,
       (size * ((start + size / 2 <= target)::INT + (source_size + start + size / 2 <= target)::INT))::BIGINT AS taken,
       CASE WHEN start + size / 2 <= target THEN (start + size) / weight END AS finish
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source""")
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents to the weights 3, 1, 2 and 150 % of all words takes of each."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_report(docs, mixing.cycled_weights(docs, MIX_WEIGHTS))


@register("op3_near_dup")
def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dup.near_duplicate_classes(table(spark, sf_dir, "documents"))


def _license_oracle() -> str:
    quote = lambda x: x.replace("'", "''")

    stated = (r"(?m)^[ \t]*((copyright|copr\.?|\(c\)|©)[ \t]*[:,]?[ \t]*(\(c\)|©|[12][0-9]{3}|[\[<{(]?(yyyy|year)|by[ \t]|copyright)[^\n]*"
              r"|all rights reserved\.?[ \t]*)$")
    same = [("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("&", " and "), ("http://", "https://"),
            ("favour", "favor"), ("judgement", "judgment"), ("fulfil ", "fulfill ")]

    def lined(expr: str) -> str:
        out = f"regexp_replace(lower({expr}), '{stated}', '', 'g')"
        for old, new in same:
            out = f"replace({out}, '{old}', '{new}')"
        return f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"

    whole = "trim(regexp_replace(t, '[ \\n]+', ' ', 'g'))"
    known = ", ".join(f"('{a}', '{quote(b)}')" for a, b in license_scan.KNOWN)
    digests = ", ".join(f"('{a}', '{b}')" for a, b in license_scan.KNOWN_DIGESTS)
    return f"""
WITH known AS (SELECT DISTINCT license, sha256({whole}) AS digest FROM (SELECT license, {lined('txt')} AS t FROM (VALUES {known}) v(license, txt))
  UNION SELECT * FROM (VALUES {digests}) w(license, digest)),
c AS (SELECT doc_id, {lined('text')} AS t FROM documents),
u AS (SELECT doc_id, 'text' AS scope, {whole} AS x FROM c
      UNION ALL SELECT doc_id, 'line', trim(x) FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM c)),
h AS (SELECT doc_id, scope, license FROM u JOIN known ON sha256(x) = digest WHERE x <> ''),
g AS (SELECT doc_id, string_agg(DISTINCT CASE WHEN scope = 'text' THEN license END, '|' ORDER BY CASE WHEN scope = 'text' THEN license END) AS license,
             string_agg(DISTINCT CASE WHEN scope = 'line' THEN license END, '|' ORDER BY CASE WHEN scope = 'line' THEN license END) AS notices,
             sum((scope = 'line')::BIGINT)::BIGINT AS notice_lines FROM h GROUP BY 1)
SELECT d.doc_id, g.license, g.notices, coalesce(g.notice_lines, 0)::BIGINT AS notice_lines
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id"""


@register("op4_license_scan", _license_oracle())
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that a document is, or that one of its lines states, by canonical digest."""
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.known_digests(spark))


@register("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fuzzy repeated lines each document loses, and the digest of what stays."""
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), most_bits=None)
    return out.select("doc_id", "lines_removed", F.length("text").cast("long").alias("chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity score of every document, with its nearest labelled examples."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from weak labels, and whether it is kept."""
    return quality.quality_scores(table(spark, sf_dir, "documents"))


@register("op8_token_shards")
def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the written shards, read back: slot, sequence, its documents and where they start, token digest."""
    folder = token_shards.shared_folder(spark, "op8")
    written = stored(token_shards.write_shards(table(spark, sf_dir, "documents"), folder))
    return shard_digests(spark, written, folder)


def shard_digests(spark: SparkSession, written: DataFrame, folder: str) -> DataFrame:
    """(slot, shard, seq, doc_id, bytes, crc32, doc_ids, starts) of the records of written shards."""
    if written.isEmpty():
        return spark.createDataFrame(
            [], "slot long, shard int, seq long, doc_id long, bytes int, crc32 long, doc_ids array<long>, starts array<int>")
    read = token_shards.read_shards(spark, folder).select(
        "slot", "shard", "seq", "doc_id", F.octet_length("tokens").alias("bytes"), F.crc32("tokens").alias("crc32"))
    return read.join(written.select(F.inline("sequences")), "slot", "left")


@register("op9_forest")
def op9_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every vector whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    return forest.nearest(rows, rows.where("vec_id % 100 = 0")).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _url_oracle() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_rules.RULES)
    return rf"""
WITH r(rhost, rpath, rverdict) AS (VALUES {rules}),
p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
             CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
best AS (SELECT host, path, max({{'n': length(rhost) + length(rpath), 'h': length(rhost), 'rule': rhost || rpath, 'v': rverdict}}) AS b
         FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1, 2)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.v, 'allow') AS verdict FROM p LEFT JOIN best USING (host, path)"""


@register("op10_url_rules", _url_oracle())
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest fitting host and path rule of every page's url, and its verdict."""
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rule_table(spark))


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that the query on periodic runs searches: one document in ten, by a checksum of its id, gets a periodic tail.

    A null id leaves the words as they are.
    """
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a:a + p]
    return words[:a] + (tail * (-(-(n - a) // len(tail))))[:n - a]


@register("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document: how many, the longest, digests of all and of the collapsed words."""
    return periodic_runs.run_digests(periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), periodic_tail))


BPE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@register("op12_bpe_codec")
def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE tokens of every whole document, and the text that they decode to."""
    encoded = bpe_replay.encode(table(spark, sf_dir, "documents"), BPE_VOCABULARY)
    return bpe_replay.token_digests(bpe_replay.decode(encoded, BPE_VOCABULARY))


def _search_oracle() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = f"unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '{pipelined_search.TERM}')) AS t"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
p AS (SELECT r, doc_id, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, {terms} FROM d) GROUP BY 1, 2, 3),
ln AS (SELECT r, sum(tf)::BIGINT AS n FROM p GROUP BY 1),
s AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM ln),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY t, nn),
i AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, {terms} FROM benchmark)),
sc AS (SELECT item_id, r, doc_id, sum(w * ((1000000000::BIGINT * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score
       FROM i JOIN w USING (t) JOIN p USING (t) JOIN ln USING (r), s GROUP BY 1, 2, 3)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INT AS rank FROM sc WHERE score > 0)
WHERE rank <= 50"""


@register("op13_lexical_search", _search_oracle())
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents of highest score for every benchmark item."""
    return pipelined_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
