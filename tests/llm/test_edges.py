"""Defined edge cases: clashing column names, repeated rows, empty tables."""

import random

from pyspark.sql import functions as F

from autokpi.llm import forest, line_dedup, mixing, near_dup, url_rules


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def test_near_dup_with_clashing_columns(spark):
    rng = random.Random(1)
    texts = [prose(rng, 30) for _ in range(6)]
    rows = [(i, t, 1, "k", 2) for i, t in enumerate(texts)] + [(6, texts[0], 1, "k", 2), (None, texts[1], 1, "k", 2), (3, texts[3], 1, "k", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __rows int, __keep string, id int")
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [0, 1, 2, 3, 4, 5, None]


def test_line_dedup_with_clashing_columns(spark):
    rng = random.Random(2)
    line = prose(rng, 12)
    docs = spark.createDataFrame([(1, line + "\n" + prose(rng, 12), 5, 6, 7), (2, line, 5, 6, 7), (None, line, 5, 6, 7)],
                                 "doc_id long, text string, __doc int, __lines int, copy int")
    got = {r.doc_id: r.lines_removed for r in line_dedup.drop_repeated_lines(docs, most_bits=None).collect()}
    assert got == {1: 0, 2: 1, None: 0}


def test_forest_of_an_empty_table(spark):
    rows = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert forest.nearest(rows, rows).count() == 0


def test_url_rules_of_repeated_rows_and_an_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://a.example.org/es/x"), (1, "http://a.example.org/es/x"), (None, None), (2, "no scheme")], "page_id long, url string")
    got = sorted(((r.page_id, r.rule, r.verdict) for r in url_rules.judge(pages, url_rules.rule_table(spark)).collect()), key=str)
    assert got == sorted([(1, "example.org/es/", "block")] * 2 + [(None, None, "allow"), (2, None, "allow")], key=str)
    assert url_rules.judge(pages.limit(0), url_rules.rule_table(spark)).count() == 0


def test_mix_of_repeated_rows(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(1, 20)), "ab"[i % 2]) for i in range(40)]
    docs = spark.createDataFrame(rows + rows[:10] + rows[:10], "doc_id long, text string, source string")
    report = mixing.mix_report(docs, mixing.cycled_weights(docs, [3, 1, 2]))
    first, again = (sorted(map(tuple, report.collect()), key=str) for _ in range(2))
    assert first == again and len(first) == 60
    by = report.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") - 2 * F.col("size")).alias("over"))
    assert all(abs(r.taken - r.target) <= 20 and r.over <= 0 for r in by.collect())
