"""Every document is named by each sequence that holds one of its tokens."""

import random
import uuid

import numpy as np
from pyspark.sql import functions as F

from autokpi.llm import token_shards
from autokpi.llm.queries import shard_digests


def test_sequences_name_all_their_documents(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.choice([0, 3, 30, 300]))) for _ in range(80)] + [None]
    rows = [(i // 2, t) for i, t in enumerate(texts)]  # every id twice, as a mix repeats documents
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).checkpoint()
    folder = str(tmp_path / uuid.uuid4().hex)
    written = token_shards.write_shards(docs, folder, sequence=64, shard_slots=16)
    named = {r.slot: r for r in written.select(F.inline("sequences")).collect()}
    read = sorted(token_shards.read_shards(spark, folder, sequence=64, shard_slots=16).collect(), key=lambda r: r.seq)
    assert sorted(named) == sorted(r.slot for r in read)
    coder = token_shards.coder(token_shards.TOKENIZER).coder
    want, at = [([], []) for _ in read], 0
    for r in docs.withColumn("p", F.spark_partition_id()).collect():
        size = len(coder.encode_ordinary(r.text or "")) + 1
        for seq in range(at // 64, (at + size - 1) // 64 + 1):
            want[seq][0].append(r.doc_id)
            want[seq][1].append(at - seq * 64 if at >= seq * 64 else -1)
        at += size
    assert [(named[r.slot].doc_ids, named[r.slot].starts) for r in read] == want
    assert all(named[r.slot].doc_ids[0] == r.doc_id for r in read) and sum(s.count(-1) for _, s in want) > 5


def test_digests_name_every_document(spark, tmp_path):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text")).repartition(3).checkpoint()
    folder = str(tmp_path / uuid.uuid4().hex)
    got = shard_digests(spark, token_shards.write_shards(docs, folder).checkpoint(), folder).collect()
    assert sorted({d for r in got for d in r.doc_ids}) == list(range(500)) and len(got) < 10
    assert np.all([len(r.doc_ids) == len(r.starts) for r in got])
