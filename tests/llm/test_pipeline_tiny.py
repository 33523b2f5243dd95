"""The whole pipeline on tiny tables, against what each stage must keep."""

import hashlib
import random

import pyarrow.parquet as pq
import pytest

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(["of", "the", "a", "is", "in"]) if rng.random() < 0.4 else "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8)))
                    for _ in range(n))


def tables(spark, folder, rows, items):
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_keep_clean_documents_and_drop_the_rest(spark, tmp_path):
    rng = random.Random(21)
    clean = [(i, prose(rng, 120), "s") for i in range(40)]
    item = prose(rng, 30)
    junk = [(100 + i, "!! ".join(prose(rng, 40).split()).upper(), "s") for i in range(6)] + [(110, None, "s"), (111, "", "s")]
    words = clean[0][1].split()
    near = words[:60] + ["changed"] + words[61:]
    copies = [(200, clean[1][1], "s"), (201, clean[2][1].replace(" ", ",  ") + ".", "s"), (202, " ".join(near), "s")]
    leaked = [(300, prose(rng, 60) + " " + item + " " + prose(rng, 50), "s")]
    rows = clean + junk + copies + leaked + [(5, clean[5][1], "s"), (None, prose(rng, 100), "s")]
    tables(spark, str(tmp_path), rows, [(1, item), (2, None), (3, "")])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-dedup", "decontamination", "source mix", "token shards"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept.append(sorted((r.doc_id for r in docs.collect()), key=lambda x: (x is None, x)))
    good = [i for i, *_ in clean]
    assert [i for i in kept[0] if i is not None and 100 <= i < 200] == []
    assert set(good) | {200, 201, 202, 300, None} == set(kept[0])
    assert [i for i in kept[1] if i is not None] == good + [300] and kept[1].count(None) == 1
    assert [i for i in kept[2] if i is not None] == good
    assert set(kept[3]) == set(kept[2]) and len(kept[3]) > len(kept[2])  # 150 % of the words of one source
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    owners = {i for r in got for i in r.doc_ids}
    assert set(good) <= owners and not owners & {100, 200, 201, 202, 300}
    assert sorted(r.slot for r in got) == list(range(len(got)))


@pytest.mark.parametrize("rows", [[], [(1, None, None), (None, "", "s")]])
def test_tables_without_text_give_no_shards(spark, tmp_path, rows):
    tables(spark, str(tmp_path), rows, [(1, "one two three four five six")])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mix_is_stored_in_queue_order(spark, tmp_path):
    rng = random.Random(22)
    rows = [(i, prose(rng, rng.randint(5, 40)), "xyyzzzz"[i % 7]) for i in range(140)]
    tables(spark, str(tmp_path), rows, [(1, "one two three four five six")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/mixed")
    got = [i for f in sorted((tmp_path / "mixed").glob("part-*.parquet")) for i in pq.read_table(f)["doc_id"].to_pylist()]
    weight, words = {"x": 3, "y": 1, "z": 2}, {i: len(t.split()) for i, t, _ in rows}
    queues = {s: sorted((i for i, _, of in rows if of == s), key=lambda i: hashlib.md5(f"mix-1|{i}".encode()).hexdigest()) for s in weight}
    size = {s: sum(words[i] for i in q) for s, q in queues.items()}
    low, high = 0.0, 1e6  # the level at which the targets make 150 % of the words
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(weight[s] * level, 2 * size[s]) for s in size) < 1.5 * sum(size.values()) else (low, level)
    want = []
    for s, queue in queues.items():
        at = 0
        for i in queue * 2:
            if at + words[i] / 2 <= min(weight[s] * level, 2 * size[s]) + 1e-6:
                want.append(((at + words[i]) / weight[s], i))
            at += words[i]
    finish = [x for x, _ in sorted(want)]
    assert len(set(finish)) > 100 and sorted(i for _, i in want) == sorted(got)
    assert got != sorted(got) and {(x, i) for x, i in want} == set(zip(finish, got))
