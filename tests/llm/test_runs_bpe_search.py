"""Periodic runs, merge replay and pipelined search against brute force and their defined edge cases."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from autokpi.llm import bpe_replay, periodic_runs, pipelined_search
from autokpi.llm.queries import BPE_VOCABULARY, QUERIES, periodic_tail

SF_SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, row string, term string, ids string"


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, "r", "t", "x") for i, t in pairs], DOCS)


def brute_runs(words):
    """Every run, one period after the other."""
    ids = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if words else np.zeros(0, dtype=int)
    n, out = len(ids), {}
    for q in range(1, n // 2 + 1):
        same = np.concatenate(([False], ids[q:] == ids[:-q], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for a, b in edge.tolist():
            if b - a + q >= max(12, 2 * q):
                out.setdefault((a, b - a + q), q)  # the smallest period of a stretch comes first
    runs = [(s, m, q) for (s, m), q in out.items()]
    return sorted((s, m, q) for s, m, q in runs if not any((ids[s:s + m - p] == ids[s + p:s + m]).all() for p in range(1, q)))


def brute_row(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + math.floor((n - a) / (3 + g % 8))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest())


def test_automaton_finds_every_run():
    rng = random.Random(1)
    for _ in range(600):
        n, k = rng.randint(0, 80), rng.choice([1, 2, 2, 3, 5, 30])
        w = [b"%d" % rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n > 5:
                a, p, m = rng.randrange(n), rng.randint(1, 14), rng.randint(1, 50)
                for i in range(a + p, min(n, a + m)):
                    w[i] = w[i - p]
        want = brute_runs(w)
        assert sorted(periodic_runs.runs_of(w)) == want
        every = periodic_runs.automaton_runs([int(x) for x in w])  # without setting words aside first
        assert sorted((s, e - s + 1, q) for (s, q), e in every.items() if e - s + 1 >= max(12, 2 * q)) == want


def test_stretches_cut_at_borders_of_older_ones():
    passage = [b"p%d" % i for i in range(20)]
    w = passage + [b"x"] * 15 + passage + [b"y", b"z"] * 9 + [b"q%d" % i for i in range(50)]
    assert sorted(periodic_runs.runs_of(w)) == brute_runs(w) == [(20, 15, 1), (55, 18, 2)]
    assert periodic_runs.candidate_stretches(np.arange(5000)) == []


def test_runs_of_a_long_document():
    rng = random.Random(3)
    w = [b"%d" % rng.randrange(900) for _ in range(30000)] + [b"a", b"b", b"c"] * 5000 + [b"%d" % rng.randrange(2) for _ in range(3000)]
    assert sorted(periodic_runs.runs_of(w)) == brute_runs(w)


def test_periodic_runs_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SF_SMALL).collect()}
    want = {r.doc_id: brute_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    assert got == want and sum(r[1] for r in want.values()) > 10


def test_periodic_runs_edge_cases(spark):
    pairs = [(1, None), (2, ""), (3, "  \n\t\x0b\x0c\r "), (None, "a " * 12), (5, "a " * 11), (6, "é x " * 6 + "é x"), (6, "é x " * 6), (6, "é x " * 6)]
    found = periodic_runs.periodic_runs(docs_of(spark, pairs), periodic_tail)
    rows = sorted(((r.doc_id, r.n_words, len(r.runs), bytes(r.collapsed)) for r in found.collect()), key=str)
    assert rows == sorted([(1, 0, 0, b""), (2, 0, 0, b""), (3, 0, 0, b""), (None, 12, 1, b"a"), (5, 11, 0, b" ".join([b"a"] * 11))]
                          + [(6, 7, 0, b" ".join(["é x".encode()] * 7))] + 2 * [(6, 6, 0, b" ".join(["é x".encode()] * 6))], key=str)
    digests = periodic_runs.run_digests(found).where("doc_id = 1").first()
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(digests) == (1, 0, None, None, None, None, empty, empty)
    assert periodic_runs.run_digests(periodic_runs.periodic_runs(docs_of(spark, []))).count() == 0


@pytest.fixture(scope="module")
def reference_coder():
    import tiktoken

    ranks = bpe_replay.read_ranks(BPE_VOCABULARY)
    return ranks, tiktoken.Encoding("own", pat_str=bpe_replay.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_replay_equals_the_reference_coder(reference_coder):
    ranks, ref = reference_coder
    coder = bpe_replay.Coder(ranks, bpe_replay.PATTERN, bpe_replay.class_differences(bpe_replay.PATTERN))
    rng = random.Random(2)
    pool = "aaabbbee thnsing  \n\t'sreld0123.,;:!?-_=éñ中文日本語한국어😀\x1c\x85՘\U0001246f\U00033480"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 300))) for _ in range(1500)]
    texts += ["a" * 5000, " " * 3000, "ab" * 4000, "".join(chr(rng.randrange(1, 0xD7FF)) for _ in range(5000)),
              "".join(chr(rng.randrange(0xE000, 0x110000)) for _ in range(20000)), "<|endoftext|>", ""]
    assert coder.encode(texts) == [packed(ref.encode_ordinary(t)) for t in texts]


def test_replay_takes_a_lower_rank_first():
    """With ranks that no training would give, a merge makes room for one that should have come before."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    for k, token in enumerate((b"xbc", b"bcbc", b"bc", b"aaa", b"aa", b"cbc", b"abcb")):
        ranks[token] = 256 + k
    ref = tiktoken.Encoding("odd", pat_str=r"[a-z]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcx") for _ in range(rng.randint(1, 40))) for _ in range(3000)] + ["bcbcbcxbcbc", "aaaaaaa"]
    assert bpe_replay.Coder(ranks, r"[a-z]+", {}).encode(texts) == [packed(ref.encode_ordinary(t)) for t in texts]


def test_bpe_query_equals_the_reference_coder(spark, reference_coder):
    _, ref = reference_coder
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in docs:
        ids = ref.encode_ordinary(r.text or "")
        want[r.doc_id] = (r.doc_id, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: tuple(r) for r in QUERIES["op12_bpe_codec"](spark, SF_SMALL).collect()} == want


def test_bpe_edge_cases(spark, reference_coder):
    ranks, ref = reference_coder
    pairs = [(1, None), (2, ""), (None, "Hello there"), (4, "Hello there"), (4, "Hello there"), (5, "long text é " * 20000)]
    docs = docs_of(spark, pairs)
    rows = bpe_replay.decode(bpe_replay.encode(docs, BPE_VOCABULARY, block_bytes=20), BPE_VOCABULARY).collect()
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in rows) == Counter(
        (i, packed(ref.encode_ordinary(t or "")), (t or "").encode()) for i, t in pairs)
    assert bpe_replay.token_digests(bpe_replay.decode(bpe_replay.encode(docs.limit(0), BPE_VOCABULARY), BPE_VOCABULARY)).count() == 0
    raw = spark.sql("select 1L doc_id, cast(unhex('61FF62') as string) text")
    assert bytes(bpe_replay.decode(bpe_replay.encode(raw, BPE_VOCABULARY), BPE_VOCABULARY).first().decoded) == "a�b".encode()


def test_vocabulary_must_be_whole(tmp_path):
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError):
        bpe_replay.read_ranks(str(path))


def brute_ranking(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [Counter(terms(t)) for _, t in docs]
    n_docs, total = sum(bool(b) for b in bags), sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for at, ((doc, _), bag) in enumerate(zip(docs, bags)):
            m = 50 + (50 * sum(bag.values()) * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * bag[t]) // (1000 * bag[t] + 20 * m))
                        for t in set(terms(text)) if bag[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, at))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc, _) in enumerate(sorted(scored)[:k])]
    return out


def test_pipelined_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    vocab = ["w%d" % i for i in range(60)] + ["É", "é", "ΣΑ", "The", "THE", "the", "中文"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    docs = [(rng.choice([i, 7, None]), text(rng.randint(0, 60))) for i in range(900)] + [(5, None), (6, ""), (8, "the " * 30000)]
    docs += [docs[3]] * 4
    items = [(i, text(rng.randint(1, 25))) for i in range(30)] + [(50, None), (51, ""), (None, "w1 w2"), (3, "w5 w6 w7"), (52, "nowhere")]
    d = docs_of(spark, docs)
    i = spark.createDataFrame([(a, b, "r", 1) for a, b in items], "item_id long, text string, row string, n int")
    want = sorted(brute_ranking(docs, items, 20), key=str)
    for owners, bundle in ((4, 256), (3, 8), (1, 5)):
        monkeypatch.setattr(pipelined_search, "BUNDLE", bundle)
        got = pipelined_search.rank_documents(d.repartition(5), i, k=20, owners=owners)
        assert sorted(map(tuple, got.collect()), key=str) == want
    monkeypatch.setattr(pipelined_search, "BROADCAST_TERMS", 3)
    assert sorted(map(tuple, pipelined_search.rank_documents(d, i, k=20).collect()), key=str) == want


def test_pipelined_search_of_empty_tables(spark):
    docs = docs_of(spark, [(1, "a b c")])
    items = docs.select(docs.doc_id.alias("item_id"), "text")
    assert [tuple(r) for r in pipelined_search.rank_documents(docs, items).collect()] == brute_ranking([(1, "a b c")], [(1, "a b c")], 50)
    assert pipelined_search.rank_documents(docs.limit(0), items).count() == 0
    assert pipelined_search.rank_documents(docs, items.limit(0)).count() == 0
