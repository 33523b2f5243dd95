"""Byte-level BPE encoding and decoding by replaying merges over a block of the corpus.

Texts are split by the vocabulary's pattern; no merge crosses such a piece, so
equal pieces have equal tokens.  A task takes its rows in blocks of about
``BLOCK_BYTES`` of text, puts the block's pieces that are new to it into one
flat sequence of bytes and keeps an inverted index from what a pair of
neighbouring tokens makes to the places in all pieces where such a pair stands.
The merges are then applied in rank order, each to all its places at once; a
merge touches its two neighbours only, whose new pairs enter the index.  A new
pair of a lower rank than the running one (possible where two splits make one
token) is merged first, before the rest of its piece, so every piece sees its
lowest rank, leftmost place first, as the usual encoder takes them.  A piece
that is itself in the vocabulary is its one token, as in that encoder.

Nothing is shuffled: tokens depend on the pieces alone.  The vocabulary, read
on the driver from a path that is a parameter, is broadcast; its file must not
exceed ``VOCABULARY_BYTES``.  A task holds one block and two generations of
about ``KNOWN_PIECES`` pieces seen before; the older one is forgotten when the
newer is full, but for the pieces that came again.

Defined cases: a null or empty text has no tokens; bytes that are no UTF-8 are
replaced by U+FFFD before encoding; repeated rows give repeated results; an
empty table an empty one; very long pieces take time in proportion to n log n.
"""

from __future__ import annotations

import base64
import heapq
import os
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from autokpi.llm.frames import python_tasks

#: Fixed value: the public pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_BYTES = 4 << 20
KNOWN_PIECES = 1 << 18
VOCABULARY_BYTES = 64 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """{token bytes: rank} of a vocabulary file with one base64 token and its rank a line."""
    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"vocabulary file over {VOCABULARY_BYTES} bytes: {path}")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"vocabulary lacks single bytes {missing[:5]}")
    return ranks


class MergeReplay:
    """Tokens of pieces by one replay of the merges over all of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.text = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.text[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.shift = max(ranks.values()).bit_length()
        #: What two tokens side by side make: every split of every token into two tokens.
        self.made = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.made[a << self.shift | b] = rank
        self.first = np.full((256, 256), -1, dtype=np.int64)
        for a in range(256):
            for b in range(256):
                self.first[a, b] = self.made.get(int(self.single[a]) << self.shift | int(self.single[b]), -1)

    def index(self, flat: np.ndarray, starts: np.ndarray) -> tuple[list[int], dict[int, list[int]]]:
        """What the pair of single bytes at each place makes (-1: nothing, or across two pieces), and {rank: places}."""
        rank = np.append(self.first[flat[:-1], flat[1:]], -1)
        rank[starts[1:] - 1] = -1
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        heads = np.flatnonzero(np.diff(rank[at], prepend=-1))
        parts = [part.tolist() for part in np.split(at, heads[1:])] if len(at) else []
        return rank.tolist(), dict(zip(rank[at[heads]].tolist(), parts))

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """The token ids of each non-empty piece as packed little-endian unsigned 32-bit integers."""
        made, shift = self.made.get, self.shift
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        starts = np.zeros(len(pieces) + 1, dtype=np.int64)
        np.cumsum([len(p) for p in pieces], out=starts[1:])
        makes, places = self.index(flat, starts)  # makes: the rank of the pair that starts at a place, or -1
        token = self.single[flat].tolist()
        step = np.arange(len(flat))
        before, after = step - 1, step + 1
        before[starts[:-1]] = after[starts[1:] - 1] = -1
        left, right = before.tolist(), after.tolist()
        ends: list[int] = []
        ranks = sorted(places)
        push, pop = heapq.heappush, heapq.heappop
        while ranks:
            rank = pop(ranks)
            at = places.pop(rank)
            at.sort()
            held_to, held = -1, []
            high = rank << shift
            for i in at:
                if i < held_to:
                    held.append(i)
                    continue
                if makes[i] != rank:  # merged meanwhile
                    continue
                j = right[i]
                k = right[i] = right[j]
                token[i], token[j], makes[j] = rank, -1, -1
                lowest = rank
                if k >= 0:
                    left[k] = i
                    r = made(high | token[k])
                    if r is None:
                        makes[i] = -1
                    else:
                        makes[i] = r
                        if r in places:
                            places[r].append(i)
                        else:
                            places[r] = [i]
                            push(ranks, r)
                        if r < lowest:
                            lowest = r
                else:
                    makes[i] = -1
                h = left[i]
                if h >= 0:
                    r = made(token[h] << shift | rank)
                    if r is None:
                        makes[h] = -1
                    else:
                        makes[h] = r
                        if r in places:
                            places[r].append(h)
                        else:
                            places[r] = [h]
                            push(ranks, r)
                        if r < lowest:
                            lowest = r
                if lowest < rank:  # that pair goes first in this piece
                    ends = ends or starts.tolist()
                    held_to = ends[bisect_right(ends, i)]
            if held:
                places[rank] = held
                push(ranks, rank)
        out = np.array(token, dtype=np.int64)
        alive = out >= 0
        stops = np.concatenate(([0], np.cumsum(alive)))[starts] * 4
        packed = out[alive].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]


def class_differences(pattern: str) -> dict[int, int]:
    """{code point: stand-in} where the two libraries' character tables put a character into different classes.

    The vocabulary's own library and the expression library used here may follow
    different versions of Unicode.  A stand-in has the class that the former
    sees, and no part in a pattern by itself.
    """
    import regex
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    stand_in = {r"\p{L}": "\u00e9", r"\p{N}": "\u00b2", r"\s": "\u2003"}
    theirs: dict[int, str] = {}
    ours: dict[int, str] = {}
    for kind in [k for k in stand_in if k in pattern]:
        coder = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        theirs.update(dict.fromkeys(map(ord, bytes(coder.encode_ordinary(every)).decode()), kind))
        ours.update(dict.fromkeys(map(ord, regex.findall(kind, every)), kind))
    return {c: ord(stand_in.get(theirs.get(c), "\u2603")) for c in theirs.keys() | ours.keys() if theirs.get(c) != ours.get(c)}


class Coder:
    """Encodes blocks of texts, remembering the tokens of pieces seen before up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, differences: dict[int, int]):
        import regex

        self.pattern = regex.compile(pattern)
        self.differences = differences
        self.odd = frozenset(map(chr, differences))
        self.merges = MergeReplay(ranks)
        self.ranks = ranks
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The text's pieces; characters that the libraries class differently are split as the vocabulary's own does."""
        if text.isascii() or self.odd.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start():m.end()] for m in self.pattern.finditer(text.translate(self.differences))]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KNOWN_PIECES:  # pieces of the last generation that come again move to the new one
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        split = [self.split(t) for t in texts]
        new, raw = [], []
        for piece in {p for pieces in split for p in pieces if p not in known}:
            ids = older.get(piece)
            if ids is not None:
                known[piece] = ids
                continue
            data = piece.encode()
            rank = self.ranks.get(data)
            if rank is not None:
                known[piece] = rank.to_bytes(4, "little")
            else:
                new.append(piece)
                raw.append(data)
        if new:
            known.update(zip(new, self.merges.replay(raw)))
        return [b"".join([known[p] for p in pieces]) for pieces in split]


#: The running vocabulary's coder and the pieces it has seen, kept by a worker from task to task.
_coders: dict[str, Coder] = {}


def encode(docs: DataFrame, path: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text",
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, ids) of every row: the token ids of its whole text, packed as little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    python_tasks(spark)
    shared = spark.sparkContext.broadcast((read_ranks(path), pattern, class_differences(pattern)))
    name = uuid.uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coders.get(name)
        if coder is None:
            _coders.clear()
            coder = _coders[name] = Coder(*shared.value)

        def coded(ids: list, texts: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(coder.encode(texts), pa.binary())],
                                              names=["doc_id", "ids"])

        ids, texts, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_buffer().to_pybytes().decode("utf-8", "replace") if text.is_valid else ""
                if ids and held + len(data) > block_bytes:
                    yield coded(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc)
                texts.append(data)
                held += len(data)
        if ids:
            yield coded(ids, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(task, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encode`` with a column ``decoded``: the bytes that the ids stand for."""
    spark = encoded.sparkSession
    python_tasks(spark)
    shared = spark.sparkContext.broadcast(read_ranks(path))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = {rank: token for token, rank in shared.value.items()}
        for batch in batches:
            out = [b"".join([text[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(task, "doc_id long, ids binary, decoded binary")


def token_digests(decoded: DataFrame) -> DataFrame:
    """Number of tokens of each document and digests of its ids and of the decoded bytes."""
    return decoded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
