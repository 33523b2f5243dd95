"""Training-order token shards: Feistel slots, fixed-stride binary files.

The tokens of all documents, each followed by an end token, form one stream in
the order of the stored table.  It is cut into sequences of ``SEQUENCE`` tokens,
the last one padded.  A keyed Feistel network with cycle-walking permutes the
sequence numbers 0..N-1, so every sequence has one global slot, known without
any sort and invertible.  Slots are dealt by range to files of ``SHARD_SLOTS``
records each; a record is two 64-bit integers (sequence number, doc_id of its
first token) and the tokens as 16- or 32-bit integers, little-endian.  The
record of slot s is at byte (s mod SHARD_SLOTS) * record size of file
s // SHARD_SLOTS, so a reader resumes at any step by seeking.

The first pass counts each partition's tokens; only those counts meet in one
place.  The second pass tokenises again with the offsets and moves every token
once, to its slot's range (cheaper on disk than keeping the tokens of the first
pass).  Shards are written under a temporary name and renamed; a task that runs
again writes the same bytes, so lost executors and repeated attempts are safe.
The two passes must see the same rows; the second one checks its counts.

Tokenisation is exactly the tokenizer's: a text is cut only before single
spaces that start a word, where its own pattern cuts too, and words seen before are
looked up by a 64-bit hash; texts with other white space are encoded whole.

Defined cases: a null or empty text adds just its end token; an empty table
writes no shard; a null doc_id is stored as -1.
"""

from __future__ import annotations

import base64
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from autokpi.llm import grams
from autokpi.llm.frames import python_tasks
from autokpi.session import ensure_checkpoint_dir

SEQUENCE = 2048
SHARD_SLOTS = 1024
KEY = 0x5EED
END_TOKEN = 50256
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_HEADER = 16
#: Slots for words seen before, and the tokens kept of them; both bound the memory of a worker.
_SLOT_BITS, _POOL_TOKENS = 21, 1 << 24


def _spans(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes at[0]..at[0]+size[0]-1, at[1].. and so on in one array."""
    stop = np.cumsum(size)
    return np.repeat(at - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)


class Words:
    """Token ids of texts; words seen before are looked up by a 64-bit hash, up to a bound."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kind = np.uint16 if max(END_TOKEN, len(ranks)) < 1 << 16 else np.uint32
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.pool = np.empty(_POOL_TOKENS, dtype=self.kind)
        self.forget()

    def forget(self) -> None:
        self.filled = 0
        self.name = np.zeros(1 << _SLOT_BITS, dtype=np.uint64)
        self.at = np.zeros(1 << _SLOT_BITS, dtype=np.int64)
        self.size = np.zeros(1 << _SLOT_BITS, dtype=np.int32)

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.coder.encode_ordinary(text.decode("utf-8", "replace")), dtype=self.kind)

    def encode(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens one after another, tokens per word) of distinct words of a piece."""
        data = raw[_spans(begin, end - begin)]
        stops = np.cumsum(end - begin)
        if (raw[begin] == 32).all():  # each starts with a space, where the pattern cuts: one text holds them all
            tokens = self.whole(data.tobytes())
            reach = np.cumsum(self.lengths[tokens])
            if len(reach) and reach[-1] == len(data):  # else bytes that are no UTF-8 were replaced
                return tokens, np.diff(np.searchsorted(reach, stops) + 1, prepend=0)
        each = [self.whole(data[a:b].tobytes()) for a, b in zip(stops - (end - begin), stops)]
        return np.concatenate(each), np.array([len(t) for t in each], dtype=np.int64)

    def look_up(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the pool, tokens) of each word; unseen ones are encoded and take over their slot."""
        n = len(raw)
        if self.filled + n > len(self.pool):  # a word has no more tokens than bytes
            self.pool = np.empty(max(_POOL_TOKENS, 2 * n), dtype=self.kind)
            self.forget()
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * grams.powers(grams._P, n), out=sums[1:])
        name = grams.mix((sums[end] - sums[begin]) * grams.powers(grams._P_INV, n + 1)[begin])
        slot = (name >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        at, size = self.at[slot], self.size[slot].astype(np.int64)
        missing = np.flatnonzero(self.name[slot] != name)
        spaced = raw[begin[missing]] == 32
        for part in (missing[spaced], missing[~spaced]):
            if not len(part):
                continue
            new, first, inverse = np.unique(name[part], return_index=True, return_inverse=True)
            tokens, sizes = self.encode(raw, begin[part[first]], end[part[first]])
            places = self.filled + np.cumsum(sizes) - sizes
            self.pool[self.filled:self.filled + len(tokens)] = tokens
            self.filled += len(tokens)
            at[part], size[part] = places[inverse], sizes[inverse]
            own = slot[part[first]]
            self.name[own], self.at[own], self.size[own] = new, places, sizes
        return at, size

    def rows(self, raw: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Tokens of each row of a piece of text bytes."""
        n = len(raw)
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        odd = (raw == 0xC2) | (raw == 0xE1) | (raw == 0xE2) | (raw == 0xE3)  # may begin other white space
        double = np.zeros(n, dtype=bool)
        double[1:] = space[1:] & space[:-1]
        strange = np.concatenate(([0], np.cumsum(odd | double)))
        plain = strange[bounds[1:]] == strange[bounds[:-1]]
        head = raw == 32
        head[bounds[:-1][bounds[:-1] < n]] = True
        cut = np.flatnonzero(head)
        row = np.searchsorted(bounds, cut, side="right") - 1
        end = np.append(cut[1:], n)
        own = plain[row]
        cut, end, row = cut[own], end[own], row[own]
        at, size = self.look_up(raw, cut, end)
        stream = self.pool[_spans(at, size)]
        cuts = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(row, np.arange(len(bounds)))]
        return [stream[cuts[i]:cuts[i + 1]] if plain[i] else self.whole(raw[bounds[i]:bounds[i + 1]].tobytes()) for i in range(len(bounds) - 1)]


_coders: dict[str, Words] = {}


def coder(path: str) -> Words:
    if path not in _coders:
        _coders[path] = Words(path)
    return _coders[path]


def _streams(batches, path: str):
    """(doc_ids, tokens with end tokens) for each piece of the batches."""
    words = coder(path)
    end = np.array([END_TOKEN], dtype=words.kind)
    for batch in batches:
        ids = batch.column(0)
        for p_ids, raw, bounds in _raw_pieces(ids, batch.column(1)):
            yield p_ids, [np.concatenate([t, end]) for t in words.rows(raw, bounds)]


def _raw_pieces(ids: pa.Array, col: pa.Array):
    raw, off = grams.text_bytes(col, lower=False)
    row, rows = 0, len(off) - 1
    while row < rows:
        to = min(max(int(np.searchsorted(off, off[row] + grams.PIECE_BYTES, side="right")) - 1, row + 1), rows)
        yield ids[row:to], raw[off[row]:off[to]], off[row:to + 1] - off[row]
        row = to


def feistel(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Keyed permutation of 0..n-1: six Feistel rounds, cycle-walked into the range."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = grams.mix(np.arange(1, 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = np.asarray(x, dtype=np.uint64).copy()
    todo = np.ones(len(out), dtype=bool)
    while todo.any():
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (grams.mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (grams.mix(right ^ k) & mask)
        out[todo] = (left << half) | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def partition_tokens(rows: DataFrame, path: str) -> list[int]:
    """Number of tokens in each partition of (doc_id, text), in partition order."""
    def count(batches):
        n = sum(len(t) for _, texts in _streams(batches, path) for t in texts)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], names=["part", "n"])

    got = {r.part: r.n for r in rows.mapInArrow(count, "part int, n long").collect()}  # one row per partition
    return [got.get(i, 0) for i in range(max(got, default=-1) + 1)]


def write_shards(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER,
                 sequence: int = SEQUENCE, shard_slots: int = SHARD_SLOTS, key: int = KEY) -> DataFrame:
    """Write the shards into ``folder``; (shard, path, first_slot, records, bytes, sequences) of each.

    ``sequences`` names the documents of every record: (slot, doc_ids, starts), in token order; a start is the place of
    the document's first token in the sequence, -1 for a document that began in an earlier one.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)).alias("d"), F.col(text).cast("string").alias("t"))
    counts = partition_tokens(rows, tokenizer)
    total = sum(counts)
    sequences = -(-total // sequence)
    start = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    shards = -(-sequences // shard_slots)
    result = "shard int, path string, first_slot long, records int, bytes long, sequences array<struct<slot: long, doc_ids: array<long>, starts: array<int>>>"
    if not sequences:
        return spark.createDataFrame([], result)
    kind = coder(tokenizer).kind
    record = _HEADER + sequence * np.dtype(kind).itemsize

    def cut(batches):
        part = TaskContext.get().partitionId()
        at, held, held_ids, held_heads = int(start[part]) if part < len(counts) else 0, [], [], []
        done = 0

        def emit(tokens, owner, head, first, last):
            seqs = np.arange(first // sequence, -(-last // sequence))
            slots = feistel(seqs, sequences, key)
            a = np.maximum(seqs * sequence, first)
            b = np.minimum((seqs + 1) * sequence, last)
            named = head.copy()  # a document is named where it starts and again in each sequence that it goes on in
            named[a - first] = True
            named = np.flatnonzero(named)
            bounds = pa.array(np.searchsorted(named, np.append(a, last) - first), pa.int32())
            begun = np.where(head[named], (named + first) % sequence, -1)
            return pa.RecordBatch.from_arrays(
                [pa.array((slots // shard_slots).astype(np.int32)), pa.array((slots % shard_slots).astype(np.int32)),
                 pa.array((a - seqs * sequence).astype(np.int32)), pa.array(seqs),
                 pa.array(owner[a - first]), pa.ListArray.from_arrays(bounds, pa.array(owner[named])),
                 pa.ListArray.from_arrays(bounds, pa.array(begun, pa.int32())), pa.array([tokens[i - first:j - first].tobytes() for i, j in zip(a, b)], pa.binary())],
                names=["shard", "place", "at", "seq", "doc", "doc_ids", "starts", "tokens"])

        for ids, texts in _streams(batches, tokenizer):
            held.extend(texts)
            sizes = [len(t) for t in texts]
            held_ids.append(np.repeat(ids.to_numpy(), sizes))
            head = np.zeros(sum(sizes), dtype=bool)
            head[np.cumsum([0] + sizes[:-1])] = True  # every text has its end token at least
            held_heads.append(head)
            size = sum(map(len, held))
            last = (at + size) // sequence * sequence
            if last > at:  # whole sequences leave, the rest waits for the next texts
                tokens, owner, head = np.concatenate(held), np.concatenate(held_ids), np.concatenate(held_heads)
                yield emit(tokens[:last - at], owner[:last - at], head[:last - at], at, last)
                held, held_ids, held_heads = [tokens[last - at:]], [owner[last - at:]], [head[last - at:]]
                done += last - at
                at = last
        size = sum(map(len, held))
        if size:
            yield emit(np.concatenate(held), np.concatenate(held_ids), np.concatenate(held_heads), at, at + size)
        if part >= len(counts) or done + size != counts[part]:
            raise RuntimeError("the documents changed between the two passes; store them as a table first")

    pieces = rows.mapInArrow(cut, "shard int, place int, at int, seq long, doc long, doc_ids array<long>, starts array<int>, tokens binary")
    deal = min(shards, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = pieces.repartitionById(deal, (F.col("shard").cast("long") * deal / F.lit(shards)).cast("int"))

    sequences_type = pa.list_(pa.struct([("slot", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32()))]))

    def write(batches):
        store, top = open_store(folder)
        store.create_dir(top, recursive=True)
        shard, image, named = None, None, {}
        unit = np.dtype(kind).itemsize

        def close():
            size = (min(sequences, (shard + 1) * shard_slots) - shard * shard_slots) * record
            path = f"{top}/shard-{shard:08d}.bin"
            part = f"{top}/.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as out:
                out.write(memoryview(image)[:size])
            store.move(part, path)
            sequences_of = []
            for place, parts in sorted(named.items()):
                parts.sort()
                sequences_of.append({"slot": shard * shard_slots + place, "doc_ids": [d for _, ids, _ in parts for d in ids],
                                     "starts": [i for _, _, starts in parts for i in starts]})
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([path]), pa.array([shard * shard_slots], pa.int64()),
                 pa.array([size // record], pa.int32()), pa.array([size], pa.int64()), pa.array([sequences_of], sequences_type)],
                names=["shard", "path", "first_slot", "records", "bytes", "sequences"])

        for batch in batches:
            for s, place, at, seq, doc, doc_ids, starts, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard:
                    if shard is not None:
                        yield close()
                    shard, image, named = s, bytearray(np.full(shard_slots * record // unit, END_TOKEN, dtype=kind).tobytes()), {}
                named.setdefault(place, []).append((at, doc_ids, starts))
                begin = place * record
                if at == 0:
                    image[begin:begin + _HEADER] = np.array([seq, doc], dtype="<i8").tobytes()
                begin += _HEADER + at * unit
                image[begin:begin + len(tokens)] = tokens
        if shard is not None:
            yield close()

    return dealt.sortWithinPartitions("shard").mapInArrow(write, result)


def read_shards(spark: SparkSession, folder: str, sequence: int = SEQUENCE, shard_slots: int = SHARD_SLOTS,
                width: int = 2) -> DataFrame:
    """(slot, shard, seq, doc_id, tokens) of every record of a folder of shards; tokens as packed bytes."""
    record = _HEADER + sequence * width

    def split(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = int(os.path.basename(path)[len("shard-"):-len(".bin")])
                n = len(content) // record
                heads = np.frombuffer(content, dtype=np.uint8).reshape(n, record)[:, :_HEADER].copy().view("<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard * shard_slots + np.arange(n)), pa.array(np.full(n, shard, dtype=np.int32)),
                     pa.array(heads[:, 0]), pa.array(heads[:, 1]),
                     pa.array([content[i * record + _HEADER:(i + 1) * record] for i in range(n)], pa.binary())],
                    names=["slot", "shard", "seq", "doc_id", "tokens"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(folder).select("path", "content")
    return files.mapInArrow(split, "slot long, shard int, seq long, doc_id long, tokens binary")


def open_store(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as a path or a URI of any scheme that Arrow knows."""
    if folder.startswith("file:") or "://" not in folder:
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/") if folder.startswith("file:") else folder
    return pafs.FileSystem.from_uri(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
