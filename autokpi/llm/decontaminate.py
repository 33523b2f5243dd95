"""Benchmark decontamination: size-partitioned MinHash containment search.

Short test items (benchmark questions) are looked up inside documents of any
length.  Similarity is *containment*: the share of an item's distinct five-word
shingles that occur anywhere in the document.

Documents are partitioned by size: one with n distinct shingles gets a one-
permutation MinHash of 2**j bins, j = ceil(log2 n) + 3, so bins stay at most an
eighth full however long the document is, and a short item is not drowned.  A
document and an item are candidates when they share the smallest hash of one
bin; items under ``EXACT_BELOW`` shingles are looked up by all their shingles.
Every candidate is verified by exact shingle containment.

The search keeps no document data: each task holds the signatures of one block
of items (at most ``BLOCK_ITEMS``) and one piece of text.  More items make
more blocks, one scan each, so neither side is cut and nothing is shuffled; a
passage that a third of all documents share costs each task only its own rows.

Defined cases: a null or empty text contains nothing; items with fewer than
five words have no shingle and are never reported; repeated document rows are
each judged; items that repeat are each reported; columns that are not named
are passed through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from autokpi.llm import grams
from autokpi.llm.frames import python_tasks

THRESHOLD = 0.8
BLOCK_ITEMS = 20_000
EXACT_BELOW = 8
_FILTER_BITS = 22


class ItemIndex:
    """Signatures of one block of items: shingles, their owners and first bin level."""

    def __init__(self, texts: list[str | None]):
        owner, hashes, level, size = [], [], [], np.zeros(len(texts), dtype=np.int64)
        for p in grams.pieces(pa.array(texts, type=pa.string())):
            doc, h = p.shingles()
            for i in range(p.docs):
                own = np.unique(h[doc == i])
                size[p.first + i] = len(own)
                owner.append(np.full(len(own), p.first + i))
                hashes.append(own)
                level.append(first_level(own))
        self.size = size
        own = np.concatenate(owner) if owner else np.zeros(0, dtype=np.int64)
        h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        lev = np.concatenate(level) if level else np.zeros(0, dtype=np.int64)
        order = np.argsort(h, kind="stable")
        self.hash, self.owner, self.level = h[order], own[order], lev[order]
        self.seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.seen[(self.hash >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def hits(self, col: pa.Array, threshold: float) -> Iterator[tuple[int, int, int]]:
        """(row, item number, shared shingles) of every pair at the threshold."""
        for p in grams.pieces(col):
            doc, h = p.shingles()
            near = self.seen[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
            for i in np.unique(doc[near]):
                lo, hi = np.searchsorted(doc, (i, i + 1))
                for item, shared in self.search(np.unique(h[lo:hi]), threshold):
                    yield p.first + int(i), item, shared

    def search(self, h: np.ndarray, threshold: float) -> list[tuple[int, int]]:
        """Candidates of one document's distinct shingles, then exact containment."""
        a, b = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        found = np.flatnonzero(b > a)
        if not len(found):
            return []
        bins = int(np.ceil(np.log2(max(len(h), 2)))) + 3
        reps = (b - a)[found]
        post = np.repeat(a[found] - np.concatenate(([0], np.cumsum(reps)[:-1])), reps) + np.arange(reps.sum())
        item = self.owner[post]
        mine = np.repeat(first_level(h)[found] <= bins, reps)
        short = self.size[item] < EXACT_BELOW
        candidate = np.unique(item[(mine & (self.level[post] <= bins)) | short])
        shared = np.bincount(item, minlength=len(self.size))
        return [(int(c), int(shared[c])) for c in candidate if shared[c] >= threshold * self.size[c] - 1e-9]


def first_level(h: np.ndarray) -> np.ndarray:
    """Fewest leading bits that make each sorted hash the smallest of its bin."""
    out = np.zeros(len(h), dtype=np.int64)
    out[1:] = grams.leading_zeros(h[1:] ^ h[:-1]) + 1
    return out


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, ItemIndex]]:
    """The items in blocks of bounded size, each built on the driver."""
    items = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    n = items.count()
    parts = -(-n // BLOCK_ITEMS)
    for k in range(parts):
        block = items if parts == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        rows = block.orderBy("i", "t").collect()
        yield [r.i for r in rows], ItemIndex([r.t for r in rows])


def find_contamination(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id",
                       doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of every pair at the threshold."""
    spark = docs.sparkSession
    python_tasks(spark)
    narrow = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(doc_text).cast("string").alias("t"))
    schema = "doc_id long, item_id long, shared long, item_shingles long, containment double"
    out = spark.createDataFrame([], schema)
    for names, index in _blocks(items, item_id, item_text):
        shipped = spark.sparkContext.broadcast((names, index))

        def search(batches, shipped=shipped):
            names, index = shipped.value
            for batch in batches:
                ids = batch.column(0)
                got = [(ids[r].as_py(), names[i], s, int(index.size[i])) for r, i, s in index.hits(batch.column(1), threshold)]
                if got:
                    d, i, s, n = zip(*got)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()),
                         pa.array(np.array(s) / np.array(n), pa.float64())],
                        names=["doc_id", "item_id", "shared", "item_shingles", "containment"])

        out = out.unionAll(narrow.mapInArrow(search, schema))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, doc_text: str = "text",
                      item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that contain an item; all columns are kept, nothing is shuffled."""
    spark = docs.sparkSession
    python_tasks(spark)
    place, schema = docs.columns.index(doc_text), docs.schema
    for _, index in _blocks(items, item_id, item_text):
        shipped = spark.sparkContext.broadcast(index)

        def keep(batches, shipped=shipped):
            for batch in batches:
                mask = np.ones(batch.num_rows, dtype=bool)
                for row, _, _ in shipped.value.hits(batch.column(place), threshold):
                    mask[row] = False
                yield batch if mask.all() else batch.filter(pa.array(mask))

        docs = docs.mapInArrow(keep, schema)
    return docs
