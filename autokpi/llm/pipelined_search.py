"""Ranked lexical search: items travel through the owners of a term-partitioned index.

The index has a posting (term, row, doc_id, words, tf) for every document and
every term that some item holds.  It is written once, partitioned by *term
owner* (``OWNERS`` of them).  Items travel in bundles of about ``BUNDLE``; a
bundle carries its items' terms and, for one block of ``BLOCK`` documents, a
sparse accumulator of (item, document, score).  At each owner in turn the
bundle is cogrouped with the owner's postings of its block; the owner adds the
integer contributions of its terms and passes the bundle on.  After the last
owner every bundle gives its best ``k`` documents of the block for each item,
and the best ``k`` of these are the result, equal scores by ascending doc_id.

Score of a document for an item: over the item's distinct terms the sum of
``w * ((1000000000 * tf) div (1000 * tf + 20 * m))`` with
``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` and
``m = 50 + (50 * n * N) div L``: N documents with a term, L their terms with
repeats, n the document's.  Terms are told apart by 64-bit hashes.

Sizes: a frequent term's postings are dealt over all blocks of documents, so no
group grows with a term; a group holds at most BUNDLE x BLOCK accumulators and
the postings of BLOCK documents.  The item terms are broadcast up to
``BROADCAST_TERMS`` of them, counted before, and joined by shuffle beyond.

Defined cases: null or empty texts, as documents or items, have no term and
never meet; every row, repeated ones and those of null or equal ids included,
is a document or an item by itself; a null doc_id comes after all others of
its score; without documents, items or common terms the result is empty; further
columns, whatever their names, are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from autokpi.llm import grams
from autokpi.llm.frames import python_tasks, stored
from autokpi.session import ensure_checkpoint_dir

#: Fixed value: a term is a maximal match, only A-Z lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OWNERS = 4
BUNDLE = 256
_BLOCK_BITS = 12
BLOCK = 1 << _BLOCK_BITS
BROADCAST_TERMS = 1 << 20
#: Contributions that a task adds at a time.
_CHUNK = 1 << 20

_TRAVEL = "bundle long, block long, items binary, docs binary, acc binary"
_FOUND = "item long, item_id long, row long, doc_id long, score long"
_ITEM = np.dtype([("term", "<i8"), ("item", "<i4")])
_NAME = np.dtype([("row", "<i8"), ("id", "<i8"), ("known", "u1")])
_ACC = np.dtype([("key", "<i4"), ("score", "<i8")])


def term_counts(rows: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(row, id, n, term, tf): every distinct term of every row, n the row's terms with repeats."""
    python_tasks(rows.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, off = grams.text_bytes(batch.column(2), lower=False)
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(off, off[at] + grams.PIECE_BYTES, side="right")) - 1
                to = min(max(to, at + 1), batch.num_rows)
                part = raw[off[at]:off[to]]
                part = part + np.where((part >= 65) & (part <= 90), np.uint8(32), np.uint8(0))
                piece = grams.Piece(part, off[at:to + 1] - off[at], at)
                term = piece.word.view(np.int64)
                order = np.lexsort((term, piece.doc))
                doc, term = piece.doc[order], term[order]
                head = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])))[:len(doc)])
                tf = np.diff(np.append(head, len(doc)))
                rows_ = pa.array(doc[head] + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows_), batch.column(1).take(rows_), pa.array(piece.counts()[doc[head]].astype(np.int64)),
                     pa.array(term[head]), pa.array(tf.astype(np.int64))], names=["row", "id", "n", "term", "tf"])
                at = to

    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(task, "row long, id long, n long, term long, tf long")


def _spans(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes at[0]..at[0]+size[0]-1, at[1].. and so on in one array."""
    stop = np.cumsum(size)
    return np.repeat(at - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)


def pack_bundle(group: pa.Table) -> pa.Table:
    """The items of one bundle: their rows and ids, and (term, place of the item) sorted by term."""
    item, term = group.column("row").to_numpy(), group.column("term").to_numpy()
    known = group.column("id").is_valid().to_numpy()
    ids = group.column("id").fill_null(0).to_numpy()
    rows, first, place = np.unique(item, return_index=True, return_inverse=True)
    names = np.zeros(len(rows), dtype=_NAME)
    names["row"], names["id"], names["known"] = rows, ids[first], known[first]
    order = np.argsort(term, kind="stable")
    terms = np.zeros(len(term), dtype=_ITEM)
    terms["term"], terms["item"] = term[order], place[order]
    packed = np.int64(len(rows)).tobytes() + names.tobytes() + terms.tobytes()
    return pa.table({"bundle": group.column("bundle").slice(0, 1), "items": pa.array([packed], pa.binary())})


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(packed, dtype="<i8", count=1)[0])
    names = np.frombuffer(packed, dtype=_NAME, count=n, offset=8)
    return names, np.frombuffer(packed, dtype=_ITEM, offset=8 + n * _NAME.itemsize)


def _added(travel: pa.Table, postings: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names of the items, documents, dense scores) of a bundle after its visit to an owner."""
    names, terms = _unpacked(travel.column("items")[0].as_py())
    packed_docs, packed = travel.column("docs")[0].as_py(), travel.column("acc")[0].as_py()
    docs = np.frombuffer(packed_docs, dtype=_NAME).copy() if packed_docs else np.zeros(BLOCK, dtype=_NAME)
    scores = np.zeros(len(names) * BLOCK, dtype=np.int64)
    held = np.frombuffer(packed or b"", dtype=_ACC)
    scores[held["key"]] = held["score"]
    if postings.num_rows:
        row, term = postings.column("row").to_numpy(), postings.column("term").to_numpy()
        slot, add = row & (BLOCK - 1), postings.column("add").to_numpy()
        docs["row"][slot] = row
        docs["id"][slot] = postings.column("id").fill_null(0).to_numpy()
        docs["known"][slot] = np.where(postings.column("id").is_valid().to_numpy(), 1, 2)
        begin = np.searchsorted(terms["term"], term, side="left")
        size = np.searchsorted(terms["term"], term, side="right") - begin
        step = np.cumsum(size)
        cuts = np.searchsorted(step, np.arange(_CHUNK, int(step[-1]) + _CHUNK, _CHUNK)) + 1
        a = 0
        for b in np.minimum(cuts, len(size)).tolist():
            if b > a:
                items = terms["item"][_spans(begin[a:b], size[a:b])].astype(np.int64)
                np.add.at(scores, items * BLOCK + np.repeat(slot[a:b], size[a:b]), np.repeat(add[a:b], size[a:b]))
            a = b
    return names, docs, scores


def visit(travel: pa.Table, postings: pa.Table) -> pa.Table:
    """One bundle at one owner: its accumulators with the owner's contributions."""
    _, docs, scores = _added(travel, postings)
    held = np.flatnonzero(scores)
    acc = np.zeros(len(held), dtype=_ACC)
    acc["key"], acc["score"] = held, scores[held]
    return pa.table({"bundle": travel.column("bundle"), "block": travel.column("block"), "items": travel.column("items"),
                     "docs": pa.array([docs.tobytes()], pa.binary()), "acc": pa.array([acc.tobytes()], pa.binary())})


def last_visit(k: int):
    """The visit to the last owner, which gives each item's best k documents of the block."""
    def best(travel: pa.Table, postings: pa.Table) -> pa.Table:
        names, docs, scores = _added(travel, postings)
        scores = scores.reshape(len(names), BLOCK)
        items, slots = [], []
        for i in range(len(names)):
            held = np.flatnonzero(scores[i])
            if len(held) > k:
                held = held[scores[i, held] >= np.partition(scores[i, held], len(held) - k)[len(held) - k]]
            held = held[np.lexsort((docs["row"][held], docs["id"][held], docs["known"][held], -scores[i, held]))][:k]
            items.append(np.full(len(held), i))
            slots.append(held)
        item = np.concatenate(items) if items else np.zeros(0, dtype=np.int64)
        slot = np.concatenate(slots) if slots else np.zeros(0, dtype=np.int64)
        return pa.table({"item": pa.array(names["row"][item]), "item_id": pa.array(names["id"][item], mask=names["known"][item] != 1),
                         "row": pa.array(docs["row"][slot]), "doc_id": pa.array(docs["id"][slot], mask=docs["known"][slot] != 1),
                         "score": pa.array(scores[item, slot])})
    return best


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, owners: int = OWNERS,
                   doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` documents of highest score above 0, best first."""
    spark = docs.sparkSession
    size = F.regexp_count(F.col(text_col).cast("string"), F.lit(TERM))
    total = docs.select(size.cast("long").alias("n")).agg(
        F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    sought = stored(term_counts(items, item_id, text_col))
    vocabulary = sought.select("term").distinct()
    few = vocabulary.count() <= BROADCAST_TERMS
    bounded = F.broadcast if few else lambda df: df

    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/term-index-{uuid.uuid4().hex}"
    held = term_counts(docs, doc_id, text_col).join(bounded(vocabulary), "term", "left_semi")
    held.withColumn("owner", F.expr(f"cast(pmod(term, {owners}) as int)")).write.partitionBy("owner").parquet(folder)
    index = spark.read.schema("term long, row long, id long, n long, tf long, owner int").parquet(folder)

    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * total.docs + 2.0) / (2 * F.col("df") + 1))).cast("long")
    weights = index.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", weight.alias("w"))
    bundles = max(1, -(-sought.select("row").distinct().count() // BUNDLE))
    sought = sought.withColumn("bundle", F.expr(f"pmod(xxhash64(row), {bundles})"))
    wanted = stored(sought.select("term", "bundle").distinct().join(bounded(weights), "term"))

    packed = sought.select("bundle", "row", "id", "term").groupBy("bundle").applyInArrow(pack_bundle, "bundle long, items binary")
    block = F.shiftright("row", _BLOCK_BITS).alias("block")
    empty = F.lit(None).cast("binary")
    travel = (index.select("term", block).distinct().join(bounded(wanted.select("term", "bundle")), "term")
              .select("bundle", "block").distinct().join(packed, "bundle")
              .select("bundle", "block", "items", empty.alias("docs"), empty.alias("acc")))
    norm = f"(50 + (50 * n * {total.docs}L) div {max(total.terms, 1)}L)"
    add = F.expr(f"w * ((1000000000L * tf) div (1000 * tf + 20 * {norm}))").alias("add")
    for owner in range(owners):
        postings = index.where(F.col("owner") == owner).join(bounded(wanted), "term")
        postings = postings.select(F.col("bundle").alias("to"), block.alias("at"), "row", "id", "term", add)
        pair = travel.groupBy("bundle", "block").cogroup(postings.groupBy("to", "at"))
        last = owner == owners - 1
        travel = pair.applyInArrow(last_visit(k) if last else visit, _FOUND if last else _TRAVEL)

    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return (travel.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))
