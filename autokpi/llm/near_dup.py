"""MinHash near-dedup with ProbMinHash signatures over weighted shingles.

A document is its set of five-word shingles, each weighted 1 + ln(times it
occurs).  Similarity is the probability Jaccard index

    J_P(A, B) = sum over shared d of 1 / sum over d' of max(A(d')/A(d), B(d')/B(d)),

the plain Jaccard index where no shingle repeats.  For the signature every
shingle starts a Poisson process whose rate is its weight; each arrival falls
into one of ``REGISTERS`` registers, which keep their earliest arrival.  A
shingle's process stops early once its next arrival is later than the latest
register.  Two signatures agree in a register with probability J_P.

1. One pass over the texts makes signatures and a 128-bit hash of the word
   sequence.  Texts with the same words are copies and form one class; the
   smallest id stands for it (grouped with partial aggregation).
2. ``BANDS`` bands of ``ROWS`` registers give bucket keys.  Inside a bucket
   every text is paired with the bucket's hub alone, the text that shares most
   buckets with others (in a group of edited copies that is the original).
   Pairs whose one-bit sketches differ far too much for 0.8 are left out, the
   rest verified by the exact J_P; links are joined to classes.
3. In buckets that still hold several classes, the texts are paired with the
   next ``HUBS`` - 1 hubs of other classes.
4. The texts of buckets that are then still open are settled exactly by prefix
   filtering: J_P >= t needs shared shingles worth t of either text, so in any
   one order of all shingles the two prefixes worth more than 1 - t have a
   shingle in common.  Rare shingles come first (by a fixed-size table of
   counts), so a passage that many texts share lies outside their prefixes and
   makes no pairs.  If their first common shingle leaves shares f and g of the
   two weights from there on, J_P is at most 1 / (1/f + 1/g - 1); pairs of
   different classes that may still reach the threshold are verified.  Edited
   copies of one text are told apart by their few shingles outside a hub they
   share: they have no more in common than what either shares with the hub and
   what those few have in common.
   So no link between classes is lost, while a group of thousands of copies, or
   of texts with a common passage, costs pairs in proportion to its size.

A pair at exactly 0.8 shares no bucket with probability (1 - 0.8**4)**24, about
3 in a million, and less above; the sketch filter loses fewer still.

Defined cases: a document of one to four words has no shingle and is only a
copy of the same word sequence; a document without words, null or empty, is
alone in its class; rows that repeat a doc_id belong to the same document, and
a null doc_id gets a null class and is kept by ``drop_near_duplicates``; if a
doc_id has several texts, one of them is measured for all.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from autokpi.llm import grams
from autokpi.llm.frames import connected_components, python_tasks, release, stored

THRESHOLD = 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: Texts of a bucket that its others are paired with, before what is left is settled by prefixes.
HUBS = 4
#: Most shingles outside its hub that a text is told apart by.
OUTSIDE = 64
#: The table that orders shingles by how often they occur has 2**COUNT_BITS counters.
COUNT_BITS = 18
#: Most differing sketch bits of a candidate: 0.8 gives 9.6 on average, standard deviation 2.9.
MOST_BITS = 26

_STEP, _PLACE = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def weighted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight) with every shingle of a row once."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(h)))
    return doc[at], h[at], 1.0 + np.log(times)


def prob_minhash(doc: np.ndarray, h: np.ndarray, w: np.ndarray, rows: int) -> np.ndarray:
    """(rows, REGISTERS) array of the winning shingles; rows without shingles stay 0."""
    when = np.full(rows * REGISTERS, np.inf)
    who = np.zeros(rows * REGISTERS, dtype=np.uint64)
    latest = np.full(rows, np.inf)
    t = np.zeros(len(h))
    turn = 0
    while len(h):
        turn += 1
        u = (grams.mix(h + np.uint64(turn) * _STEP) >> np.uint64(11)).astype(np.float64)
        t = t - np.log((u + 0.5) * 2.0 ** -53) / w
        live = t < latest[doc]
        doc, h, w, t = doc[live], h[live], w[live], t[live]
        if not len(h):
            break
        place = ((grams.mix(h ^ (np.uint64(turn) * _PLACE)) >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
        at = doc * REGISTERS + place.astype(np.int64)
        np.minimum.at(when, at, t)
        won = when[at] == t
        who[at[won]] = h[won]
        latest = when.reshape(rows, REGISTERS).max(axis=1)
    return who.reshape(rows, REGISTERS)


def band_keys(who: np.ndarray) -> np.ndarray:
    """(rows, BANDS) bucket keys; the band's number is part of the key."""
    parts = who.reshape(len(who), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _STEP
    for r in range(ROWS):
        key = grams.mix(key ^ parts[:, :, r])
    return key.view(np.int64)


def sketch(who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One bit of every register, in two words of 48 bits."""
    bits = (grams.mix(who) & np.uint64(1)).astype(np.uint64)
    half = REGISTERS // 2
    place = np.uint64(1) << np.arange(half, dtype=np.uint64)
    return (bits[:, :half] * place).sum(axis=1).view(np.int64), (bits[:, half:] * place).sum(axis=1).view(np.int64)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, words, copy_a, copy_b, size, bit_a, bit_b, bands): one row per row of ``docs``."""
    python_tasks(docs.sparkSession)
    schema = "id long, words long, copy_a long, copy_b long, size long, bit_a long, bit_b long, bands array<long>"

    def sign(batches):
        for batch in batches:
            ids = batch.column(0)
            for p in grams.pieces(batch.column(1)):
                doc, h, w = weighted(*p.shingles())
                size = np.bincount(doc, minlength=p.docs)
                who = prob_minhash(doc, h, w, p.docs)
                keys, (a, b) = band_keys(who), sketch(who)
                has = size > 0
                offsets = np.concatenate(([0], np.cumsum(np.where(has, BANDS, 0)))).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[has].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [ids[p.rows], pa.array(p.counts()), pa.array(p.sequence_hash(1).view(np.int64)),
                     pa.array(p.sequence_hash(2).view(np.int64)), pa.array(size), pa.array(a), pa.array(b), bands],
                    names=["id", "words", "copy_a", "copy_b", "size", "bit_a", "bit_b", "bands"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string")).mapInArrow(sign, schema)


def probability_jaccard(ha: np.ndarray, ta: np.ndarray, hb: np.ndarray, tb: np.ndarray) -> float:
    """Exact J_P of two sorted shingle lists with their counts."""
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    wa, wb = 1.0 + np.log(ta.astype(np.float64)), 1.0 + np.log(tb.astype(np.float64))
    only_a, only_b = wa.sum() - wa[ia].sum(), wb.sum() - wb[ib].sum()
    ratio = wa[ia] / wb[ib]
    total = 0.0
    for r, n in zip(*np.unique(ratio, return_counts=True)):
        scale = only_a + r * only_b + np.maximum(wa[ia], r * wb[ib]).sum()
        total += wa[ia][ratio == r].sum() / scale
    return float(total)


def _shingle_table(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, hashes, counts) as packed binaries, for the ids in ``wanted``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    rows = rows.join(wanted, "id", "left_semi")

    def pack(batches):
        for batch in batches:
            for p in grams.pieces(batch.column(1)):
                doc, h, w = weighted(*p.shingles())
                cut = np.searchsorted(doc, np.arange(p.docs + 1))
                times = np.rint(np.exp(w - 1.0)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[p.rows],
                     pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                     pa.array([times[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                    names=["id", "hashes", "times"])

    return rows.mapInArrow(pack, "id long, hashes binary, times binary")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()


def _measured(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs."""
    left = packed.select(F.col("id").alias("a"), F.col("hashes").alias("ha"), F.col("times").alias("ta"))
    right = packed.select(F.col("id").alias("b"), F.col("hashes").alias("hb"), F.col("times").alias("tb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ha", "ta", "hb", "tb")

    def measure(batches):
        for batch in batches:
            a, b, *packs = (c.to_pylist() if i > 1 else c for i, c in enumerate(batch.columns))
            sim = np.array([probability_jaccard(np.frombuffer(ha, np.uint64), np.frombuffer(ta, np.int32),
                                                np.frombuffer(hb, np.uint64), np.frombuffer(tb, np.int32))
                            for ha, ta, hb, tb in zip(*packs)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([a, b, pa.array(sim)], names=["a", "b", "similarity"])

    return both.mapInArrow(measure, "a long, b long, similarity double")


def _prefixes(packed: DataFrame, threshold: float) -> DataFrame:
    """(id, key, rest, flat, flat_rest): each text's rarest shingles that weigh more than 1 - threshold of it.

    ``rest`` is the share of the text's weight from that shingle on; ``flat`` the number of its shingles and
    ``flat_rest`` that from that one on, both null if it repeats one.
    """
    spark = packed.sparkSession

    def tally(batches):
        total = np.zeros(1 << COUNT_BITS, dtype=np.int64)
        for batch in batches:
            h = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint64)
            total += np.bincount((h >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(total))
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], names=["slot", "n"])

    counts = packed.select("hashes").mapInArrow(tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(1 << COUNT_BITS, dtype=np.int64)  # of fixed size, whatever the corpus
    often[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    shipped = spark.sparkContext.broadcast(often)

    def rarest(batches):
        often = shipped.value
        for batch in batches:
            ids, keys, rest, flat, flat_rest = [], [], [], [], []
            for i, ha, ta in zip(*(c.to_pylist() for c in batch.columns)):
                h, w = np.frombuffer(ha, dtype=np.uint64), 1.0 + np.log(np.frombuffer(ta, dtype=np.int32))
                order = np.lexsort((h, often[(h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]))
                before = np.cumsum(w[order]) - w[order]
                near = before <= (1 - threshold) * w.sum() + 1e-9
                ids.append(np.full(near.sum(), i, dtype=np.int64))
                keys.append(h[order[near]].view(np.int64))
                rest.append(1 - before[near] / w.sum())
                size = len(h) if w.max(initial=1.0) == 1.0 else -1
                flat.append(np.full(near.sum(), size))
                flat_rest.append(size - np.arange(near.sum()))
            if ids:
                size = np.concatenate(flat)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(rest)),
                     pa.array(size, mask=size < 0), pa.array(np.concatenate(flat_rest), mask=size < 0)],
                    names=["id", "key", "rest", "flat", "flat_rest"])

    return packed.select("id", "hashes", "times").mapInArrow(rarest, "id long, key long, rest double, flat long, flat_rest long")


def _outside_hub(near: DataFrame, packed: DataFrame) -> DataFrame:
    """(id, hub, total, inside, outside): how many shingles a text has, and has in its hub, and the others.

    Only for texts without repeated shingles and with at most ``OUTSIDE`` others; the rest is not ruled out by them.
    """
    left = packed.select("id", "hashes", "times")
    both = near.join(left, "id").join(packed.select(F.col("id").alias("hub"), F.col("hashes").alias("of_hub")), "hub")

    def compare(batches):
        for batch in batches:
            got = []
            for i, hub, ha, ta, hh in zip(*(c.to_pylist() for c in batch.columns)):
                h = np.frombuffer(ha, dtype=np.uint64)
                other = np.setdiff1d(h, np.frombuffer(hh, dtype=np.uint64), assume_unique=True)
                if len(other) <= OUTSIDE and np.frombuffer(ta, dtype=np.int32).max(initial=1) == 1:
                    got.append((i, hub, len(h), len(h) - len(other), other.view(np.int64).tolist()))
            if got:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.list_(pa.int64()) if k == 4 else pa.int64()) for k, c in enumerate(zip(*got))],
                    names=["id", "hub", "total", "inside", "outside"])

    return both.select("id", "hub", "hashes", "times", "of_hub").mapInArrow(
        compare, "id long, hub long, total long, inside long, outside array<long>")


def _alike(x: str, y: str):
    return (F.bit_count(F.col(f"{x}.bit_a").bitwiseXOR(F.col(f"{y}.bit_a")))
            + F.bit_count(F.col(f"{x}.bit_b").bitwiseXOR(F.col(f"{y}.bit_b")))) <= MOST_BITS


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id",
                           text: str = "text") -> DataFrame:
    """(doc_id, class_id, links): one row per row of ``docs``.

    ``class_id`` is the smallest doc_id of the class, ``links`` the number of
    verified pairs its text takes part in as far as the classes needed them.
    """
    signed = stored(signatures(docs, doc_id, text))
    worded = signed.where("words > 0 and id is not null")
    first = worded.groupBy("copy_a", "copy_b").agg(F.min("id").alias("rep"))
    texts = (worded.where("size > 0").groupBy("copy_a", "copy_b")
             .agg(F.min("id").alias("id"), F.first("bit_a").alias("bit_a"), F.first("bit_b").alias("bit_b"),
                  F.first("bands").alias("bands")))
    repeated = not signed.where("id is not null").groupBy("id").count().where("count > 1").isEmpty()

    def packed_for(ids: DataFrame) -> DataFrame:
        got = _shingle_table(docs, ids, doc_id, text)
        if repeated:
            got = got.groupBy("id").agg(F.max(F.struct("hashes", "times")).alias("t")).select("id", "t.hashes", "t.times")
        return stored(got)

    keys = stored(texts.select("id", "bit_a", "bit_b", F.explode("bands").alias("key")))
    size = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(keys.join(size, "key"))
    degree = shared.groupBy("id").agg(F.sum(F.col("n") - 1).alias("degree"))
    hubs = shared.select("key", F.col("id").alias("b"), F.col("bit_a").alias("bit_a"), "bit_b").join(
        degree.withColumnRenamed("id", "b"), "b")
    by_degree = Window.partitionBy("key").orderBy(F.desc("degree"), "b")
    hubs = stored(hubs.withColumn("turn", F.row_number().over(by_degree)).where(F.col("turn") <= HUBS))

    def pairs_with(hubs: DataFrame, members: DataFrame, apart) -> DataFrame:
        """Distinct (a, b), a > b, of members and hubs of their buckets, as far as their sketches allow."""
        both = members.alias("x").join(hubs.alias("y"), (F.col("x.key") == F.col("y.key")) & apart & _alike("x", "y"))
        return both.select(F.greatest("x.id", "y.b").alias("a"), F.least("x.id", "y.b").alias("b")).distinct()

    pairs = stored(pairs_with(hubs.where("turn = 1"), shared, F.col("x.id") != F.col("y.b")))
    packed = packed_for(_ids(pairs))
    reached = F.col("similarity") >= threshold - 1e-12
    measured = stored(_measured(pairs, packed))
    links = measured.where(reached)
    release(docs.sparkSession)
    final = stored(connected_components(links, "a", "b"))

    def classed(rows: DataFrame) -> DataFrame:
        return rows.join(final, "id", "left").withColumn("c", F.coalesce("class_id", "id")).drop("class_id")

    def still_open() -> DataFrame:
        """Bucket rows with their class ``c``, where a bucket holds several."""
        placed = classed(shared.select("key", "id", "bit_a", "bit_b"))
        several = placed.groupBy("key").agg((F.min("c") < F.max("c")).alias("open")).where("open").select("key")
        return stored(placed.join(several, "key"))

    def add(more: DataFrame) -> bool:
        """Verify pairs that are new and join their classes; False if they link nothing."""
        nonlocal packed, links, pairs, final
        more = stored(more.join(pairs, ["a", "b"], "left_anti"))
        if more.isEmpty():
            return False
        unseen = stored(_ids(more).join(packed.select("id"), "id", "left_anti"))
        if not unseen.isEmpty():
            packed = packed.unionAll(packed_for(unseen))
        new_links = stored(_measured(more, packed).where(reached))
        pairs = pairs.unionAll(more)
        release(docs.sparkSession)
        if new_links.isEmpty():
            return False
        links = links.unionAll(new_links)
        joined = final.select(F.col("id").alias("a"), F.col("class_id").alias("b")).unionAll(new_links.select("a", "b"))
        final = stored(connected_components(joined, "a", "b"))
        return True

    placed = still_open()
    others = classed(hubs.where("turn > 1").withColumnRenamed("b", "id")).withColumnRenamed("id", "b")
    if add(pairs_with(others, placed, F.col("x.c") != F.col("y.c"))):
        placed = still_open()
    texts_left = stored(placed.select("id", "bit_a", "bit_b", "c").distinct())
    unseen = stored(texts_left.select("id").join(packed.select("id"), "id", "left_anti"))
    if not unseen.isEmpty():
        packed = packed.unionAll(packed_for(unseen))
    ends = measured.select(F.col("a").alias("id"), F.col("b").alias("hub"), "similarity").unionAll(
        measured.select(F.col("b").alias("id"), F.col("a").alias("hub"), "similarity"))
    ends = ends.where("similarity >= 0.5").join(hubs.where("turn = 1").select(F.col("b").alias("hub"), "degree").distinct(), "hub")
    near_hub = ends.groupBy("id").agg(F.max(F.struct("degree", "hub")).alias("near")).select("id", "near.hub")
    prefix = _prefixes(packed.join(texts_left.select("id"), "id", "left_semi"), threshold).join(texts_left, "id")
    several = prefix.groupBy("key").agg((F.min("c") < F.max("c")).alias("open")).where("open").select("key")
    prefix = stored(prefix.join(several, "key"))
    release(docs.sparkSession)
    outside = _outside_hub(prefix.select("id").distinct().join(near_hub, "id"), packed)
    prefix = prefix.join(outside, "id", "left")
    may_reach = 1 / F.col("x.rest") + 1 / F.col("y.rest") <= 1 / threshold + 1 + 1e-9
    most = F.least("x.inside", "y.inside") + F.size(F.array_intersect("x.outside", "y.outside"))
    few_left = F.least("x.flat_rest", "y.flat_rest") < threshold / (1 + threshold) * (F.col("x.flat") + F.col("y.flat")) - 1e-6
    too_few = (F.col("x.hub") == F.col("y.hub")) & (most < threshold / (1 + threshold) * (F.col("x.total") + F.col("y.total")) - 1e-6)
    add(pairs_with(prefix.withColumnRenamed("id", "b"), prefix, (F.col("x.c") != F.col("y.c")) & (F.col("x.id") > F.col("y.b"))
                   & may_reach & ~F.coalesce(few_left, F.lit(False)) & ~F.coalesce(too_few, F.lit(False))))
    link_count = links.select(F.col("a").alias("rep")).unionAll(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(
        F.count(F.lit(1)).alias("links"))
    classes = (first.join(final, first.rep == final.id, "left").drop("id").join(link_count, "rep", "left")
               .select("copy_a", "copy_b", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")))
    worded = signed.select("id", "words", "copy_a", "copy_b").join(classes, ["copy_a", "copy_b"], "left")
    return worded.select(F.col("id").alias("doc_id"),
                         F.when(F.col("id").isNotNull() & (F.col("words") > 0), F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
                         F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id",
                         text: str = "text") -> DataFrame:
    """``docs`` with one row for each class, all columns kept; null ids stay."""
    classes = near_duplicate_classes(docs, threshold, doc_id, text)
    name = uuid.uuid4().hex  # no column of the table is called like it
    keep = (classes.where("doc_id = class_id").groupBy(F.col("doc_id").alias(f"id_{name}"))
            .agg(F.count(F.lit(1)).alias(f"rows_{name}")))
    kept = docs.join(keep, docs[doc_id].cast("long") == F.col(f"id_{name}"), "inner")
    once = kept.where(f"rows_{name} = 1").select(*[docs[c] for c in docs.columns])
    again = kept.where(f"rows_{name} > 1").select(*[docs[c] for c in docs.columns]).dropDuplicates([doc_id])
    return once.unionAll(again).unionAll(docs.where(F.col(doc_id).isNull()))
