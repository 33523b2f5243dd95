"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are whole words and word beginnings of 4 to 8 bytes (so inflected and
compound words share terms).  The vocabulary is the ``VOCABULARY`` terms most
tied to the toxic label, chosen on a bounded sample of labelled learning rows:
the ``TOXIC_EXAMPLES`` and ``CLEAN_EXAMPLES`` rows of smallest id hash, which
are the labelled examples too.  Document frequencies cover all documents.

Examples are indexed by term, their postings cut into blocks of ``BLOCK``
examples with each block's greatest weight.  A query adds up its terms' block
maxima, visits blocks in order of that bound and stops when the bound falls
under its k-th best cosine, so the result is exactly the k nearest.  Votes are
weighted by 1 / (distance + 0.05) and by how many labelled rows an example of
its class stands for.  A logistic curve, fitted to the examples scored against
the others, calibrates the share of toxic votes.

Every whole text is scored; held-out rows (crc32(doc_id) mod 5 = 0) never teach.
Defined cases: texts without a vocabulary term, null and empty texts too, get
the learned rate of toxic among such examples; without labels every score is 0;
ties in cosine go to the smaller example id; repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from autokpi.llm import grams
from autokpi.llm.frames import python_tasks, stored

VOCABULARY = 2048
TOXIC_EXAMPLES = 4_000
CLEAN_EXAMPLES = 8_000
NEIGHBOURS = 15
BLOCK = 64
PREFIXES = (4, 5, 6, 7, 8)
_WHOLE = np.uint64(0xD6E8FEB86659FD93)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def terms(p: grams.Piece) -> tuple[np.ndarray, np.ndarray]:
    """(row, term hash) of every word and word beginning of a piece, with repeats."""
    docs, out = [p.doc], [grams.mix(p.word ^ _WHOLE)]
    for k in PREFIXES:
        longer = p.end - p.begin >= k
        docs.append(p.doc[longer])
        out.append(p.span_hash(p.begin[longer], p.begin[longer] + k))
    return np.concatenate(docs), np.concatenate(out)


def choose_terms(sample: DataFrame, toxic_rows: int, clean_rows: int) -> list[int]:
    """The vocabulary: term hashes by their tie to the toxic label in (text, toxic) rows."""
    def count(batches):
        for batch in batches:
            flag = batch.column(1).to_numpy(zero_copy_only=False)
            for p in grams.pieces(batch.column(0)):
                doc, h = terms(p)
                order = np.lexsort((doc, h))
                doc, h = doc[order], h[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                doc, h = doc[new], h[new]
                name, at, n = np.unique(h, return_index=True, return_counts=True)
                if not len(name):
                    continue
                bad = np.add.reduceat(flag[p.rows][doc].astype(np.int64), at)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(bad), pa.array(n - bad)], names=["term", "bad", "good"])

    counted = sample.mapInArrow(count, "term long, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    pb, pg = (F.col("bad") + 0.5) / (toxic_rows + 1.0), (F.col("good") + 0.5) / (clean_rows + 1.0)
    every = (F.col("bad") + F.col("good") + 1.0) / (toxic_rows + clean_rows + 2.0)
    z = (pb - pg) / F.sqrt(every * (1 - every) * (1.0 / (toxic_rows + 1.0) + 1.0 / (clean_rows + 1.0)))
    picked = counted.where((F.col("bad") >= 5) & (pb > 3 * pg)).select("term", z.alias("z")).where("z >= 5")
    return [r.term for r in picked.orderBy(F.desc("z"), "term").limit(VOCABULARY).collect()]


def term_vectors(docs: DataFrame, vocabulary: list[int], doc_id: str, text: str) -> DataFrame:
    """(doc_id, idx, tf): each row's vocabulary terms and how often they occur."""
    names = np.array(vocabulary, dtype=np.int64).view(np.uint64)
    order = np.argsort(names).astype(np.int64)
    names = names[order]
    width = len(names)

    def count(batches):
        seen = np.zeros(1 << 20, dtype=bool)
        seen[(names >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            for p in grams.pieces(batch.column(1)):
                doc, h = terms(p)
                near = seen[(h >> np.uint64(44)).astype(np.int64)]
                doc, h = doc[near], h[near]
                at = np.minimum(np.searchsorted(names, h), max(width - 1, 0))
                hit = names[at] == h if width else np.zeros(len(h), dtype=bool)
                pair, n = np.unique(doc[hit] * max(width, 1) + order[at[hit]], return_counts=True)
                row = pair // max(width, 1)
                offsets = np.searchsorted(row, np.arange(p.docs + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[p.rows], pa.ListArray.from_arrays(pa.array(offsets), pa.array(pair % max(width, 1), pa.int32())),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(n, pa.int32()))], names=["doc_id", "idx", "tf"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(count, "doc_id long, idx array<int>, tf array<int>")


class ExampleIndex:
    """Block-max inverted index over unit TF-IDF vectors of labelled examples."""

    def __init__(self, ids, idx, tf, toxic, idf: np.ndarray, worth: tuple[float, float]):
        self.idf, vectors = idf, []
        for i, t in zip(idx, tf):
            vectors.append((np.asarray(i, dtype=np.int64), self.unit(np.asarray(i, dtype=np.int64), np.asarray(t, dtype=np.float64))))
        toxic = np.asarray(toxic, dtype=np.float64)
        value = np.where(toxic == 1, worth[1], worth[0])
        empty = np.array([len(v[0]) == 0 for v in vectors], dtype=bool)
        total = value[empty].sum()
        self.no_terms = float((value * toxic)[empty].sum() / total) if total else 0.0
        # neighbours in the order of their strongest term make the block maxima tight
        full = sorted((k for k in range(len(vectors)) if not empty[k]), key=lambda k: (int(vectors[k][0][np.argmax(vectors[k][1])]), ids[k]))
        self.ids = np.array([ids[k] for k in full], dtype=np.int64)
        self.toxic, self.value = toxic[full], value[full]
        self.vectors = [vectors[k] for k in full]
        rows = np.concatenate([np.full(len(v[0]), n) for n, v in enumerate(self.vectors)]) if full else np.zeros(0, dtype=np.int64)
        cols = np.concatenate([v[0] for v in self.vectors]) if full else np.zeros(0, dtype=np.int64)
        data = np.concatenate([v[1] for v in self.vectors]) if full else np.zeros(0)
        order = np.lexsort((rows, cols))
        self.rows, cols, self.data = rows[order], cols[order], data[order]
        self.blocks = -(-len(full) // BLOCK)
        self.most = np.zeros((len(idf), max(self.blocks, 1)))
        np.maximum.at(self.most, (cols, self.rows // BLOCK), self.data)
        cell = cols * max(self.blocks, 1) + self.rows // BLOCK
        self.at = np.searchsorted(cell, np.arange(len(idf) * max(self.blocks, 1) + 1))
        self.a, self.b = 1.0, 0.0

    def unit(self, i: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = (1 + np.log(tf)) * self.idf[i] if len(i) else np.zeros(0)
        return w / np.sqrt((w * w).sum()) if len(i) else w

    def nearest(self, i: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(example numbers, cosines) of the k nearest, ties to the smaller id."""
        bound = (w[:, None] * self.most[i]).sum(axis=0)
        best, cos = np.zeros(0, dtype=np.int64), np.zeros(0)
        wide = max(self.blocks, 1)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(best) == NEIGHBOURS and bound[b] < cos[-1] - 1e-12):
                break
            score = np.zeros(BLOCK)
            for t, x in zip(i, w):
                lo, hi = self.at[t * wide + b], self.at[t * wide + b + 1]
                score[self.rows[lo:hi] - b * BLOCK] += x * self.data[lo:hi]
            got = np.flatnonzero(score > 0)
            got = got[got + b * BLOCK != skip]
            best, cos = np.concatenate([best, got + b * BLOCK]), np.concatenate([cos, score[got]])
            top = np.lexsort((self.ids[best], -cos.round(12)))[:NEIGHBOURS]
            best, cos = best[top], cos[top]
        return best, cos

    def share(self, best: np.ndarray, cos: np.ndarray) -> float:
        if not len(best):
            return self.no_terms
        vote = self.value[best] / (1.05 - np.minimum(cos, 1.0))
        return float(((vote * self.toxic[best]).sum() + 0.05 * self.no_terms) / (vote.sum() + 0.05))

    def calibrate(self) -> None:
        """Logistic curve over the examples' shares, each scored without itself."""
        if not len(self.vectors) or self.toxic.min() == self.toxic.max():
            return
        x = np.array([_logit(self.share(*self.nearest(i, w, n))) for n, (i, w) in enumerate(self.vectors)])
        a, b = 1.0, 0.0
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g = np.array([(self.value * (p - self.toxic) * x).sum() + (a - 1), (self.value * (p - self.toxic)).sum() + 0.01 * b])
            s = self.value * p * (1 - p)
            h = np.array([[(s * x * x).sum() + 1, (s * x).sum()], [(s * x).sum(), s.sum() + 0.01]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-8:
                break
        if a > 0 and np.isfinite(a) and np.isfinite(b):
            self.a, self.b = float(a), float(b)

    def score(self, i: np.ndarray, tf: np.ndarray) -> tuple[float, list[int]]:
        """(calibrated score, ids of the three nearest examples)."""
        if not len(i) or not self.blocks:
            return self.no_terms, []
        best, cos = self.nearest(i, self.unit(i, tf))
        x = self.a * _logit(self.share(best, cos)) + self.b
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30)))), [int(v) for v in self.ids[best[:3]]]


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return float(np.log(p / (1 - p)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence): one row per row of ``docs``."""
    spark = docs.sparkSession
    python_tasks(spark)
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("toxic"))
    known = stored(known.where("id is not null and toxic in (0, 1)").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic")))
    rows = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    by_hash = known.withColumn("h", F.xxhash64("id"))
    pick = lambda y, n: by_hash.where(F.col("toxic") == y).orderBy("h", "id").limit(n).select("id", "toxic")
    chosen = stored(pick(1, TOXIC_EXAMPLES).unionAll(pick(0, CLEAN_EXAMPLES)))  # bounded by the two parameters
    taken = {r.toxic: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    sample = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t")).join(
        F.broadcast(chosen), "id").select("t", "toxic")
    vocabulary = choose_terms(sample, taken.get(1, 0), taken.get(0, 0))
    vectors = stored(term_vectors(docs, vocabulary, doc_id, text))
    n = vectors.count()
    df = np.zeros(len(vocabulary))
    for r in vectors.select(F.explode("idx").alias("i")).groupBy("i").count().collect():  # one row per vocabulary term
        df[r.i] = r["count"]
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    held = vectors.withColumnRenamed("doc_id", "id").join(F.broadcast(chosen), "id").dropDuplicates(["id"]).orderBy("id").collect()
    worth = tuple(rows.get(y, 0) / max(taken.get(y, 0), 1) for y in (0, 1))
    index = ExampleIndex([r.id for r in held], [r.idx for r in held], [r.tf for r in held], [r.toxic for r in held], idf, worth)
    index.calibrate()
    index.vectors = []
    shipped = spark.sparkContext.broadcast(index)

    def score(batches):
        index = shipped.value
        for batch in batches:
            at = batch.column(1).offsets.to_numpy()
            idx = batch.column(1).values.to_numpy()
            tf = batch.column(2).values.to_numpy()
            got, known = [], {}
            for lo, hi in zip(at[:-1], at[1:]):
                key = (idx[lo:hi].tobytes(), tf[lo:hi].tobytes())
                if key not in known:
                    known[key] = index.score(idx[lo:hi].astype(np.int64), tf[lo:hi].astype(np.float64))
                got.append(known[key])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array([e for _, e in got], pa.list_(pa.int64()))],
                names=["doc_id", "score", "evidence"])

    scored = vectors.mapInArrow(score, "doc_id long, score double, evidence array<long>")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
