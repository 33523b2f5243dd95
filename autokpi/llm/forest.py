"""Approximate nearest neighbours with a hash-prefix forest (LSH forest).

The rows are dealt to shards of about ``SHARD_ROWS`` rows by an id hash; every
row is indexed.  A shard's forest has ``TREES`` trees, each a sorted array of
``BITS``-bit hash strings (signs of random projections around the shard's
mean).  A query descends every tree to its longest prefix match, then all trees
ascend together, one bit at a time, until the ranges of the common prefix hold
``CANDIDATE_SHARE`` of the shard; every row in the ranges is a candidate and
gets its exact Euclidean distance.  Each shard returns its best k, a top-k per
query merges them.

The stated query set is broadcast in blocks of ``QUERY_BLOCK`` rows.  The share
of candidates is set for recall on vectors that are almost independent, as in
the test tables (a nearest neighbour there has a cosine of about 0.5); on
clustered embeddings a far smaller share does.

Identical vectors are cut to the k + 1 smallest ids before indexing: no other
copy can be in a top k whose ties go to the smaller id.  A vector that a third
of the rows share so costs k + 1 rows.  Defined cases: null, zero, empty and
non-finite vectors take no part; vectors are compared only with vectors of
their own length; repeated rows count once; fewer than k candidates all return.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from autokpi.llm.frames import python_tasks, stored

TREES = 96
BITS = 24
SHARD_ROWS = 8192
CANDIDATE_SHARE = 0.35
QUERY_BLOCK = 4096
_SEED = 20260


def usable(vec: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vec, bad) & F.exists(vec, lambda x: x != 0), F.lit(False))


def planes(dim: int) -> np.ndarray:
    """(dim, TREES * BITS) random directions, the same on every executor."""
    return np.random.Generator(np.random.PCG64(_SEED + dim)).standard_normal((dim, TREES * BITS))


def hash_strings(x: np.ndarray, mean: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """(rows, TREES) hash strings as integers whose high bits come first."""
    bits = ((x - mean) @ directions > 0).reshape(len(x), TREES, BITS)
    return bits @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


class Forest:
    def __init__(self, x: np.ndarray):
        self.mean, self.directions = x.mean(axis=0), planes(x.shape[1])
        strings = hash_strings(x, self.mean, self.directions)
        self.order = np.argsort(strings, axis=0, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=0)
        self.rows = len(x)

    def candidates(self, q: np.ndarray, least: int):
        """For each query, a mask of the rows reached when the trees hold ``least`` of them."""
        strings = hash_strings(q, self.mean, self.directions)
        open_q = np.arange(len(q))
        for bits in range(BITS, -1, -1):
            if not len(open_q):
                return
            shift = BITS - bits
            low = (strings[open_q] >> shift) << shift
            lo = np.column_stack([np.searchsorted(self.sorted[:, t], low[:, t], "left") for t in range(TREES)])
            hi = np.column_stack([np.searchsorted(self.sorted[:, t], low[:, t] + (np.int64(1) << shift), "left") for t in range(TREES)])
            # ranges of different trees overlap: only queries that could have enough are counted exactly
            full = np.flatnonzero((hi - lo).sum(axis=1) >= least)
            left = np.ones(len(open_q), dtype=bool)
            for k in full:
                mask = np.zeros(self.rows, dtype=bool)
                for t in range(TREES):
                    mask[self.order[lo[k, t]:hi[k, t], t]] = True
                if bits == 0 or mask.sum() >= least:
                    left[k] = False
                    yield open_q[k], mask
            open_q = open_q[left]


def shard_search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, share: float):
    """(query number, id, distance) of the best k candidates of one shard."""
    forest = Forest(x)
    least = max(int(np.ceil(share * len(x))), min(len(x), 4 * k))
    for n, mask in forest.candidates(queries, least):
        got = np.flatnonzero(mask & (ids != query_ids[n]))
        gap = x[got] - queries[n]
        dist = np.sqrt((gap * gap).sum(axis=1))
        if len(got) > 4 * k:  # ties at the k-th distance all stay
            near = dist <= np.partition(dist, k - 1)[k - 1]
            got, dist = got[near], dist[near]
        top = np.lexsort((ids[got], dist))[:k]
        yield n, ids[got[top]], dist[top]


def _searcher(shipped, k: int, share: float):
    """The Arrow task of one shard (table of id, v, dim, shard) for a broadcast block of queries."""
    def search(shard):
        ids = shard.column("id").to_numpy()
        dim = shard.column("dim")[0].as_py()
        got = [[], [], []]
        if dim in shipped.value:
            x = shard.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            asked_ids, asked_vecs = shipped.value[dim]
            for n, found, dist in shard_search(ids, x, asked_ids, asked_vecs, k, share):
                got[0].append(np.full(len(found), asked_ids[n]))
                got[1].append(found)
                got[2].append(dist)
        cols = [np.concatenate(g) if g else np.zeros(0) for g in got]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)),
                         "score": pa.array(cols[2].astype(np.float64))})

    return search


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, row_id: str = "vec_id", vec: str = "embedding",
            share: float = CANDIDATE_SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query, nearest first."""
    spark = rows.sparkSession
    python_tasks(spark)
    shape = lambda df: df.select(F.col(row_id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & usable(F.col("v"))).distinct()
    few = Window.partitionBy("v").orderBy("id")
    index = stored(shape(rows).withColumn("__n", F.row_number().over(few)).where(F.col("__n") <= k + 1).drop("__n"))
    shards = max(1, -(-index.count() // SHARD_ROWS))
    dealt = index.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    asked = stored(shape(queries))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    schema = "query_id long, vec_id long, score double"
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)) == b).orderBy("id").collect()  # about QUERY_BLOCK rows
        by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in {len(r.v) for r in block}:
            own = [r for r in block if len(r.v) == dim]
            by_dim[dim] = (np.array([r.id for r in own], dtype=np.int64), np.array([r.v for r in own], dtype=np.float64))
        shipped = spark.sparkContext.broadcast(by_dim)

        out = out.unionAll(dealt.groupBy("dim", "shard").applyInArrow(_searcher(shipped, k, share), schema))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = out.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
