"""Periodic runs of words: suffix automaton, last occurrences by link-cut access.

A *run* is a stretch of consecutive words with smallest period ``q`` (words q
apart are the same) of at least ``max(LEAST_WORDS, 2 * q)`` words that neither
neighbouring word extends with period q.  Words are the maximal stretches
without ASCII white space, told apart by all their bytes.

Every word appended to a document extends its suffix automaton.  The states on
the way from the new prefix to the root are its suffixes; this way is kept as
path segments of one colour, the place where the segment's suffixes ended last.
Giving the whole way the new end (an *access* of a link-cut tree, amortised
O(log n) segments a word) meets each old segment once: its deepest state, of
length l, ended last d words before.  For d <= l the last l + d words have
smallest period d and start where no further word on the left fits, so they are
a run so far, and the last word for which (start, d) is met ends the run.

Before that, words which lie in no run for sure are set aside, without loss:
every word of a run lies in six consecutive words that occur twice within it
(a run has at least q + 6 words), so a stretch of words not covered by six-word
sequences that repeat in the same stretch holds none.  What is left is cut anew
until nothing changes, and each remaining stretch gets its own automaton.

A document is handled in one task by its nature; documents are never shuffled.
Memory of a task is bounded by its longest stretch (about 600 bytes a word).

Defined cases: a null or empty text has no words, no runs and collapses to the
empty text; ``rewrite`` sees the id as given, null included; repeated rows give
repeated results; an empty table gives an empty result; further columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from autokpi.llm.frames import python_tasks

LEAST_WORDS = 12
#: Words of a sequence that must repeat; LEAST_WORDS / 2 or fewer, or runs would be lost.
GRAM = 6

_SCHEMA = ("doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_MUL = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def candidate_stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches of words that may hold runs; no run lies outside or across them."""
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    grams = np.zeros(n - GRAM + 1, dtype=np.uint64)
    for k in range(GRAM):
        grams += (ids[k:n - GRAM + 1 + k].astype(np.uint64) + np.uint64(1)) * _MUL[k]
    bounds = np.array([[0, n]])
    while len(bounds):
        sizes = bounds[:, 1] - bounds[:, 0] - GRAM + 1
        part = np.repeat(np.arange(len(bounds)), sizes)
        at = np.arange(len(part)) + np.repeat(bounds[:, 0] - (np.cumsum(sizes) - sizes), sizes)
        order = np.lexsort((grams[at], part))
        same = (grams[at[order[1:]]] == grams[at[order[:-1]]]) & (part[order[1:]] == part[order[:-1]])
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        step = np.zeros(n + 1, dtype=np.int64)
        np.add.at(step, at[twice], 1)
        np.add.at(step, at[twice] + GRAM, -1)
        inside = np.concatenate(([False], np.cumsum(step)[:-1] > 0, [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
        edge = _cut(edge, bounds)
        edge = edge[edge[:, 1] - edge[:, 0] >= LEAST_WORDS]
        if len(edge) == len(bounds) and (edge == bounds).all():
            break
        bounds = edge
    return [(int(a), int(b)) for a, b in bounds]


def _cut(edge: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Stretches that run over the border of two neighbouring older ones, cut there."""
    borders = bounds[1:, 0][bounds[1:, 0] == bounds[:-1, 1]]
    if not len(borders) or not len(edge):
        return edge
    inner = borders[(np.searchsorted(edge[:, 0], borders, side="left") - 1 >= 0)]
    held = inner[edge[np.searchsorted(edge[:, 0], inner, side="left") - 1, 1] > inner]
    return np.column_stack((np.sort(np.concatenate((edge[:, 0], held))), np.sort(np.concatenate((edge[:, 1], held)))))


def automaton_runs(ids: list[int]) -> dict[tuple[int, int], int]:
    """{(start, period): last word} of every square-holding stretch of ``ids``, found word by word."""
    found: dict[tuple[int, int], int] = {}
    # Suffix automaton: state 1 is the empty word, state 0 stands for none.
    edges: list[dict] = [{}, {}]
    length, link = [0, 0], [0, 0]
    # Link-cut tree over the suffix links: splay trees by depth, one for each path segment; ``ended`` counts at their roots.
    up, lower, deeper, ended = [0, 0], [0, 0], [0, 0], [0, 0]

    def to_root(x: int) -> None:
        while True:
            p = up[x]
            if not p or (lower[p] != x and deeper[p] != x):
                return
            g = up[p]
            if not g or (lower[g] != p and deeper[g] != p):  # p is the root: one rotation
                if lower[p] == x:
                    b = lower[p] = deeper[x]
                    deeper[x] = p
                else:
                    b = deeper[p] = lower[x]
                    lower[x] = p
                if b:
                    up[b] = p
                up[p], up[x] = x, g
                ended[x] = ended[p]
                return
            top = up[g]
            side = 0 if not top else 1 if lower[top] == g else 2 if deeper[top] == g else 0
            if lower[g] == p:
                if lower[p] == x:
                    b = lower[g] = deeper[p]
                    if b:
                        up[b] = g
                    b = lower[p] = deeper[x]
                    if b:
                        up[b] = p
                    deeper[p], up[g], deeper[x], up[p] = g, p, p, x
                else:
                    b = deeper[p] = lower[x]
                    if b:
                        up[b] = p
                    b = lower[g] = deeper[x]
                    if b:
                        up[b] = g
                    lower[x], deeper[x] = p, g
                    up[p] = up[g] = x
            elif deeper[p] == x:
                b = deeper[g] = lower[p]
                if b:
                    up[b] = g
                b = deeper[p] = lower[x]
                if b:
                    up[b] = p
                lower[p], up[g], lower[x], up[p] = g, p, p, x
            else:
                b = lower[p] = deeper[x]
                if b:
                    up[b] = p
                b = deeper[g] = lower[x]
                if b:
                    up[b] = g
                deeper[x], lower[x] = p, g
                up[p] = up[g] = x
            up[x] = top
            if side == 0:
                ended[x] = ended[g]
                return
            if side == 1:
                lower[top] = x
            else:
                deeper[top] = x

    whole = 1
    for e, word in enumerate(ids):
        new = len(length)
        length.append(length[whole] + 1)
        edges.append({})
        p = whole
        while p and word not in edges[p]:
            edges[p][word] = new
            p = link[p]
        suffix = 1
        if p:
            suffix = q = edges[p][word]
            if length[p] + 1 != length[q]:  # split q: its shorter suffixes get a state above it, in the same segment
                suffix = new + 1
                length.append(length[p] + 1)
                edges.append(dict(edges[q]))
        link.append(suffix)
        up.append(0 if suffix == 1 else suffix)
        lower.append(0)
        deeper.append(0)
        ended.append(e)
        if suffix == new + 1:
            link.append(link[q])
            link[q] = suffix
            while p and edges[p].get(word) == q:
                edges[p][word] = suffix
                p = link[p]
            to_root(q)
            above = lower[q]
            if above:
                up[above] = suffix
            up.append(up[q])
            lower.append(above)
            deeper.append(q)
            ended.append(ended[q])
            up[q], lower[q] = suffix, 0
        whole = new
        below, x = new, up[new]
        while x:
            to_root(x)
            d = e - ended[x]
            size = length[x]
            if d <= size:
                found[e - size - d + 1, d] = e
            cut = deeper[x]
            if cut:
                ended[cut] = ended[x]
            deeper[x] = below
            below, x = x, up[x]
        ended[below] = e
    return found


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a document's words, by start, then period."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    out = []
    for a, b in candidate_stretches(ids):
        for (start, period), last in automaton_runs(ids[a:b].tolist()).items():
            if last - start + 1 >= max(LEAST_WORDS, 2 * period):
                out.append((a + start, last - start + 1, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats (those outside runs and each run's first period), joined by spaces."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    keep = np.cumsum(drop)[:-1] == 0
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def periodic_runs(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs, and its words without their repetitions.

    ``rewrite`` may change a document's words before they are searched; it gets
    the id and the words.  ``collapsed`` is UTF-8 text as bytes.
    """
    python_tasks(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, texts = [], [], []
            ids = batch.column(0).to_pylist()
            for doc, text in zip(ids, batch.column(1)):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                if rewrite is not None:
                    words = rewrite(doc, words)
                runs = runs_of(words)
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(collapse(words, runs))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(found, _RUNS), pa.array(texts, pa.binary())],
                names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(task, _SCHEMA)


def run_digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one and digests of all runs and of the collapsed words, for each document."""
    best = F.expr("array_min(transform(runs, r -> struct(-r.length as l, r.start as s, r.period as p)))")
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\\n'), '')")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                       F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
                      F.expr("(-1000 * best.l) div best.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
