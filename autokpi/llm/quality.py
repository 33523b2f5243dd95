"""Quality classifier: weak labels by expectation-maximisation, then a hashed linear scorer.

1. Overlapping heuristic labellers (``LABELLERS``) read simple rates of a whole
   text and vote good (1), bad (-1) or abstain (0).
2. The votes of all documents are counted by pattern (at most 3**labellers
   rows, whatever the corpus).  Expectation-maximisation over these counts
   estimates how often each labeller says good, bad or nothing on good and on
   bad documents, and so the posterior of every pattern.  No given label is used.
3. A logistic scorer over ``DIMS`` hashed features (character-class trigrams,
   words, and coarse steps of the same rates) learns the posteriors.  It is
   fitted in one task on a bounded sample, the ``SAMPLE`` documents of
   smallest id hash; patterns, posteriors and scores cover all documents.

A document is rejected when the scorer's probability of good is under
``KEEP_AT``.  Defined cases: null and empty texts have no words and are
rejected; repeated rows get equal scores; an empty table gives an empty result;
without both good and bad posteriors the scorer learns a constant.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from autokpi.llm import grams
from autokpi.llm.frames import python_tasks

SAMPLE = 10_000
DIMS = 1024
KEEP_AT = 0.5
_WORD_SLOTS = 256
_TRI_SLOTS = 640

#: name, rate, votes bad beyond, votes good within (between: abstains), sign of "beyond", fewest words to vote at all
LABELLERS = [
    ("shouting", "upper", 0.30, 0.15, 1, 1),
    ("exclaiming", "bang", 0.03, 0.005, 1, 1),
    ("symbols", "symbol", 0.04, 0.01, 1, 1),
    ("bars", "bar", 0.06, 0.005, 1, 1),
    ("stutter", "repeat", 0.15, 0.03, 1, 12),
    ("variety", "distinct", 0.18, 0.40, -1, 30),
    ("function_words", "short", 0.08, 0.20, -1, 20),
    ("mark_runs", "runs", 0.10, 0.02, 1, 1),
    ("lone_marks", "lone", 0.10, 0.01, 1, 1),
]
#: Labellers that know Latin script alone; they abstain where most letters are of another.
LATIN_ONLY = {"function_words"}
#: Prior of the labellers: a bad vote on a good document is this rare, on a bad one this common; the prior
#: counts as much as this many documents, whatever the corpus.
FALSE_ALARM, TRUE_ALARM, TRUST = 0.0005, 0.15, 25.0
RATES = ["upper", "bang", "symbol", "bar", "repeat", "distinct", "short", "foreign", "runs", "lone"]

#: character classes: 0 control, 1 space, 2 newline, 3 lower, 4 upper, 5 digit, 6 stop, 7 bang, 8 bar, 9 symbol, 10 other
_CLASS = np.full(256, 9, dtype=np.int64)
_CLASS[:32] = 0
_CLASS[[9, 32]] = 1
_CLASS[[10, 13]] = 2
_CLASS[97:123] = 3
_CLASS[65:91] = 4
_CLASS[48:58] = 5
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 6
_CLASS[ord("!")] = 7
_CLASS[ord("|")] = 8
_CLASS[127:] = 10


def _per_row(flag: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flag)))
    return (sums[bounds[1:]] - sums[bounds[:-1]]).astype(np.float64)


def rates(p: grams.Piece) -> np.ndarray:
    """(rows, rates) of a piece made with the original letter case; rows without words are 0."""
    cls = _CLASS[p.raw]
    words = np.maximum(p.counts(), 1)
    marks = np.maximum(_per_row((cls != 1) & (cls != 2), p.bounds), 1)
    letters = np.maximum(_per_row((cls == 3) | (cls == 4), p.bounds), 1)
    same = np.zeros(len(p.word), dtype=bool)
    same[1:] = (p.word[1:] == p.word[:-1]) & (p.doc[1:] == p.doc[:-1])
    order = np.lexsort((p.word, p.doc))
    d, w = p.doc[order], p.word[order]
    new = np.ones(len(w), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1])
    distinct = np.bincount(d[new], minlength=p.docs)
    chars = np.concatenate(([0], np.cumsum((p.raw & 0xC0) != 0x80)))
    short = np.bincount(p.doc[chars[p.end] - chars[p.begin] <= 3], minlength=p.docs)
    doubled = np.zeros(len(p.raw), dtype=bool)
    doubled[1:] = (p.raw[1:] == p.raw[:-1]) & (cls[1:] >= 7) & (cls[1:] <= 9)
    runs = _per_row(doubled, p.bounds)
    space = np.concatenate(([True], cls <= 2, [True]))
    lone = _per_row((cls >= 7) & (cls <= 9) & space[:-2] & space[2:], p.bounds)
    foreign = _per_row(p.raw >= 0xCD, p.bounds)  # first bytes of letters beyond the Latin blocks
    latin = _per_row((cls == 3) | (cls == 4) | ((p.raw >= 0xC3) & (p.raw < 0xCD)), p.bounds)
    return np.column_stack([
        _per_row(cls == 4, p.bounds) / letters, _per_row(cls == 7, p.bounds) / marks,
        _per_row(cls == 9, p.bounds) / marks, _per_row(cls == 8, p.bounds) / marks,
        np.bincount(p.doc[same], minlength=p.docs) / words,
        np.where(words >= 30, distinct / np.minimum(words, 400), 1.0), short / words,
        foreign / np.maximum(foreign + latin, 1), runs / words, lone / words])


def votes(rate: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(rows, labellers) votes; every labeller says bad for a row without words."""
    foreign = rate[:, RATES.index("foreign")] > 0.5
    out = np.zeros((len(rate), len(LABELLERS)), dtype=np.int64)
    for i, (labeller, name, bad, good, sign, fewest) in enumerate(LABELLERS):
        x = rate[:, RATES.index(name)]
        within = sign * x <= sign * good
        silent = (words < fewest) | (foreign if labeller in LATIN_ONLY else False)
        out[:, i] = np.where(silent, 0, np.where(sign * x > sign * bad, -1, within.astype(np.int64)))
    out[words == 0] = -1
    return out


def features(p: grams.Piece, rate: np.ndarray) -> np.ndarray:
    """(rows, DIMS) dense hashed features."""
    out = np.zeros((p.docs, DIMS), dtype=np.float32)
    cls = _CLASS[p.raw].astype(np.uint64)
    n = len(cls)
    if n >= 3:
        tri = (cls[:-2] * np.uint64(121) + cls[1:-1] * np.uint64(11) + cls[2:]).astype(np.int64)
        slot = (grams.mix(np.arange(1331, dtype=np.uint64)) % np.uint64(_TRI_SLOTS)).astype(np.int64)[tri]
        row = np.searchsorted(p.bounds, np.arange(n - 2), side="right") - 1
        got = np.bincount(row * _TRI_SLOTS + slot, minlength=p.docs * _TRI_SLOTS).reshape(p.docs, _TRI_SLOTS)
        out[:, :_TRI_SLOTS] = np.sqrt(got / np.maximum(got.sum(axis=1, keepdims=True), 1))
    if len(p.word):
        slot = (p.word % np.uint64(_WORD_SLOTS)).astype(np.int64)
        got = np.bincount(p.doc * _WORD_SLOTS + slot, minlength=p.docs * _WORD_SLOTS).reshape(p.docs, _WORD_SLOTS)
        out[:, _TRI_SLOTS:_TRI_SLOTS + _WORD_SLOTS] = np.sqrt(got / np.maximum(got.sum(axis=1, keepdims=True), 1))
    step = np.minimum((np.sqrt(np.clip(rate, 0, 1)) * 16).astype(np.int64), 15)
    for i in range((DIMS - _TRI_SLOTS - _WORD_SLOTS) // 16 - 1):
        out[np.arange(p.docs), _TRI_SLOTS + _WORD_SLOTS + i * 16 + step[:, i]] = 1.0
    out[:, -1] = p.counts() == 0
    return out


def _column(rows: np.ndarray, width: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, width, dtype=np.int32)), pa.array(rows.ravel(), kind))


def vote_patterns(docs: DataFrame, text: str = "text") -> DataFrame:
    """(votes, n): how many documents have each combination of votes."""
    python_tasks(docs.sparkSession)

    def count(batches):
        for batch in batches:
            for p in grams.pieces(batch.column(0), lower=False):
                v = votes(rates(p), p.counts())
                code, n = np.unique(((v + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

    return docs.select(F.col(text).cast("string")).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def fit_labellers(code: np.ndarray, n: np.ndarray, rounds: int = 200) -> dict[int, float]:
    """Posterior of good for each vote pattern, by expectation-maximisation.

    A labeller that votes calls a document bad with one rate on good and one on
    bad documents; an abstention says nothing.  The rates have Beta priors, as
    without them a fault that only one labeller sees would pass for noise.
    Starts by doubting every document that some labeller calls bad.
    """
    v = code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1
    post = np.where((v == -1).any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        prior = np.clip((n * post).sum() / n.sum(), 1e-3, 1 - 1e-3)
        logs = []
        for weight, p, alarm in ((n * post, prior, FALSE_ALARM), (n * (1 - post), 1 - prior, TRUE_ALARM)):
            like = np.full(len(v), np.log(p))
            for vote in v.T:
                rate = (weight[vote == -1].sum() + TRUST * alarm) / (weight[vote != 0].sum() + TRUST)
                like += np.log(np.where(vote == -1, rate, np.where(vote == 1, 1 - rate, 1.0)))
            logs.append(like)
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -60, 60)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return dict(zip(code.tolist(), post.tolist()))


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Logistic weights (bias last) for soft labels by full-batch Adam steps; deterministic."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    w, m, s = (np.zeros(x.shape[1]) for _ in range(3))
    balance = np.where(y >= 0.5, 0.5 / max((y >= 0.5).mean(), 1e-3), 0.5 / max((y < 0.5).mean(), 1e-3))
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        g = x.T @ ((p - y) * balance).astype(np.float32) / max(len(x), 1) + ridge * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.999 ** t)) + 1e-8)
    return w


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[dict, np.ndarray]:
    """(pattern posteriors over all documents, weights of the scorer)."""
    spark = docs.sparkSession
    python_tasks(spark)
    counted = vote_patterns(docs, text).collect()  # at most 3**len(LABELLERS) rows
    code, n = np.array([r.code for r in counted], dtype=np.int64), np.array([r.n for r in counted], dtype=np.float64)
    if not len(code):
        return {}, np.zeros(DIMS + 1)
    posterior = fit_labellers(code, n)
    width = len(LABELLERS)
    part = min(1.0, 1.3 * sample / n.sum())  # a little more than the sample by hash, then exactly the smallest
    cut = min(int(-(2 ** 63) + part * 2.0 ** 64), 2 ** 63 - 1)
    pick = docs.select(F.xxhash64(F.col(doc_id).cast("string"), F.lit(7)).alias("h"), F.col(text).cast("string").alias("t")).where(F.col("h") <= cut)

    def featurise(batches):
        for batch in batches:
            for p in grams.pieces(batch.column(1), lower=False):
                r = rates(p)
                v = votes(r, p.counts())
                code = ((v + 1) * 3 ** np.arange(width)).sum(axis=1)
                x = features(p, r)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[p.rows], pa.array(code, pa.int64()),
                     pa.array([row.astype(np.float16).tobytes() for row in x], pa.binary())], names=["h", "code", "x"])

    def learn(batches):
        rows = [(x, c) for batch in batches for x, c in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())]
        x = np.frombuffer(b"".join(x for x, _ in rows), dtype=np.float16).reshape(-1, DIMS).astype(np.float32)
        w = fit_scorer(x, np.array([posterior[c] for _, c in rows])) if rows else np.zeros(DIMS + 1)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f8").tobytes()], pa.binary())], names=["w"])

    rows = pick.mapInArrow(featurise, "h long, code long, x binary").orderBy("h", "code").limit(sample).select("code", "x")
    learned = rows.coalesce(1).mapInArrow(learn, "w binary").first()
    return posterior, np.frombuffer(learned.w, dtype="<f8") if learned is not None else np.zeros(DIMS + 1)


def _score(p: grams.Piece, w: np.ndarray, rate: np.ndarray) -> np.ndarray:
    z = features(p, rate) @ w[:-1].astype(np.float32) + w[-1]
    s = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
    return np.where(p.counts() == 0, 0.0, np.round(s, 6))  # the sums depend on a batch's shape beyond that


def quality_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, words, posterior, score, keep): one row per row of ``docs``."""
    posterior, w = fit(docs, doc_id, text)
    width = len(LABELLERS)

    def score(batches):
        for batch in batches:
            for p in grams.pieces(batch.column(1), lower=False):
                r = rates(p)
                code = ((votes(r, p.counts()) + 1) * 3 ** np.arange(width)).sum(axis=1)
                s = _score(p, w, r)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[p.rows], pa.array(p.counts(), pa.int64()),
                     pa.array([posterior.get(int(c), 0.5) for c in code], pa.float64()), pa.array(s), pa.array(s >= keep_at)],
                    names=["doc_id", "words", "posterior", "score", "keep"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(
        score, "doc_id long, words long, posterior double, score double, keep boolean")


def drop_low_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """``docs`` without the rejected rows; all columns are kept, nothing is shuffled."""
    _, w = fit(docs, doc_id, text)
    place = docs.columns.index(text)

    def keep(batches):
        for batch in batches:
            ok = [_score(p, w, rates(p)) >= keep_at for p in grams.pieces(batch.column(place), lower=False)]
            yield batch.filter(pa.array(np.concatenate(ok))) if ok else batch

    return docs.mapInArrow(keep, docs.schema)
