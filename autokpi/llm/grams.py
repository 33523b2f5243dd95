"""Vectorised words and five-word shingles of text columns inside Arrow tasks.

A *word* is a maximal run of ASCII letters and digits and of non-ASCII
characters, lower-cased; every other character separates words.  Hashes are
64-bit and depend on the word's bytes alone, so they agree on every executor.
A null text has no words.  Texts are handled in pieces of about a quarter megabyte
(a longer text is one piece), so memory does not follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
PIECE_BYTES = 1 << 18

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_Q_INV = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))
_SHINGLE_MUL = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                         0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[65:91] = True
_WORD[128:] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per worker."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Piece:
    """Words of a run of consecutive rows: ``word`` hashes, ``doc`` row numbers.

    ``begin`` / ``end`` are the words' byte bounds in ``raw``; ``rows`` is the
    slice of batch rows, ``docs`` their number, ``bounds`` the rows' byte bounds.
    """

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, first: int):
        self.raw, self.bounds, self.first = raw, bounds, first
        self.docs = len(bounds) - 1
        self.rows = slice(first, first + self.docs)
        flag = _WORD[raw]
        n = len(raw)
        if n == 0 or not flag.any():
            self.begin = self.end = np.zeros(0, dtype=np.int64)
            self.doc = np.zeros(0, dtype=np.int64)
            self.word = np.zeros(0, dtype=np.uint64)
            self.sums = np.zeros(n + 1, dtype=np.uint64)
            return
        start = flag.copy()
        start[1:] &= ~flag[:-1]
        heads = bounds[:-1][bounds[:-1] < n]
        start[heads] = flag[heads]
        stop = flag.copy()
        stop[:-1] &= ~flag[1:]
        tails = bounds[1:][bounds[1:] > 0] - 1
        stop[tails] = flag[tails]
        self.begin = np.flatnonzero(start)
        self.end = np.flatnonzero(stop) + 1
        self.doc = np.searchsorted(bounds, self.begin, side="right") - 1
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(_P, n), out=sums[1:])
        self.sums = sums
        self.word = self.span_hash(self.begin, self.end)

    def span_hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each span, whatever its position."""
        inv = powers(_P_INV, len(self.raw) + 1)
        return mix((self.sums[end] - self.sums[begin]) * inv[begin])

    def counts(self) -> np.ndarray:
        """Words of each row."""
        return np.bincount(self.doc, minlength=self.docs)

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of every run of five words, in text order, with repeats."""
        k = len(self.word) - SHINGLE + 1
        if k <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        h = np.zeros(k, dtype=np.uint64)
        for i in range(SHINGLE):
            h += self.word[i:i + k] * _SHINGLE_MUL[i]
        whole = self.doc[:k] == self.doc[SHINGLE - 1:]
        return self.doc[:k][whole], mix(h[whole])

    def sequence_hash(self, salt: int) -> np.ndarray:
        """Hash of each row's whole word sequence (0 for a row without words)."""
        out = np.zeros(self.docs, dtype=np.uint64)
        n = len(self.word)
        if n:
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(mix(self.word + np.uint64(salt)) * powers(_Q, n), out=sums[1:])
            cut = np.searchsorted(self.doc, np.arange(self.docs + 1))
            a, b = cut[:-1], cut[1:]
            got = mix((sums[b] - sums[a]) * powers(_Q_INV, n + 1)[a])
            out[b > a] = got[b > a]
        return out


def _lower(col: pa.Array) -> pa.Array:
    col = pc.fill_null(col, "")
    try:
        return pc.utf8_lower(col)
    except pa.ArrowInvalid:  # bytes that are no UTF-8 stay readable as replacement characters
        texts = [v.as_buffer().to_pybytes().decode("utf-8", "replace").lower() if v.as_buffer() else "" for v in col]
        return pa.array(texts, type=col.type)


def text_bytes(col: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row bounds) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = _lower(col) if lower else pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, off.astype(np.int64)


def pieces(col: pa.Array, lower: bool = True) -> Iterator[Piece]:
    """The rows of a string column as Pieces of about ``PIECE_BYTES`` bytes."""
    if len(col) == 0:
        return
    raw, off = text_bytes(col, lower)
    row, rows = 0, len(off) - 1
    while row < rows:
        to = int(np.searchsorted(off, off[row] + PIECE_BYTES, side="right")) - 1
        to = min(max(to, row + 1), rows)
        yield Piece(raw[off[row]:off[to]], off[row:to + 1] - off[row], row)
        row = to


def leading_zeros(x: np.ndarray) -> np.ndarray:
    """Number of leading zero bits of each uint64 (64 for zero)."""
    out = np.zeros(x.shape, dtype=np.int64)
    x = x.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = x < (np.uint64(1) << np.uint64(64 - step))
        out[low] += step
        x[low] = x[low] << np.uint64(step)
    out[x == 0] = 64
    return out
