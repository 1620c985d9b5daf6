"""Vectorised text kernels for Arrow batches: words, word hashes and shingle hashes of many texts at once.

A batch of texts is one byte array with a blank between texts. A word's 64-bit hash comes from prefix sums of
``table[byte] * base**position``, so hashing costs a few numpy passes over the bytes however many words there are.
Two different words share a hash with a chance of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}

#: Bytes that stand in words: all but ASCII white space; and ASCII letters, digits and bytes of other characters.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(20, (n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 1 << 22:  # longer ones are made anew, so that memory stays small
            _powers[base] = have
    return have[:n]


def slices(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each; a longer text stands alone."""
    begin, total = 0, 0
    for i, x in enumerate(texts):
        if total and total + len(x) > most:
            yield begin, i
            begin, total = i, 0
        total += len(x)
    if begin < len(texts):
        yield begin, len(texts)


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column's values as UTF-8; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Words:
    """Words of some texts in order: ``doc`` (row of each word), ``start``, ``end`` (byte places), ``counts`` a text."""

    def __init__(self, texts: list[bytes], allowed: np.ndarray):
        raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        self.n = len(texts)
        self.sizes = np.fromiter(map(len, texts), np.int64, self.n)
        self.first = np.concatenate([[0], np.cumsum(self.sizes + 1)])[: self.n]
        self.raw, self.low = raw, _LOWER[raw]
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = allowed[raw]
        step = np.diff(inside)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.doc = np.searchsorted(self.first, self.start, "right") - 1
        self.counts = np.bincount(self.doc, minlength=self.n)
        self._sums: np.ndarray | None = None

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of the lower-cased bytes between places; of all words without arguments."""
        if self._sums is None:
            self._sums = np.zeros(len(self.low) + 1, np.uint64)
            np.cumsum(_TABLE[self.low] * _power(_BASE, len(self.low)), out=self._sums[1:])
        start = self.start if start is None else start
        end = self.end if end is None else end
        if not len(start):
            return np.zeros(0, np.uint64)
        return mix((self._sums[end] - self._sums[start]) * _power(_INVERSE, len(self.low))[start] + (end - start).astype(np.uint64))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and where each text's begin (n + 1 places). Fewer words: the whole sequence, once."""
    h = words.hashes()
    first = np.concatenate([[0], np.cumsum(words.counts)])
    made = np.where(words.counts >= k, words.counts - k + 1, np.minimum(words.counts, 1))
    at = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(at[-1], np.uint64)
    whole = np.flatnonzero(words.counts >= k)
    if len(whole):
        doc = np.repeat(whole, made[whole])
        place = np.arange(len(doc)) - np.repeat(np.cumsum(made[whole]) - made[whole], made[whole])
        begin, value = first[doc] + place, np.full(len(doc), k, np.uint64)
        for j in range(k):
            value = value * np.uint64(_BASE) + h[begin + j]
        out[at[doc] + place] = mix(value)
    for n in range(1, k):
        short = np.flatnonzero(words.counts == n)
        value = np.full(len(short), n, np.uint64)
        for j in range(n):
            value = value * np.uint64(_BASE) + h[first[short] + j]
        out[at[short]] = mix(value)
    return out, at


def shingle_sets(texts: list[bytes], k: int, allowed: np.ndarray = NOT_BLANK) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    for a, b in slices(texts):
        h, at = shingles(Words(texts[a:b], allowed), k)
        for i in range(b - a):
            own = np.sort(h[at[i] : at[i + 1]])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
