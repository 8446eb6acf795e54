"""Whole texts of an Arrow batch as numpy arrays: words, lines, hashes, counts.

Everything works on slices of a batch that hold about ``SLICE_BYTES`` of text (a
longer text is a slice of its own), so memory follows the slice, not the batch.
Equality of words, lines and word runs is equality of 64-bit hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
# fixed values: the bytes that separate words, and those counted as symbols
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
BYTE = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
RUN = np.random.default_rng(0xA11).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, SLICE_BYTES + (1 << 16))
            up, down = np.full(m, BASE, np.uint64), np.full(m, pow(BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up[:n], self.down[:n]


class Texts:
    """A slice: ``buf`` holds the bytes of its texts, ``off`` where each begins and ends."""

    def __init__(self, column: pa.Array, powers: Powers | None = None) -> None:
        self.null = np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
        a = pc.fill_null(column, "").cast(pa.large_string())
        self.n = len(a)
        off = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        data = a.buffers()[2] if self.n else None
        self.buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.off = off - off[0]
        self.array = a
        self.powers = powers or Powers()

    def split(self) -> Texts:
        """Finds the words: ``start``, ``end`` (bytes), ``count`` per text, ``doc`` per word."""
        space = SPACE[self.buf]
        inside = ~space
        held = self.off[1:] > self.off[:-1]
        first, last = self.off[:-1][held], self.off[1:][held] - 1
        s, e = inside.copy(), inside.copy()
        s[1:] &= space[:-1]
        e[:-1] &= space[1:]
        s[first], e[last] = inside[first], inside[last]
        self.inside, self.start, self.end = inside, np.flatnonzero(s), np.flatnonzero(e) + 1
        self.count = np.diff(np.searchsorted(self.start, self.off))
        self.doc = np.repeat(np.arange(self.n), self.count)
        return self

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each span of bytes, wherever it stands."""
        if not hasattr(self, "sums"):
            up, _ = self.powers.upto(len(self.buf) + 1)
            self.sums = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum(BYTE[self.buf] * up[:-1], out=self.sums[1:])
        _, down = self.powers.upto(len(self.buf) + 1)
        return mix((self.sums[end] - self.sums[start]) * down[start])

    def word_hash(self) -> np.ndarray:
        if not hasattr(self, "words"):
            self.words = self.spans(self.start, self.end)
        return self.words

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words of one text, and the word each begins at."""
        h = self.word_hash()
        if len(h) < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        m = len(h) - k + 1
        r = np.zeros(m, np.uint64)
        for j in range(k):
            r += h[j:m + j] * RUN[j]
        at = np.flatnonzero(self.doc[:m] == self.doc[k - 1:])
        return mix(r[at]), at

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Number of true bytes in each text."""
        return np.diff(np.searchsorted(np.flatnonzero(flags), self.off))

    def sums_of(self, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Sums of ``values`` between consecutive ``bounds``."""
        c = np.zeros(len(values) + 1, np.float64)
        np.cumsum(values, out=c[1:])
        return np.diff(c[bounds])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines that hold a word: hash, text number, number of bytes."""
        feed = np.flatnonzero(self.buf == 10)
        start = np.union1d(self.off[:-1], feed + 1)
        start = start[start < len(self.buf)]
        doc = np.searchsorted(self.off, start, "right") - 1
        end = np.minimum(np.append(feed, len(self.buf))[np.searchsorted(feed, start)], self.off[doc + 1])
        word = np.searchsorted(self.start, end) > np.searchsorted(self.start, start)
        start, end = start[word], end[word]
        return self.spans(start, end) + (end - start).astype(np.uint64), doc[word], end - start

    def repeated_lines(self) -> np.ndarray:
        h, doc, _ = self.lines()
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        again = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        return np.bincount(doc[1:][again], minlength=self.n)

    def repeated_words(self, k: int = 3) -> np.ndarray:
        """Words inside runs of ``k`` words that the text holds twice or more."""
        r, at = self.runs(k)
        key = r ^ mix(self.doc[at].astype(np.uint64) + np.uint64(1))
        order = np.sort(key)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if not len(twice):
            return np.zeros(self.n, np.int64)
        near = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        hit = at[twice[near] == key]
        covered = np.zeros(len(self.doc), bool)
        for j in range(k):
            covered[hit + j] = True
        return np.bincount(self.doc[covered], minlength=self.n)


def give_back() -> None:
    """Returns freed memory to the system: a worker stays and serves other stages next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass                                                   # another C library: nothing to do


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The batches cut into runs of rows with about ``limit`` bytes of text."""
    powers = Powers()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
        total = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
            part = batch.slice(at, to - at)
            yield part, Texts(part.column(text), powers)
            at = to
        del batch, part
        give_back()
