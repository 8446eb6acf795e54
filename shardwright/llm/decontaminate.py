"""Benchmark decontamination by the q-gram lemma.

A stretch of a document within ``e`` edits of a benchmark passage of ``m`` characters shares
at least ``m + 1 - q * (e + 1)`` of the passage's q-grams, all on diagonals (place in
the document less place in the passage) at most ``e`` apart. So:

1. q-grams of all passages are the index: hash to (passage, place);
2. a document's q-grams are hashed by a rolling product and looked up in a bit table, so
   only hits cost more than a few array operations;
3. hits are counted per document, passage and diagonal band. Bands are ``2 w`` wide and start every
   ``w`` diagonals, with ``w = e + 1`` of the passage itself: any ``e + 1`` neighbouring diagonals
   lie in one band, so no match is split;
   Hits are walked in blocks of ``HITS``, each reduced to its distinct (band, passage q-gram) pairs, so a
   run of one sign in a text and in a passage costs time but no memory;
4. bands whose count of distinct passage q-grams meets the bound are verified: a banded
   alignment of the passage against the band's stretch of its document, many at a time (at most ``CELLS``
   cells of a row), or bit-parallel, one bit for each of its characters, for passages above ``LONG``.
   Places outside the document take no part, so a result does not depend on neighbours.

Texts are compared lower-cased, with runs of white space as one space. Documents are
cut into pieces of ``PIECE`` characters that overlap by more than the longest passage
and its edits, so memory is bounded for any text and no match falls between pieces.
Documents are not shuffled. The index is sent to the tasks only up to ``INDEX_BYTES``;
a larger benchmark is taken in parts of that size, one pass over the documents each, whose hits
are written before the next part is read.

Defined cases: null and empty texts and passages match nothing; passages shorter than
``q`` characters are matched exactly, as whole words, without edits; repeated rows are judged alike; repeated passages
keep the least ``item_id``; an empty benchmark or table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import staged
from shardwright.llm.texts import slices

Q = 12
EDIT_SHARE = 0.05          # edits allowed, as a share of the passage
PIECE = 1 << 20
INDEX_BYTES = 32 << 20
TABLE_BITS = 24
HITS, CELLS, LONG = 1 << 21, 1 << 18, 1024
STEP = np.uint64(0x9E3779B97F4A7C15)
RESULT = "doc_id long, item_id long, start long, end long, edits int, passage_chars int"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def gram_hashes(cps: np.ndarray, q: int) -> np.ndarray:
    """Hash of each run of ``q`` characters (doubling: a run of 2k is two runs of k)."""
    done, h = 1, (cps.astype(np.uint64) + np.uint64(1)) * STEP
    parts, total, at = [], None, 0
    size = q
    while size:
        if size & 1:
            parts.append((done, h))
        size >>= 1
        if size:
            h = (h[:len(h) - done] * np.uint64(0xBF58476D1CE4E5B9) + h[done:]) * STEP
            h ^= h >> np.uint64(29)
            done *= 2
    n = len(cps) - q + 1
    for width, values in parts:
        piece = values[at:at + n]
        total = piece.copy() if total is None else (total * np.uint64(0x94D049BB133111EB) + piece) * STEP
        at += width
    return total ^ (total >> np.uint64(32))


def budget(m: int, q: int, share: float) -> int:
    """The most edits within ``share`` of the passage for which the lemma still bounds; -1 if none."""
    return min(math.floor(share * m), (m + 1 - 1) // q - 1)


class Index:
    """The q-grams of the passages, sorted by hash, and a bit table in front."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, share: float = EDIT_SHARE) -> None:
        seen: dict[str, int] = {}
        short: dict[str, int] = {}
        for item, text in sorted(items):
            body = normal(text)
            if len(body) >= q:
                seen.setdefault(body, item)
            elif body:
                short.setdefault(body, item)
        self.q, self.items = q, np.array([*seen.values(), *short.values()], np.int64)     # short ones behind
        self.short = list(short)
        self.cps = [np.frombuffer(b.encode("utf-32-le"), np.uint32) for b in seen]
        self.chars = np.array([len(c) for c in self.cps], np.int64)
        self.edits = np.array([budget(m, q, share) for m in self.chars], np.int64)
        self.least = self.chars + 1 - q * (self.edits + 1)
        self.width = self.edits + 1                                        # of a band's step, for each passage
        self.overlap = int((self.chars + self.edits).max(initial=0)) + 1
        grams = [gram_hashes(c, q) for c in self.cps]
        h = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        who = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams]) if grams else np.zeros(0, np.int32)
        order = np.argsort(h, kind="stable")
        self.hash, self.who, self.at = h[order], who[order], at[order]
        self.keys, self.first = np.unique(self.hash, return_index=True)
        self.size = np.diff(np.append(self.first, len(h)))

    def table(self) -> np.ndarray:
        bits = np.zeros(1 << TABLE_BITS >> 3, np.uint8)
        slot = (self.keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        np.bitwise_or.at(bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        return bits

    def exact(self, whole: str) -> Iterator[tuple[int, int, int]]:
        """Passage, start and end of each place of a short passage that no letter or digit touches."""
        import ahocorasick

        words = ahocorasick.Automaton()
        for i, body in enumerate(self.short):
            words.add_word(body, (len(self.cps) + i, len(body)))
        words.make_automaton()
        for last, (who, size) in words.iter(whole):
            a, b = last + 1 - size, last + 1
            if not (a and whole[a - 1].isalnum() or b < len(whole) and whole[b].isalnum()):
                yield who, a, b

    def bands(self, cps: np.ndarray, begin: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """Passage, document, first diagonal and last diagonal of each band that meets its bound.

        ``begin`` is where each document starts in ``cps``."""
        none = np.zeros(0, np.int64)
        if len(cps) < self.q or not len(self.keys):
            return none, none, none, none
        h = gram_hashes(cps, self.q)
        slot = (h >> np.uint64(64 - TABLE_BITS)).astype(np.uint32)
        pos = np.flatnonzero(bits[slot >> np.uint32(3)] >> (slot & np.uint32(7)).astype(np.uint8) & 1)
        near = np.minimum(np.searchsorted(self.keys, h[pos]), len(self.keys) - 1)
        real = self.keys[near] == h[pos]
        pos, near = pos[real], near[real]
        n = self.size[near]
        total = np.cumsum(n)
        owner = np.searchsorted(begin, pos, "right") - 1
        base = int(self.chars.max())
        spread = len(cps) + base + 2

        def blocks() -> Iterator[tuple[np.ndarray, ...]]:
            """Index entry, passage, document and diagonal of the hits, ``HITS`` or one place's at a time."""
            at = 0
            while at < len(pos):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HITS, "right")))
                k = n[at:to]
                hit = np.repeat(self.first[near[at:to]] - np.cumsum(k) + k, k) + np.arange(k.sum())
                yield hit, self.who[hit].astype(np.int64), np.repeat(owner[at:to], k), np.repeat(pos[at:to], k) - self.at[hit] + base
                at = to

        # a pair with fewer hits than the bound has no band that meets it
        counted = [np.unique(who * len(begin) + doc, return_counts=True) for _, who, doc, _ in blocks()]
        if not counted:
            return none, none, none, none
        pairs, group = np.unique(np.concatenate([p for p, _ in counted]), return_inverse=True)
        pairs = pairs[np.bincount(group, np.concatenate([c for _, c in counted])) >= self.least[pairs // len(begin)]]
        held: tuple[list, list] = ([], [])
        for hit, who, doc, diagonal in blocks():                           # diagonals are never negative
            pair = who * len(begin) + doc
            enough = np.flatnonzero(np.isin(pair, pairs))
            hit, pair, diagonal, w = hit[enough], pair[enough], diagonal[enough], self.width[who[enough]]
            for shift in (0, 1):                                           # the two bands a diagonal lies in
                band = (diagonal + shift * w) // (2 * w) * 2 + 1 - shift
                held[shift].append(distinct(pair * spread + band, hit))    # an index entry counts once in a band
        found = []
        for parts_of in held:
            band, _ = distinct(*(np.concatenate(x) for x in zip(*parts_of))) if len(parts_of) > 1 else parts_of[0]
            keys, count = np.unique(band, return_counts=True)
            found.append(keys[count >= self.least[keys // spread // len(begin)]])
        keys = np.unique(np.concatenate(found))
        who, doc = np.divmod(keys // spread, len(begin))
        low = (keys % spread - 1) * self.width[who] - base
        return who, doc, low, low + 2 * self.width[who] - 1

    def verify(self, cps: np.ndarray, who: np.ndarray, low: np.ndarray, high: np.ndarray,
               first: np.ndarray, last: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``(band, start, end, edits)`` of the best alignment in each band within budget.

        Row i of the alignment is passage character i; column c is text place i + low + c - slack.
        Start and end are free between ``first`` and ``last``, the ends of the band's document
        in ``cps``; all bands of a batch advance row by row together."""
        out = self.verify_long(cps, who, low, high, first, last)
        order = np.argsort(self.chars[who], kind="stable")
        order = order[self.chars[who[order]] <= LONG]
        at = 0
        while at < len(order):
            widest = int(self.width[who[order[min(at + 255, len(order) - 1)]]])
            pick = order[at:at + max(1, min(256, CELLS // (4 * widest + 1)))]
            at += len(pick)
            w = who[pick]
            slack = int(self.width[w].max())
            m, e = self.chars[w], self.edits[w]
            left = low[pick] - slack
            cols = int((high[pick] - low[pick]).max()) + 1 + 2 * slack
            rows = int(m.max())
            pattern = np.zeros((len(pick), rows), np.uint32)
            for r, x in enumerate(w):
                pattern[r, :self.chars[x]] = self.cps[x]
            big = 1 << 20
            c = np.arange(cols)
            head, tail = first[pick][:, None], last[pick][:, None]
            begin = left[:, None] + c                                      # where the alignment started
            cost = np.where((begin >= head) & (begin <= tail), 0, big)     # nothing of the passage used yet
            for i in range(rows):
                place = left[:, None] + c + i
                inside = (place >= head) & (place < tail)
                same = inside & (cps[np.clip(place, 0, max(0, len(cps) - 1))] == pattern[:, i:i + 1])
                step = np.where(inside, cost + ~same, big)                 # match or replace
                frm = begin.copy()
                skip = np.full_like(cost, big)                             # passage character missing in the text
                skip[:, :-1] = cost[:, 1:] + 1
                better = skip < step
                step = np.where(better, skip, step)
                frm[:, :-1] = np.where(better[:, :-1], begin[:, 1:], frm[:, :-1])
                # a text character more: along the row, a running minimum of cost - column
                run = np.minimum.accumulate(step - c, axis=1) + c
                src = np.maximum.accumulate(np.where(step - c == run - c, c, 0), axis=1)
                frm = np.take_along_axis(frm, src, 1)
                alive = (i < m)[:, None]
                cost, begin = np.where(alive, np.minimum(run, big), cost), np.where(alive, frm, begin)
            cost = np.where(left[:, None] + c + m[:, None] <= tail, cost, big)
            best = cost.argmin(1)
            r = np.arange(len(pick))
            edits = cost[r, best]
            start, end = begin[r, best], left + best + m
            out += [(int(x), int(a), int(b), int(k)) for x, a, b, k, most in zip(pick, start, end, edits, e) if k <= most]
        return out


    def verify_long(self, cps: np.ndarray, who: np.ndarray, low: np.ndarray, high: np.ndarray,
                    first: np.ndarray, last: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The same for long passages: touching bands of a passage in a document are one stretch."""
        out, group = [], None
        order = [int(b) for b in np.lexsort((low, first, who)) if self.chars[who[b]] > LONG]
        for b in [*order, None]:
            if group is not None and (b is None or (who[b], first[b]) != (who[group[0]], first[group[0]]) or low[b] > group[2] + 1):
                k, w = group[0], int(who[group[0]])
                e, m = int(self.edits[w]), int(self.chars[w])
                a, z = max(int(first[k]), group[1] - e), min(int(last[k]), group[2] + m + e)
                edits, start, end = bit_parallel(self.cps[w], cps[a:z])
                if edits <= e:
                    out.append((k, a + start, a + end, edits))
                group = None
            if b is not None:
                group = (b, int(low[b]), int(high[b])) if group is None else (group[0], group[1], max(group[2], int(high[b])))
        return out


def distinct(key: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once."""
    order = np.lexsort((entry, key))
    key, entry = key[order], entry[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (entry[1:] != entry[:-1])
    return key[new], entry[new]


def bit_parallel(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Fewest edits of ``pattern`` against any stretch of ``text``, and the stretch, by bit-vectors of the
    alignment's columns (one bit for each pattern character)."""
    edits, end = _column_walk(pattern, text, free=True)
    _, back = _column_walk(pattern[::-1], text[:end][::-1], free=False)
    return edits, end - back, end


def _column_walk(pattern: np.ndarray, text: np.ndarray, free: bool) -> tuple[int, int]:
    """Least cost of the whole pattern against a stretch that ends at a text place, and the first such place; the
    stretch begins anywhere (``free``) or at the text's start."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = {}
    for c in np.unique(pattern).tolist():
        where[c] = int.from_bytes(np.packbits(pattern == c, bitorder="little").tobytes(), "little")
    rise, fall, score = full, 0, m                                         # where a column goes up or down by one
    best, at = m, 0
    for j, c in enumerate(text.tolist(), 1):
        eq = where.get(c, 0)
        xv = eq | fall
        xh = (((eq & rise) + rise) ^ rise) | eq
        up, down = fall | (full & ~(xh | rise)), rise & xh
        score += 1 if up & top else -1 if down & top else 0
        up = (up << 1 | (not free)) & full
        down = (down << 1) & full
        rise, fall = down | (full & ~(xv | up)), up & xv
        if score < best:
            best, at = score, j
    return best, at


def pieces(cps: np.ndarray, overlap: int) -> Iterator[tuple[int, np.ndarray]]:
    at = 0
    while True:
        yield at, cps[at:at + PIECE + overlap]
        at += PIECE
        if at >= len(cps):
            return


def _search(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = index.table()
        for part, t in slices(batches, "text"):
            texts = [normal(x) for x in t.array.to_pylist()]
            size = np.array([len(x) for x in texts], np.int64)
            # texts of a slice are searched as one, kept apart by a character no passage has
            whole = np.frombuffer("\x00".join(texts).encode("utf-32-le", "replace"), np.uint32)
            begin = np.cumsum(size + 1) - size - 1
            rows: dict[tuple[int, int], tuple[int, int, int]] = {}
            if index.short:
                for who, a, b in index.exact("\x00".join(texts)):
                    d = int(np.searchsorted(begin, a, "right")) - 1
                    rows.setdefault((d, who), (0, int(a - begin[d]), int(b - begin[d])))
            for at, piece in pieces(whole, index.overlap):
                near = int(np.searchsorted(begin, at, "right")) - 1         # documents of this piece
                there = begin[near:int(np.searchsorted(begin, at + len(piece)))] - at
                who, doc, low, high = index.bands(piece, there, bits)
                if not len(who):
                    continue
                first = np.maximum(there[doc], 0)
                last = np.minimum(there[doc] + size[near + doc], len(piece))
                for band, a, b, edits in index.verify(piece, who, low, high, first, last):
                    d = near + int(doc[band])
                    key, new = (d, int(who[band])), (edits, int(at + a - begin[d]), int(at + b - begin[d]))
                    rows[key] = min(rows.get(key, new), new)
            ids = part.column("doc_id").to_pylist()
            keys = sorted(rows)
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[d] for d, _ in keys], pa.int64()), pa.array([int(index.items[i]) for _, i in keys], pa.int64()),
                pa.array([rows[k][1] for k in keys], pa.int64()), pa.array([rows[k][2] for k in keys], pa.int64()),
                pa.array([rows[k][0] for k in keys], pa.int32()), pa.array([rows[k][2] - rows[k][1] if k[1] >= len(index.chars) else int(index.chars[k[1]]) for k in keys], pa.int32())],
                names=["doc_id", "item_id", "start", "end", "edits", "passage_chars"])

    return run


def parts(benchmark: DataFrame, limit: int = INDEX_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The passages in groups whose index stays below ``limit`` (16 bytes a character), one at a time."""
    group: list[tuple[int, str]] = []
    room = limit
    rows = benchmark.where("item_id is not null and text is not null and length(text) > 0").select(F.col("item_id").cast("long"), "text")
    seen: set[int] = set()
    for item, text in rows.orderBy("item_id", "text").toLocalIterator():
        if hash(body := normal(text)) in seen:
            continue
        seen.add(hash(body))
        if 16 * len(text) > room and group:
            yield group
            group, room = [], limit
        group.append((item, text))
        room -= 16 * len(text)
    yield group


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_share: float = EDIT_SHARE) -> DataFrame:
    """One row per document and passage found in it: where (in the normalised text), and the
    edits of the best alignment."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0)
    found, groups = None, parts(benchmark)
    group = next(groups)
    while group is not None:
        later = next(groups, None)
        hits = own.mapInArrow(_search(Index(group, q, edit_share)), RESULT)
        if later is not None or found is not None:                         # one part at a time is held and run
            hits = staged(hits, "contaminated")
        found = hits if found is None else found.unionByName(hits)
        group = later
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_share: float = EDIT_SHARE) -> DataFrame:
    """The rows of ``docs`` in which no passage of the benchmark is found.

    Only ids of contaminated documents are joined; rows with a null id are searched in
    place of their id by their text's hash."""
    keyed = docs.withColumn("_k", F.xxhash64("doc_id", "text"))
    hits = contaminated(keyed.select(F.col("_k").alias("doc_id"), "text"), benchmark, q, edit_share)
    return keyed.join(hits.select(F.col("doc_id").alias("_k")).distinct(), "_k", "left_anti").select(*docs.columns)
