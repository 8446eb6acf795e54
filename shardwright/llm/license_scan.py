"""License scans: short notices found in whole texts although a few characters differ.

Plan: one pass over Arrow batches, no shuffle. A text becomes its normal form: A-Z lower-cased,
its words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) with one space around each. A notice with at
most k edits is cut into k + 1 pieces; by the pigeonhole principle one of them stands unchanged in
every occurrence. All pieces of all notices are looked up in one Aho-Corasick pass over the normal
form of a slice; a piece found fixes where its notice would begin, and only there the ``regex``
library matches the notice with bounded errors (best match) and reports its span.

A notice is written as its words; edits may fall anywhere but in words in brackets (``under the
[mit] license``), which must stand as they are, so that another license's name is not an edit.
Places without an edit are always reported, also overlapping ones; of overlapping places of one
notice with edits the one with the fewest counts (ties: the first).

Defined cases. A null text counts as empty; an empty text has no words and no spans. Repeated rows
give repeated rows; null and repeated ids are carried along. An empty table gives an empty result.
Other columns of the input never clash: only those asked for are read. A very long text is a slice
of its own and takes about 8 bytes of memory a byte (its normal form twice, places of its words).
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.llm.texts import Texts, slices


@dataclass(frozen=True)
class Notice:
    label: str
    text: str                       # words in normal form; those in brackets allow no edit
    edits: int = 0
    base: bool = False

    @property
    def phrase(self) -> str:
        return " " + " ".join(self.text.replace("[", "").replace("]", "").split()) + " "


# fixed values: the notices looked for; the first three are the base phrases
NOTICES = (
    Notice("mit", "under the [mit] license", 2, base=True),
    Notice("apache-2", "[apache] license version [2]", 2, base=True),
    Notice("cc-by-nc", "cc by nc", 0, base=True),
    Notice("gpl-3", "[gnu] [general] public license version [3]", 3),
    Notice("gpl-2", "[gnu] [general] public license version [2]", 3),
    Notice("lgpl", "[gnu] [lesser] general public license", 3),
    Notice("agpl", "[gnu] [affero] general public license", 3),
    Notice("mpl-2", "[mozilla] public license version [2]", 3),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 8),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 7),
    Notice("unlicense", "free and unencumbered software released into the public domain", 5),
    Notice("cc-by-sa", "cc by sa", 0),
    Notice("cc-by-nd", "cc by nd", 0),
    Notice("reserved", "all rights reserved", 1),
)
SPANS = ("array<struct<notice: int, label: string, base: boolean, edits: int, score: double, first_word: bigint, "
         "last_word: bigint, start_byte: bigint, end_byte: bigint>>")
SPAN_TYPE = pa.list_(pa.struct([("notice", pa.int32()), ("label", pa.string()), ("base", pa.bool_()), ("edits", pa.int32()),
                                ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                                ("start_byte", pa.int64()), ("end_byte", pa.int64())]))
BLOCK = 1 << 20
# fixed values: the characters that are no part of a word
WORD = ~np.isin(np.arange(256), [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


class Normal:
    """The normal forms of a slice as one byte string: every word has one space on either side
    (neighbours share it). ``at`` is where each word begins, ``raw`` where it begins in the slice."""

    def __init__(self, t: Texts) -> None:
        parts, at, raw = [b" "], [], []
        size, held, cut = 1, False, iter(np.append(t.off[1:-1], -1).tolist())
        edge = next(cut)
        for lo in range(0, len(t.buf), BLOCK):
            low = LOWER[t.buf[lo:lo + BLOCK]]
            word = WORD[low]
            first = np.empty(len(word), bool)                      # a word begins after a gap and with a text
            first[0], first[1:] = not held, ~word[:-1]
            edges = []
            while lo <= edge < lo + len(word) if edge >= 0 else False:
                edges.append(edge - lo)
                edge = next(cut)
            first[edges] = True
            first &= word
            place = np.cumsum(word)                                # bytes of words up to here
            starts = np.flatnonzero(first)
            before = place[starts] - 1                             # bytes of words before each start
            out = np.full(int(place[-1]) + len(starts), 32, np.uint8)
            body = np.flatnonzero(word)
            out[np.arange(len(body)) + np.cumsum(first)[body]] = low[body]
            # each word is preceded by its space; the word that a block continues is not
            parts.append(out.tobytes())
            at.append(size + before + np.arange(1, len(starts) + 1))
            raw.append(lo + starts)
            size += len(out)
            held = bool(word[-1])
        # the first word's space is there twice: the string begins with the second
        self.text = b"".join([*parts[1:], b" "])
        self.at = (np.concatenate(at) if at else np.zeros(0, np.int64)) - 1
        self.raw = np.concatenate(raw) if raw else np.zeros(0, np.int64)
        self.bounds = np.searchsorted(self.raw, t.off)             # words of text d: bounds[d] .. bounds[d + 1]


class Scanner:
    """Pieces of the notices in one automaton, and a pattern with bounded errors for each."""

    def __init__(self, notices: Sequence[Notice]) -> None:
        import ahocorasick

        self.notices = notices
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.patterns, self.words = [], []
        for i, n in enumerate(notices):
            phrase, m = n.phrase, len(n.phrase)
            cuts = [m * j // (n.edits + 1) for j in range(n.edits + 2)]
            if m <= max(2, 10 * n.edits):                          # else two places could share a window
                raise ValueError(f"notice {n.text!r} needs more than ten characters for each edit")
            for a, b in zip(cuts, cuts[1:]):
                pieces[phrase[a:b].encode().decode("latin-1")].append((i, len(phrase[:a].encode())))
            self.patterns.append(regex.compile(self.pattern(n)))
            self.words.append([w[1:-1].encode() for w in n.text.split() if w.startswith("[")])
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        self.size = [len(n.phrase.encode()) for n in notices]
        self.exact = [n.phrase.encode() for n in notices]

    @staticmethod
    def pattern(n: Notice) -> str:
        """Fuzzy runs between fixed words; the best match has the fewest edits in all."""
        runs, held = [], [""]
        for w in n.text.split():
            if w.startswith("["):
                runs += [held[0] + " ", w[1:-1]]
                held[0] = ""
            else:
                held[0] += " " + w
        runs.append(held[0] + " ")
        return "(?b)" + "".join(regex.escape(r, special_only=True, literal_spaces=True) if j % 2 else
                                f"(?:{regex.escape(r, special_only=True, literal_spaces=True)}){{e<={n.edits}}}"
                                for j, r in enumerate(runs))

    def candidates(self, text: str) -> set[tuple[int, int]]:
        """Notices and where they would begin, for each piece that stands in the text."""
        found: set[tuple[int, int]] = set()
        for end, (size, places) in self.automaton.iter(text):
            begin = end - size + 1
            for i, offset in places:
                found.add((i, begin - offset))
        return found

    def verify(self, text: bytes, i: int, at: int, lo: int, hi: int) -> tuple[int, int, int] | None:
        """Edits and span of notice ``i`` around ``at``, inside the text's own [lo, hi)."""
        n = self.notices[i]
        if at >= lo and at + self.size[i] <= hi and text.startswith(self.exact[i], at):
            return 0, at, at + self.size[i]
        if not n.edits:
            return None
        a, b = max(lo, at - 4 * n.edits), min(hi, at + self.size[i] + 4 * n.edits)
        while a > lo and 0x80 <= text[a] < 0xC0:                   # edits are counted in characters
            a -= 1
        while b < hi and 0x80 <= text[b] < 0xC0:
            b += 1
        if a >= b or not all(w in text[a:b] for w in self.words[i]):
            return None
        window = text[a:b].decode()
        m = self.patterns[i].search(window)
        if m is None or sum(m.fuzzy_counts) > n.edits:
            return None
        start = a + len(window[:m.start()].encode())
        return sum(m.fuzzy_counts), start, start + len(m.group().encode())

    def spans(self, t: Texts) -> tuple[np.ndarray, list[list[dict] | None]]:
        """Words of each text of a slice, and its spans in order."""
        form = Normal(t)
        out: list[list[dict]] = [[] for _ in range(t.n)]
        byplace = sorted(self.candidates(form.text.decode("latin-1")), key=lambda c: (c[1], c[0])) if len(form.at) else []
        kept: dict[tuple[int, int], set[tuple[int, int, int]]] = defaultdict(set)
        for i, at in byplace:
            # the texts that the place may lie in: those of the words from its first to its last character
            w = np.searchsorted(form.at, [max(0, at - 4), at + self.size[i] + 4], "right") - 1
            docs = np.searchsorted(form.bounds, np.maximum(w, 0), "right") - 1
            for d in range(int(docs[0]), int(docs[1]) + 1):
                if form.bounds[d] == form.bounds[d + 1]:
                    continue
                hit = self.verify(form.text, i, at, *self.region(form, d))
                if hit:
                    kept[d, i].add(hit)
        for (d, i), hits in kept.items():
            out[d] += [self.span(form, t, d, i, *h) for h in self.best(sorted(hits))]
        for spans in out:
            spans.sort(key=lambda s: (s["start_byte"], s["notice"], s["end_byte"]))
        return np.diff(form.bounds), out

    @staticmethod
    def region(form: Normal, d: int) -> tuple[int, int]:
        lo, hi = int(form.bounds[d]), int(form.bounds[d + 1])
        end = int(form.at[hi]) if hi < len(form.at) else len(form.text)
        return int(form.at[lo]) - 1, end

    @staticmethod
    def best(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Of overlapping hits (by edits, then place) the first; those without edits all."""
        taken: list[tuple[int, int]] = []                          # disjoint unless without edits, by start
        out = []
        for edits, a, b in hits:
            j = bisect.bisect_left(taken, (a, b))
            if edits and (j and taken[j - 1][1] - 1 > a or j < len(taken) and taken[j][0] < b - 1):
                continue                                           # the shared space is no overlap
            taken.insert(j, (a, b))
            out.append((edits, a, b))
        return out

    def span(self, form: Normal, t: Texts, d: int, i: int, edits: int, a: int, b: int) -> dict:
        n = self.notices[i]
        first = int(np.searchsorted(form.at, a + 1, "right")) - 1 if form.text[a] == 32 else int(np.searchsorted(form.at, a, "right")) - 1
        last = int(np.searchsorted(form.at, b - 1, "left")) - 1
        first, last = max(first, int(form.bounds[d])), min(last, int(form.bounds[d + 1]) - 1)
        end = int(form.at[last + 1]) - 1 if last + 1 < len(form.at) else len(form.text) - 1
        return {"notice": i, "label": n.label, "base": n.base and not edits, "edits": edits,
                "score": max(0.0, 1 - edits / len(n.phrase.strip())),
                "first_word": first - int(form.bounds[d]), "last_word": last - int(form.bounds[d]),
                "start_byte": int(form.raw[first] - t.off[d]),
                "end_byte": int(form.raw[last] - t.off[d]) + end - int(form.at[last])}


def scan(docs: DataFrame, notices: Sequence[Notice] = NOTICES, text: str = "text", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of every row with ``n_words`` and ``spans``, the places of all notices: label, edits,
    score (1 less the share of edited characters), first and last word (from 0), UTF-8 bytes in the text."""
    notices = tuple(notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for part, t in slices(batches, "_text"):
            n, spans = scanner.spans(t)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in columns), pa.array(n, pa.int64()), pa.array(spans, SPAN_TYPE)],
                [*columns, "n_words", "spans"])

    held = docs.select(*columns, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return held.mapInArrow(run, f"{fields}, n_words long, spans {SPANS}")


def digest(found: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Of ``scan``: number, first and last of the base places, labels of these and of all, best score."""
    base = F.filter("spans", lambda s: s["base"])
    labels = lambda spans: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))))
    firsts = F.transform(base, lambda s: s["first_word"])
    return found.select(*columns, "n_words", F.size(base).cast("long").alias("n_base"),
                        F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
                        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
                        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"))
