"""License scans against plain words and against edit distances by dynamic programming."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from shardwright.llm import license_scan as L
from shardwright.llm.queries import QUERIES, table
from shardwright.llm.texts import Texts

ODD = ["", None, " ", "...", "Under the MIT license", "x under the mit license", "under the MIT\nlicense under... the mit license!",
       "CC-BY-NC cc by nc 4.0", "cc by", "the Apache Licence, Version 2.0", "unde the mit licence", "under the bit license", "é under thé mit license ü",
       "under the mit", "license", "Licensed under the Apache License, Version 2.0.", "APACHE LICENSE VERSION 3", "GNU General Public Licence Version 3",
       "All rights reservéd", "under the mit license" * 2, "ccbync", "İ cc by nc", "all rights reserved all rights reserved"]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def base_places(t):
    w = words(t)
    return sorted((i, n.label) for n in L.NOTICES if n.base for p in [n.phrase.split()] for i in range(len(w)) if w[i:i + len(p)] == p)


def least_edits(notice, t):
    """Edits of the best place of a notice in the normal form, none inside its fixed words."""
    text = " " + "".join(w + " " for w in words(t)) if words(t) else ""
    phrase, fixed = notice.phrase, set()
    at = 1
    for w in notice.text.split():
        if w.startswith("["):
            fixed |= set(range(at, at + len(w) - 2))
        at += len(w.strip("[]")) + 1
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(phrase):
        held = i in fixed
        row = [10 ** 6 if held else prev[0] + 1]
        for j, x in enumerate(text):
            best = prev[j] if c == x else 10 ** 6 if held else prev[j] + 1
            if not held:
                best = min(best, prev[j + 1] + 1)
            if not (held and i + 1 in fixed):                     # characters between two fixed ones are edits inside
                best = min(best, row[j] + 1)
            row.append(best)
        prev = row
    return min(prev)


def scanned(texts, notices=L.NOTICES):
    n, spans = L.Scanner(notices).spans(Texts(pa.array(texts, pa.string())))
    return list(zip(n.tolist(), spans))


@pytest.mark.parametrize("block", [1 << 20, 3, 11])
def test_base_places_and_spans(monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    rng = random.Random(5)
    parts = ["under", "the", "MIT", "license", "cc", "by", "nc", "apache", "version", "2", "\n", "--", "ü", "  ", "under the mit license"]
    texts = ODD + [" ".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(150)]
    for t, (n, spans) in zip(texts, scanned(texts)):
        assert n == len(words(t))
        assert sorted((s["first_word"], s["label"]) for s in spans if s["base"]) == base_places(t)
        for s in spans:
            raw = (t or "").encode()[s["start_byte"]:s["end_byte"]].decode()
            assert words(raw) == words(t)[s["first_word"]:s["last_word"] + 1]


def test_edits_against_dynamic_programming():
    rng = random.Random(7)
    texts = []
    for _ in range(400):
        t = " ".join(rng.choice(["lorem", "the", "license", "été", "public"]) for _ in range(rng.randint(0, 4)))
        s = list(" " + rng.choice(L.NOTICES).phrase.strip() + " ")
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(s))
            s[i:i + 1] = rng.choice([[], [s[i], rng.choice("aé x")], [rng.choice("bö z")]])
        texts.append(t + "".join(s) + t)
    for t, (_, spans) in zip(texts, scanned(texts)):
        for i, n in enumerate(L.NOTICES):
            want = least_edits(n, t)
            got = min((s["edits"] for s in spans if s["notice"] == i), default=None)
            assert got == (want if want <= n.edits else None), (t, n, want, got)


def test_own_notices_and_their_bounds():
    own = (L.Notice("own", "straße [eins] zwei drei vier", 2),)
    assert [s["edits"] for s in scanned(["die strase eins zwei drei vier da"], own)[0][1]] == [1]
    assert not scanned(["die straße zwei drei vier da"], own)[0][1]
    with pytest.raises(ValueError):
        L.Scanner((L.Notice("short", "cc by", 1),))


def test_many_seeds_and_a_very_long_text():
    long = "license " * 60_000 + "under the mit licence " + "x" * 100_000 + " cc by nc"
    (n, spans), = scanned([long])
    assert n == 60_000 + 4 + 4 and [s["label"] for s in spans if not s["edits"]] == ["cc-by-nc"]
    assert [(s["label"], s["edits"]) for s in spans if s["edits"]] == [("mit", 1)]


def test_rows(spark, make):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "cc by nc"), (3, "cc by nc")] * 2
    got = L.digest(L.scan(make(rows, "doc_id long, text string").withColumn("n_words", L.F.lit("x")).withColumn("spans", L.F.lit(1)))).collect()
    assert len(got) == len(rows)
    want = sorted((-1 if i is None else i, len(words(t)), len(base_places(t)), min((p for p, _ in base_places(t)), default=None),
                   max((p for p, _ in base_places(t)), default=None), ",".join(sorted({x for _, x in base_places(t)}))) for i, t in rows)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((-1 if r["doc_id"] is None else r["doc_id"], *r[1:6]) for r in got), key=key) == sorted(want, key=key)
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in got)
    assert L.digest(L.scan(make([], "doc_id long, text string"))).collect() == []


def test_query(spark, small):
    text = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    got = QUERIES["op11_license_scan"](spark, small).collect()
    assert len(got) == len(text)
    for r in got:
        places = base_places(text[r["doc_id"]])
        assert (r["n_words"], r["n_base"]) == (len(words(text[r["doc_id"]])), len(places))
        for i, n in enumerate(L.NOTICES):
            if n.label == "gpl-3" and len(text[r["doc_id"]]) < 3000:
                assert ("gpl-3" in r["labels"].split(",")) == (least_edits(n, text[r["doc_id"]]) <= n.edits)
    assert np.all([0 <= r["score"] <= 1 for r in got])
