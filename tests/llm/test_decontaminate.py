import random

import numpy as np
import pytest

from shardwright.llm import decontaminate as D

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
WORDS = "the of and tion er on ing re ed nd ou th ha or ti hi as to es nt is it en al st an".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(WORDS, k=rng.randint(1, 4))) for _ in range(n))


def distance(a, b):
    """Least edits between ``a`` and any stretch of ``b`` (free ends in ``b``)."""
    row = np.zeros(len(b) + 1, int)
    for i, x in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = i
        step = np.minimum(row[:-1] + (np.frombuffer(b.encode("utf-32-le"), np.uint32) != ord(x)), row[1:] + 1)
        for j in range(len(b)):
            new[j + 1] = min(step[j], new[j] + 1)
        row = new
    return int(row.min())


def brute(docs, items):
    out, seen = {}, {}
    for item, text in sorted(x for x in items if x[0] is not None):
        body = D.normal(text or "")
        if len(body) >= D.Q and D.budget(len(body), D.Q, D.EDIT_SHARE) >= 0:
            seen.setdefault(body, item)
    for doc, text in docs:
        for body, item in seen.items():
            k = distance(body, D.normal(text or ""))
            if k <= D.budget(len(body), D.Q, D.EDIT_SHARE):
                out[doc, item] = k
    return out


def found(make, docs, items):
    rows = D.contaminated(make(docs, DOCS), make(items, ITEMS)).collect()
    return rows, {(r["doc_id"], r["item_id"]): r["edits"] for r in rows}


def edited(rng, text, k):
    for _ in range(k):
        i = rng.randrange(len(text))
        kind = rng.randrange(3)
        text = text[:i] + ("" if kind == 0 else rng.choice("qxz")) + text[i + (kind != 2):]
    return text


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    items = [(i, prose(rng, rng.randint(8, 40))) for i in range(25)] + [(100, items_first := prose(rng, 30)), (101, items_first), (102, "short"), (103, None), (104, "")]
    docs = []
    for d in range(36):
        text = prose(rng, rng.randint(0, 120))
        if d % 2:
            body = items[d % 26][1]
            body = edited(rng, body, rng.randint(0, max(0, len(body) // 12)))
            cut = rng.randint(0, len(text))
            text = text[:cut] + " " + (body.upper() if d % 5 == 0 else body.replace(" ", "  \n") if d % 7 == 0 else body) + " " + text[cut:]
        docs.append((d, text))
    return docs + [(200, None), (201, ""), (202, items[0][1]), (203, items[1][1] + " " + items[2][1])], items


def test_agrees_with_every_alignment(make, corpus):
    docs, items = corpus
    rows, got = found(make, docs, items)
    want = brute(docs, items)
    assert got == want and len(want) > 8 and len(set(want.values())) > 3
    text, body = {d: D.normal(t or "") for d, t in docs}, {i: D.normal(t or "") for i, t in items}
    for r in rows:
        assert distance(body[r["item_id"]], text[r["doc_id"]][r["start"]:r["end"]]) == r["edits"]


def test_small_pieces_lose_nothing(make, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(D, "PIECE", 64)
    index = D.Index([x for x in items if x[1]], D.Q, D.EDIT_SHARE)
    want = brute(docs, items)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in docs]), "text": pa.array([t for _, t in docs])})
    got = {}
    for out in D._search(index)([batch]):
        got |= {(r["doc_id"], r["item_id"]): r["edits"] for r in out.to_pylist()}
    assert got == want


def test_benchmark_in_parts_gives_the_same(make, corpus, monkeypatch):
    docs, items = corpus
    whole = found(make, docs, items)[1]
    groups = list(D.parts(make(items, ITEMS), 8000))
    assert len(groups) > 2 and sum(map(len, groups)) == 27     # 28 with a text, one twice
    monkeypatch.setattr(D, "parts", lambda b: iter(groups))
    assert found(make, docs, items)[1] == whole


def test_stage_drops_only_the_contaminated(make, corpus):
    docs, items = corpus
    bad = {d for d, _ in brute(docs, items)}
    repeated = docs + [(None, None), (None, items[3][1]), docs[2], docs[2]]
    out = D.decontaminate(make(repeated, DOCS), make(items, ITEMS))
    assert out.columns == ["doc_id", "text", "shard", "epoch"]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(
        ((d, t) for d, t in repeated if d not in bad and not (d is None and t)), key=str)


def test_empty_tables_and_a_long_text(make, corpus):
    docs, items = corpus
    assert found(make, [], items)[0] == [] and found(make, docs, [])[0] == []
    rng = random.Random(9)
    long = "filler words without end " * 120_000
    rows, got = found(make, [(1, long + items[4][1] + long)], items)
    assert got == {(1, 4): 0} and rows[0]["end"] - rows[0]["start"] == len(D.normal(items[4][1]))


def searched(docs, items):
    """The documents searched as one batch: they are neighbours in a slice."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in docs]), "text": pa.array([t for _, t in docs])})
    rows = [r for out in D._search(D.Index(items))([batch]) for r in out.to_pylist()]
    return rows, {(r["doc_id"], r["item_id"]): r["edits"] for r in rows}


def test_passage_cut_at_an_end_of_a_document_behind_another():
    rng = random.Random(11)
    passage = D.normal(prose(rng, 40))
    docs = [(0, prose(rng, 30))]
    for d, cut in enumerate((passage[1:], passage[3:], passage[:-3]), 1):
        docs += [(d, cut), (d + 10, cut + " " + prose(rng, 20)), (d + 20, prose(rng, 20) + " " + cut), (d + 30, prose(rng, 5))]
    rows, got = searched(docs, [(7, passage)])
    assert got == brute(docs, [(7, passage)]) and {1, 2, 3, 11, 12, 23} <= {d for d, _ in got}
    text = {d: D.normal(t) for d, t in docs}
    for r in rows:
        assert 0 <= r["start"] <= r["end"] <= len(text[r["doc_id"]])
        assert distance(passage, text[r["doc_id"]][r["start"]:r["end"]]) == r["edits"]


def test_short_copies_in_neighbours_beside_a_long_item():
    rng = random.Random(12)
    short, long = D.normal(prose(rng, 40))[:60].strip(), D.normal(prose(rng, 1200))[:5000].strip()
    items = [(1, short), (2, long)]
    docs = [(d, prose(rng, 3) + " " + (edited(rng, short, 1) if d % 3 == 0 else short)) for d in range(12)] + [(50, long)]
    rows, got = searched(docs, items)
    assert got == brute(docs, items) and {d for d, i in got if i == 1} == set(range(12)) and got[50, 2] == 0
    index = D.Index(items)
    assert dict(zip(index.items.tolist(), index.width.tolist())) == {i: D.budget(len(t), D.Q, D.EDIT_SHARE) + 1 for i, t in items}


def test_edited_passage_at_every_offset():
    """Its hits lie on neighbouring diagonals, which must meet in one band wherever it starts."""
    rng = random.Random(13)
    passage = D.normal(prose(rng, 40))[:100].strip()
    k = D.budget(len(passage), D.Q, D.EDIT_SHARE)
    cuts = [len(passage) * i // (k + 1) for i in range(k + 2)]
    body = "\u00e9".join(passage[a:b] for a, b in zip(cuts, cuts[1:]))     # one character more between any two stretches
    docs = [(lead, "x" * lead + body) for lead in range(4 * k)]
    assert k > 3 and searched(docs, [(1, passage)])[1] == {(lead, 1): k for lead, _ in docs}


def test_short_items_are_matched_exactly_as_words(make):
    items = [(1, "Ab  c"), (2, "7"), (3, "ab c"), (4, "née"), (5, "a long item of more than twelve")]
    docs = [(0, "x AB C y"), (1, "xab c"), (2, "ab c"), (3, "ab\nc."), (4, "77 8"), (5, "(7)"), (6, "NÉE"), (7, "abc"), (8, None), (9, "ab"), (10, "c 7 ab c ab c")]
    rows, hits = found(make, docs, items)
    assert set(hits) == {(0, 1), (2, 1), (3, 1), (5, 2), (6, 4), (10, 1), (10, 2)} and set(hits.values()) == {0}
    text = dict(docs)
    for r in rows:
        body = D.normal(text[r["doc_id"]])[r["start"]:r["end"]]
        assert body in ("ab c", "7", "née") and r["passage_chars"] == len(body)


def test_a_run_of_one_sign_does_not_fill_memory():
    """A passage with a rule of dashes against a page of them: hits are walked in blocks."""
    import tracemalloc

    rule = "-" * 200
    index = D.Index([(1, "the title of the item " + rule), (2, rule)])
    text = np.frombuffer(("a" * 50 + "-" * 100_000 + " and the title of the item " + rule).encode("utf-32-le"), np.uint32)
    bits = index.table()
    tracemalloc.start()
    who, doc, low, high = index.bands(text, np.zeros(1, np.int64), bits)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(index.items[who].tolist()) == {1, 2} and peak < 700 << 20
    monkey = D.HITS
    try:
        D.HITS = 1000
        few = np.frombuffer(("b" + "-" * 700 + " the title of the item " + rule).encode("utf-32-le"), np.uint32)
        small = [x.tolist() for x in index.bands(few, np.zeros(1, np.int64), bits)]
        D.HITS = monkey
        assert small == [x.tolist() for x in index.bands(few, np.zeros(1, np.int64), bits)] and small[0]
    finally:
        D.HITS = monkey


@pytest.mark.parametrize("edits", [0, 1, 5, 40])
def test_bit_parallel_alignment(edits):
    rng = random.Random(edits)
    codes = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
    passage = "".join(rng.choice("abcé ") for _ in range(rng.randint(1, 90)))
    for _ in range(20):
        text = "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 60))) + edited(rng, passage + " ", edits) + "".join(rng.choice("abc") for _ in range(20))
        k, a, b = D.bit_parallel(codes(passage), codes(text))
        assert k == distance(passage, text)
        whole = D._column_walk(codes(passage), codes(text[a:b]), free=False)
        assert k in (len(passage), whole[0]) or a == b


def test_a_very_long_passage_is_found_in_time(make):
    import time

    rng = random.Random(9)
    passage = D.normal(prose(rng, 5000))[:20_000].strip()
    docs = [(d, prose(rng, 30) + " " + edited(rng, passage, 30 * (d % 3)) + " " + prose(rng, 30)) for d in range(12)] + [(50, prose(rng, 4000))]
    began = time.time()
    rows, hits = found(make, docs, [(1, passage), (2, prose(rng, 20))])
    assert {d for d, i in hits if i == 1} == set(range(12)) and time.time() - began < 60
    assert all(hits[d, 1] <= 30 * (d % 3) for d in range(12)) and all(hits[d, 1] == 0 for d in range(0, 12, 3))
