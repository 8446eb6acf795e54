import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from shardwright.llm import jaccard_join as J

SCHEMA = "doc_id long, text string"


def runs_of(t):
    w = (t or "").split()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """Class and number of links of every row, by comparing all pairs."""
    sets = [runs_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        least[find(a)].append(i)
    return [(i, min((x for x in least[find(a)] if x is not None), default=None), links[a]) for a, (i, _) in enumerate(rows)]


def answer(make, rows):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in J.classes(make(rows, SCHEMA)).collect()), key=str)


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def near(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
    return w


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out, common = [], prose(rng, 60)
    for _ in range(60):
        base = prose(rng, rng.randint(3, 200))
        if rng.random() < 0.5:
            base = base + common                                        # a passage that many share
        out.append(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            out.append(near(rng, base, rng.randint(0, max(1, len(base) // 25))))
    texts = [" ".join(w) for w in out] + ["one", "one", "one two", " ", "", None, "one  \n two", "a a a a a a a a"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_classes_and_links(make, rows):
    assert answer(make, rows) == sorted(brute(rows), key=str)


def test_large_groups_in_blocks(make, monkeypatch):
    """A group of near copies, a group of exact ones and a common passage, all above the limit."""
    monkeypatch.setattr(J, "LIMIT", 16)
    monkeypatch.setattr(J, "VERIFY", 16)
    monkeypatch.setattr(J, "DEPTH", 2)
    rng = random.Random(2)
    base, passage = prose(rng, 150), prose(rng, 50)
    texts = [" ".join(near(rng, base, rng.randint(0, 5))) for _ in range(90)] + [" ".join(base[:140])] * 60
    texts += [" ".join(prose(rng, 40) + passage) for _ in range(80)]
    rows = list(enumerate(texts))
    assert answer(make, rows) == sorted(brute(rows), key=str)


def test_null_ids_repeated_ids_and_empty_table(make):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(None, t), (None, t), (4, t), (4, t), (2, t + " x"), (4, "other words are not the same at all"), (None, None), (None, "lone words stand here today")]
    assert answer(make, rows) == sorted(brute(rows), key=str)
    assert answer(make, []) == []


def test_one_of_each_class_stays(make, rows):
    more = rows + [rows[3], rows[3], (None, "null id words in a row here"), (None, "null id words in a row here"), (10_000, "x " * 50_000)]
    out = J.deduplicate(make(more, SCHEMA))
    assert out.columns == ["doc_id", "text", "shard", "epoch"]
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    want = Counter()
    sets = [runs_of(t) for _, t in more]
    seen = set()
    for (i, t), (_, c, _), s in sorted(zip(more, brute(more), sets), key=lambda x: str(x[0])):
        if not s:
            want[i, t] += 1
        elif i == c or i is None:
            if (c, t if c is None else None) not in seen:
                want[i, t] += 1
                seen.add((c, t if c is None else None))
    assert got == want


def test_stars_find_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5100)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["rid"]: r["root"] for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(a != b and x in (a, b) for a, b in edges)}


def test_recall_of_single_links(make):
    """Pairs just above 0.8, each alone: repeated runs find at least nine in ten (here: all)."""
    rng = random.Random(6)
    rows = []
    for k in range(150):
        base = prose(rng, 104)
        other = list(base)
        other[2], other[50] = "u", "v"                                  # 8 of 100 runs change: 92 / 108
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    found = sum(n == 1 for _, _, n in answer(make, rows))
    assert found >= 0.99 * len(rows)


def test_runs_reach_the_recall_under_one_shared_vector():
    """Single links walked down all their splits, with coordinates drawn as the nodes draw them."""
    assert J.least_agreeing(0.8) == 39 and J.runs_needed(0.8, 39) == 20
    rng = np.random.default_rng(3)

    for similar in (0.7, 0.8, 0.9):
        agree = J.least_agreeing(similar)
        runs = J.runs_needed(similar, agree)
        assert J.recall(similar, runs, agree) >= 0.999 > J.recall(similar, runs - 1, agree)
        alike = rng.random((4000, J.COORDS)) < similar
        found = np.zeros(len(alike), bool)
        for _ in range(runs):
            paths = np.ones(len(alike), int)                              # a pair's common paths
            for _ in range(J.DEPTH + 1):
                left = np.zeros(len(alike), int)
                for k in range(paths.max(initial=0)):
                    a, b = rng.integers(0, J.COORDS, (2, len(alike)))
                    r = np.arange(len(alike))
                    left += (k < paths) * (alike[r, a].astype(int) + (alike[r, b] & (rng.integers(0, J.SECOND, len(alike)) == 0)))
                paths = left
            found |= paths > 0
        found &= alike.sum(1) >= agree
        assert found.mean() > 0.9965


def test_rounds_go_on_until_the_measured_recall_is_reached(make, monkeypatch, caplog):
    """One run finds too few of the links; rounds with other vectors are added until the sampled links are found."""
    import logging
    import random as r

    rng = r.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(40):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(2):
            text = list(base)
            text[rng.randrange(120)] = "new"
            rows.append((n, " ".join(text)))
            n += 1
    monkeypatch.setattr(J, "LIMIT", 4)
    seen = []
    inner = J.chosen_paths
    monkeypatch.setattr(J, "chosen_paths", lambda *a: seen.append(a[1]) or inner(*a))
    with caplog.at_level(logging.INFO, logger=J.__name__):
        got = J.classes(make(rows, "doc_id long, text string"), runs=1).collect()
    links = sum(x["n_links"] for x in got)
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    exact = sum(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)
    assert len(seen) > 1 and links >= J.TARGET * exact and exact >= 60
    assert f"{exact} links of 80 probed sets found" in caplog.text.replace(f"of {exact} links", f"{exact} links")


def test_probed_links_are_exact(make):
    docs = make([(i, " ".join(f"w{j}" for j in range(60)) + f" x{i % 4}" * (i % 3)) for i in range(20)] + [(30, None), (31, "a b"), (32, "a b")],
                "doc_id long, text string")
    own = docs.select("doc_id", "text", J.F.xxhash64("text").alias("_h"))
    entries = J.sketches(own).where("rid is not null").groupBy("rid").agg(J.F.min(J.F.struct("doc_id", "_h")).alias("row"))
    probes = J.probe_sets(own, entries)
    got = {r["rid"]: sorted(r["probes"]) for r in J.probed_links(own, probes, 0.8).collect()}
    sets = list(probes.values())
    want = {rid: sorted(i for i, b in enumerate(sets) if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))) for rid, a in probes.items()}
    assert got == want and len(probes) == entries.count()
