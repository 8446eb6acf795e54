"""Hard negatives against a brute-force search; the query's twin is in test_llm_oracle."""

import math
import random

import pytest

from shardwright.llm import hard_negatives as H
from shardwright.llm.queries import QUERIES

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, is_anchor):
    lengths = [len(v) for i, _, v in rows if v]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 0
    one = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or len(v) != d or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = (label, [math.floor(256 * c) for c in v])
        one[i] = min(one.get(i, x), x)
    out = []
    for a, (label, x) in one.items():
        if not is_anchor(a):
            continue
        s = sorted((-sum(p * q for p, q in zip(x, y)), i, lb) for i, (lb, y) in one.items() if i != a)
        for ps, p, lb in [t for t in s if t[2] == label][:5]:
            fit = [t for t in s if t[2] != label and 30 * -ps <= 100 * -t[0] <= 90 * -ps][:10]
            out += [(a, p, r, n, -ps, -ns) for r, (ns, n, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(df):
    return sorted(map(tuple, H.mine(df, H.F.col("id") % 10 == 0).collect()))


def random_rows(seed, n, d=4, step=0.25):
    rng = random.Random(seed)
    return [(i, rng.randrange(3), [rng.randrange(-8, 9) * step for _ in range(d)]) for i in range(n)]


@pytest.mark.parametrize("step", [0.25, 1 / 256])                   # the second has many ties and scores of 0
def test_against_brute_force(make, monkeypatch, step):
    monkeypatch.setattr(H, "LEAST_ROWS", 40)
    monkeypatch.setattr(H, "ANCHOR_ROWS", 7)
    monkeypatch.setattr(H, "CELLS", 100)
    rows = random_rows(1, 260, step=step)
    assert mined(make(rows, SCHEMA)) == brute(rows, lambda i: i % 10 == 0)


def test_rows_that_take_no_part(make):
    rows = random_rows(2, 60) + [(None, 1, [1.0] * 4), (100, None, [1.0] * 4), (110, 1, None), (120, 1, [1.0, None, 1.0, 1.0]),
                                 (130, 1, [math.nan] * 4), (140, 1, [math.inf] * 4), (150, 1, [1.0]), (160, 1, [3e38] * 4)]
    rows += rows[:20] * 3 + [(10, 2, [0.5] * 4), (-20, 1, [1.0] * 4)]
    got = mined(make(rows, SCHEMA).withColumn("id", H.F.lit("x")).withColumn("score", H.F.lit("y")))
    assert got == brute([r for r in rows if r[0] != 160], lambda i: i % 10 == 0)


def test_few_or_no_rows(make):
    assert mined(make([], SCHEMA)) == [] and mined(make([(10, 1, None)], SCHEMA)) == []
    assert mined(make([(10, 1, [1.0]), (11, 1, [1.0])], SCHEMA)) == []                     # no negative
    assert mined(make([(10, 1, [1.0]), (11, 2, [1.0])], SCHEMA)) == []                     # no positive
    assert mined(make([(10, 1, [1.0]), (11, 1, [1.0]), (12, 2, [0.5])], SCHEMA)) == [(10, 11, 1, 12, 65536, 32768)]


def test_a_hot_vector_and_large_components(make):
    rows = [(i, i % 3, [0.5, 0.25]) for i in range(400)] + [(400 + i, i % 3, [0.25, 0.25]) for i in range(100)]
    assert mined(make(rows, SCHEMA)) == brute(rows, lambda i: i % 10 == 0)
    big = [(i, i % 2, [float(i + 1) * 2 ** 15, 1.0]) for i in range(30)]                    # sums beyond 2^53
    assert mined(make(big, SCHEMA)) == brute(big, lambda i: i % 10 == 0)


def test_keys_sort_as_pairs_do():
    import numpy as np

    rng = np.random.default_rng(4)
    a, s, i = rng.integers(-3, 3, 500), rng.integers(-4, 4, 500) * (1 << 40), rng.integers(-5, 5, 500)
    same = rng.integers(0, 2, 500).astype(bool)
    keys = H.packed(a, s, i, same).column("key").to_pylist()
    order = sorted(range(500), key=lambda k: (a[k], -s[k], not same[k], i[k]))
    assert sorted(keys) == [keys[k] for k in order]


def test_query(spark, small):
    assert QUERIES["op13_hard_negatives"](spark, small).columns == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
