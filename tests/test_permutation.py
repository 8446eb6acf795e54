"""Orders in closed form: bijections, inverses, spread, and plans without a shuffle."""

import numpy as np
import pytest

from shardwright.operators import packing
from shardwright.operators import permutation as P


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 255, 256, 257, 1000, 65_537])
def test_every_index_stands_once(n):
    at = np.arange(n)
    for epoch in (0, 1):
        order = P.index_at(at, n, 1337, epoch)
        assert np.array_equal(np.sort(order), at)
        assert np.array_equal(P.position_of(order, n, 1337, epoch), at)
    if n > 20:
        assert not np.array_equal(order, P.index_at(at, n, 1337, 0)) and not np.array_equal(order, P.index_at(at, n, 7, 1))
        assert np.array_equal(order, P.index_at(at, n, 1338, 0))       # seed and epoch add up


def test_a_large_range_is_reached_without_the_rest_of_it():
    n = 10 ** 12 + 39
    at = np.array([0, 1, n - 1, n // 2])
    order = P.index_at(at, n, 5, 2)
    assert len(set(order.tolist())) == 4 and order.min() >= 0 and order.max() < n
    assert np.array_equal(P.position_of(order, n, 5, 2), at)


def test_places_are_uniform():
    n, seeds = 12, 6000
    got = np.stack([P.index_at(np.arange(n), n, s, 0) for s in range(seeds)])
    for column in range(n):                                           # chi-square of 11 degrees: 31.3 is one in a thousand
        counts = np.bincount(got[:, column], minlength=n)
        assert ((counts - seeds / n) ** 2 / (seeds / n)).sum() < 40
    pairs = np.bincount((got[:, 0] * n + got[:, 1]).astype(int), minlength=n * n)
    expected = seeds / (n * (n - 1))
    off = ~np.eye(n, dtype=bool).ravel()
    assert ((pairs[off] - expected) ** 2 / expected).sum() < 131 + 4 * np.sqrt(2 * 131) and pairs[~off].sum() == 0
    big = P.index_at(np.arange(50_000), 50_000, 3, 0)
    assert abs(np.corrcoef(np.arange(50_000), big)[0, 1]) < 0.02 and abs(np.corrcoef(big[1:], big[:-1])[0, 1]) < 0.02


def test_a_resume_is_the_rest_of_the_whole_plan_and_shuffles_nothing(spark):
    whole = packing.remaining_plan(spark, 11, 4, 5, 103, 0, 40)
    rest = packing.remaining_plan(spark, 11, 4, 5, 103, 17, 40)
    assert "Exchange" not in rest._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (r["epoch"], r["batch"], r["step"], r["position"], r["local_index"])
    a, b = sorted(map(key, whole.collect())), sorted(map(key, rest.collect()))
    assert b == [r for r in a if r[2] >= 17] and len(a) == 40 * 5 * 4
    assert packing.remaining_plan(spark, 11, 4, 5, 103, 40, 40).count() == 0
    for bad in (dict(batch_size=0), dict(step=-1), dict(n_train=3)):
        args = dict(seed=1, batch_size=4, accum=1, n_train=103, step=0, max_steps=4) | bad
        with pytest.raises(ValueError):
            packing.remaining_plan(spark, **args)
