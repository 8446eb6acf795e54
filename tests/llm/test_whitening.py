"""Whitening against numpy, and its exact parts against plain integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from shardwright.llm import whitening as W
from shardwright.llm.queries import QUERIES, table


def faddeev(m):
    """Characteristic polynomial by the recurrence of Faddeev and LeVerrier."""
    d = len(m)
    a, eye, c = np.array(m, object).reshape(d, d), np.eye(d, dtype=int).astype(object), [0] * d + [1]
    mk = np.zeros((d, d), object)
    for k in range(1, d + 1):
        mk = a.dot(mk) + c[d - k + 1] * eye
        c[d - k] = -sum(a.dot(mk)[i][i] for i in range(d)) // k
    return c


def gram(rng, d, rows):
    x = rng.integers(-60, 60, (rows, d)).astype(object)
    return (x.T.dot(x)).tolist()


@pytest.mark.parametrize("d", [1, 2, 3, 6, 9])
def test_polynomial_and_roots(spark, d):
    rng = np.random.default_rng(d)
    for rows in (d + 3, max(1, d - 2)):                             # the second has no full rank
        m = gram(rng, d, rows)
        poly = W.characteristic(spark, m) if rows > d else W.remaindered({p: W.characteristic_mod(m, p) for p in W.primes(W.coefficient_bits(m))})
        assert poly == faddeev(m)
        want = sorted((e for e in np.linalg.eigvalsh(np.array(m, float)) if e > 1e-6), reverse=True)[:8]
        got = [float(Fraction(2 * low + 1, 2 << s)) for low, s, _ in W.largest_roots(poly, 8)]
        assert np.allclose(got, want, rtol=1e-9) and len(got) == len(want)


def test_hessenberg_needs_a_row_exchange():
    m = [[2, 0, 1], [0, 3, 0], [1, 0, 2]]
    ps = W.primes(W.coefficient_bits(m))
    assert W.remaindered({p: W.characteristic_mod(m, p) for p in ps}) == faddeev(m) == [-9, 15, -7, 1]


def test_equal_and_close_roots():
    poly = [1]
    for r in (7, 7, 3, 3 * 10 ** 6, 3 * 10 ** 6 + 1):               # (x - r) each
        poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0])]
    got = W.largest_roots(poly, 8)
    assert [c for *_, c in got] == [0, 1, 2, 2, 3]
    assert np.allclose([float(Fraction(2 * low + 1, 2 << s)) for low, s, _ in got], [3000001, 3000000, 7, 7, 3], rtol=1e-15)


def test_moments_are_exact_for_any_size_of_entry():
    rng = np.random.default_rng(3)
    for size in (1.0, 1e6, 1e20):
        v = rng.normal(0, size, (50, 4))
        y = [[math.floor(Fraction(x) * 1024) for x in row] for row in v]
        s, p = W.moments_of(W.whole(v))
        assert s == [sum(r[i] for r in y) for i in range(4)]
        assert p == [[sum(r[i] * r[j] for r in y) for j in range(4)] for i in range(4)]


def by_numpy(v, k):
    x = np.floor(np.array(v, float) * 1024)
    off = x - x.mean(0)
    e, u = np.linalg.eigh(off.T @ off / len(x))
    return off, e[::-1][:k], u[:, ::-1][:, :k]


def whitened(df, k=8):
    return W.whiten(df, W.fit(df, k=k)).collect()


def test_rows(spark, make):
    rng = np.random.default_rng(11)
    v = (rng.normal(0, 1, (300, 5)) * [3, 2, 1, 0.5, 0.2]).astype(np.float32).astype(float).tolist()
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [math.nan] + [0.0] * 4), (903, [math.inf] + [0.0] * 4), (904, [1.0, 2.0]), (905, [])]
    rows = [(i, x) for i, x in enumerate(v)] + [(7, v[7]), (None, v[8])] + bad
    df = make(rows, "vec_id long, embedding array<float>").withColumn("n", W.F.lit("x")).withColumn("part", W.F.lit("y"))
    got = whitened(df, 3)
    kept = v + [v[7], v[8]]
    off, e, u = by_numpy(kept, 3)
    assert len(got) == 3 * len(kept) and {r["n"] for r in got} == {len(kept)}
    assert sum(r["vec_id"] is None for r in got) == 3 and sum(r["vec_id"] == 7 for r in got) == 6
    dev = {}
    for i, x in enumerate(kept):
        y = [math.floor(Fraction(c) * 1024) + 100000 for c in x]
        dev[i] = y
    total = [sum(y[j] for y in dev.values()) for j in range(5)]
    for j in range(3):
        z = {r["vec_id"]: r for r in got if r["component"] == j + 1}
        want = off @ u[:, j] / math.sqrt(e[j])
        mine = np.array([z[i]["whitened"] for i in range(300)])
        sign = np.sign(mine @ want[:300])
        assert np.allclose(mine, sign * want[:300], atol=1e-9)
        assert abs(z[0]["explained"] - e[j] / np.trace(off.T @ off / len(off))) < 1e-10
        assert all(int(z[i]["deviation"]) == sum((len(kept) * a - s) ** 2 for a, s in zip(dev[i], total)) for i in range(300))
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_without_variance(make):
    schema = "vec_id long, embedding array<double>"
    assert whitened(make([], schema)) == [] and whitened(make([(1, None), (2, [])], schema)) == []
    one = whitened(make([(1, [0.5, 0.25])] * 4, schema))
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(c, "0", None, None, None) for c in (1, 2)] * 4
    flat = whitened(make([(1, [0.0, 0.0, 0.0]), (2, [1.0, 1.0, 1.0])], schema))
    assert sorted((r["vec_id"], r["component"], r["whitened"] and abs(round(r["whitened"], 9))) for r in flat) == [
        (i, c, 1.0 if c == 1 else None) for i in (1, 2) for c in (1, 2, 3)]
    assert max(r["identity_error"] for r in flat) < 1e-9


def test_equal_eigenvalues_get_orthonormal_components(make):
    rows = [(i * 2 + (s > 0), [float(s) * (j == i) for j in range(4)]) for i in range(4) for s in (1, -1)]
    df = make(rows, "vec_id long, embedding array<double>")
    fit = W.fit(df)
    assert np.allclose(fit.components @ fit.components.T, np.eye(4), atol=1e-14) and len(set(fit.values)) == 1
    assert max(r["identity_error"] for r in W.whiten(df, fit).collect()) < 1e-12


def test_query(spark, small):
    rows = table(spark, small, "embeddings").collect()
    off, e, u = by_numpy([r["embedding"] for r in rows], 8)
    place = {r["vec_id"]: i for i, r in enumerate(rows)}
    got = QUERIES["op12_whitening"](spark, small).collect()
    assert len(got) == 8 * len(rows)
    for c in range(8):
        mine = np.zeros(len(rows))
        for r in got:
            if r["component"] == c + 1:
                mine[place[r["vec_id"]]] = r["whitened"]
        want = off @ u[:, c] / math.sqrt(e[c])
        assert np.allclose(mine, np.sign(mine @ want) * want, atol=1e-6)
    assert max(r["identity_error"] for r in got) < 1e-9
