"""Embedding whitening from the exact characteristic polynomial of the scatter matrix.

An entry c becomes the integer ``floor(1024 c) + 100000``; so the scatter matrix
``n * sum(x x') - S S'`` is one of integers and is computed without rounding. Plan:

1. Moments: one pass; every task sums ``y y'`` and ``y`` (y = x - 100000: scatter does not see
   the shift) as whole numbers, by exact float64 products of 20-bit limbs, and emits one row.
   The rows are merged in a tree, one task's at the top.
2. Characteristic polynomial: primes below 2^31 are rows; each task brings the matrix modulo its
   primes to Hessenberg form and reads the polynomial off. Chinese remaindering joins them; how many
   are needed follows from the trace (the matrix is positive semidefinite), one more prime checks it.
3. Eigenvalues: all roots are real, so the sign changes of the shifted polynomial p(x + a) count the
   roots above a exactly. Bisection isolates the largest ones and goes on to 200 bits.
4. Components: rows again; each is the null space of (matrix - eigenvalue), found by inverse iteration
   in 120 decimal digits. Equal eigenvalues (not told apart by 200 bits) get an orthonormal basis of their space.
5. Rows are projected in one pass that also sums the covariance of the result (Chan's merge), and
   in a second one that writes them with its largest distance from the identity.

What travels through the driver has the size of the matrix, never that of the table.

Defined cases. Rows whose vector is null, holds a null or non-finite entry, or has not the length that
most vectors have (ties: the longer) are dropped. Null and repeated ids and repeated rows are
rows like others. An empty table, or one without a vector, gives an empty result. A component without
variance (fewer vectors than dimensions, equal vectors) has ``whitened`` null and takes no part in
``identity_error`` (null if none is left); ``explained`` is null if there is no variance at all. Other
columns of the input never clash: only those asked for are read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = 1024
ROWS = 4096                       # rows of an exact product: 2^12 rows of 2^40 stay below 2^53
LIMB = 20
DIGITS = 120
BITS = 200                        # to which an eigenvalue is found, relative to itself
Matrix = list[list[int]]


# --- vectors ---

def dimension(df: DataFrame, vector: str) -> int | None:
    """The length that most vectors have."""
    n = df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).count()
    got = n.where("d > 0").orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return got[0]["d"] if got else None


def vectors(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold ``d`` finite entries, and these as float64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), -1))
    good = size == d
    flat = pa.compute.cast(column.filter(pa.array(good)).flatten(), pa.float64())
    v = np.asarray(pa.compute.fill_null(flat, math.nan)).reshape(-1, d)
    finite = np.isfinite(v).all(1)
    good[np.flatnonzero(good)[~finite]] = False
    return good, v[finite]


def whole(v: np.ndarray) -> np.ndarray:
    """The entries as integers without the shift, in float64 (exact)."""
    return np.floor(v * SCALE)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """``y`` as sum of ``limb[j] * 2^(20 j)``, each limb below 2^20 in size."""
    out = []
    while len(y) and np.abs(y).max() >= 1 << LIMB:
        high = np.floor(y / (1 << LIMB))
        out.append(y - high * (1 << LIMB))
        y = high
    return [*out, y]


def moments_of(y: np.ndarray) -> tuple[list[int], Matrix]:
    """Exact sums and products of some rows."""
    d = y.shape[1]
    total, product = np.zeros(d, object), np.zeros((d, d), object)
    for at in range(0, len(y), ROWS):
        parts = limbs(y[at:at + ROWS])
        for j, a in enumerate(parts):
            total += a.sum(0).astype(np.int64).astype(object) << (LIMB * j)
            for k, b in enumerate(parts):
                product += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (j + k))
    return total.tolist(), product.tolist()


# --- merging of what tasks emit ---

def merged(parts: DataFrame, add) -> str | None:
    """The rows ``(part, stats)`` that tasks emitted, added up: the tasks of a shuffle add theirs,
    one task adds these."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for s in batch.column("stats").to_pylist():
                total = s if total is None else add(total, s)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"stats": pa.array([total], pa.string())})

    once = parts.repartition("part").mapInArrow(run, "stats string")
    got = once.repartition(1).mapInArrow(run, "stats string").collect()
    return got[0]["stats"] if got else None


def add_moments(a: str, b: str) -> str:
    x, y = json.loads(a), json.loads(b)
    return json.dumps({"n": x["n"] + y["n"], "sum": [p + q for p, q in zip(x["sum"], y["sum"])],
                       "product": [[p + q for p, q in zip(r, s)] for r, s in zip(x["product"], y["product"])]})


def moments(df: DataFrame, vector: str, d: int) -> tuple[int, list[int], Matrix] | None:
    """Number of vectors, sums and products of their whole entries (without the shift)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, product, part = 0, np.zeros(d, object), np.zeros((d, d), object), None
        for batch in batches:
            part = batch.column("part")[0].as_py()
            _, v = vectors(batch.column("v"), d)
            s, p = moments_of(whole(v))
            n, total, product = n + len(v), total + np.array(s, object), product + np.array(p, object)
        if n:
            stats = json.dumps({"n": n, "sum": total.tolist(), "product": product.tolist()})
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "stats": pa.array([stats])})

    rows = df.select(F.col(vector).alias("v"), F.spark_partition_id().alias("part"))
    got = merged(rows.mapInArrow(run, "part int, stats string"), add_moments)
    if got is None:
        return None
    m = json.loads(got)
    return m["n"], m["sum"], m["product"]


# --- characteristic polynomial ---

def is_prime(n: int) -> bool:
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7) if n != p):
        return False
    r = ((n - 1) & (1 - n)).bit_length() - 1
    for a in (2, 3, 5, 7):                                         # decides all n below 3,215,031,751
        x = pow(a, (n - 1) >> r, n)
        if a % n and x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(r - 1)):
            return False
    return True


def primes(bits: int) -> list[int]:
    """The largest primes below 2^31 whose product has more than ``bits`` bits, and one more."""
    out, product, n = [], 1, (1 << 31) - 1
    while product.bit_length() <= bits or len(out) < 2:
        if is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    while not is_prime(n):
        n -= 2
    return [*out, n]


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``a`` modulo ``p`` without entries below the first subdiagonal."""
    d = len(a)
    for m in range(1, d - 1):
        nonzero = np.flatnonzero(a[m:, m - 1])
        if not len(nonzero):
            continue
        i = m + int(nonzero[0])
        a[[m, i]] = a[[i, m]]
        a[:, [m, i]] = a[:, [i, m]]
        u = a[m + 1:, m - 1] * pow(int(a[m, m - 1]), -1, p) % p
        a[m + 1:] = (a[m + 1:] - u[:, None] * a[m] % p) % p
        a[:, m] = (a[:, m] + (a[:, m + 1:] * u % p).sum(1)) % p
    return a


def characteristic_mod(matrix: Matrix, p: int) -> list[int]:
    """Coefficients (constant first) of det(x I - matrix) modulo ``p``."""
    d = len(matrix)
    h = hessenberg(np.array([[v % p for v in row] for row in matrix], np.int64).reshape(d, d), p)
    polys = [np.zeros(d + 1, np.int64)]
    polys[0][0] = 1
    for m in range(d):
        new = np.roll(polys[m], 1)
        new = (new - int(h[m, m]) * polys[m] % p) % p
        below = 1
        for i in range(m - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            if not below:
                break
            new = (new - int(h[i, m]) * below % p * polys[i] % p) % p
        polys.append(new)
    return polys[d].tolist()


def coefficient_bits(matrix: Matrix) -> int:
    """Bits of twice the largest coefficient: the k-th is at most C(d, k) (trace / d)^k."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    return max((math.comb(d, k) * trace ** k // d ** k + 1).bit_length() for k in range(d + 1)) + 2


def remaindered(residues: dict[int, list[int]]) -> list[int]:
    """The integers of least size that have these residues."""
    modulus = math.prod(residues)
    total = [0] * len(next(iter(residues.values())))
    for p, r in residues.items():
        rest = modulus // p
        unit = rest * pow(rest, -1, p)
        total = [t + x * unit for t, x in zip(total, r)]
    return [t - modulus if (t := x % modulus) > modulus // 2 else t for x in total]


def characteristic(spark: SparkSession, matrix: Matrix) -> list[int]:
    """The characteristic polynomial of a positive semidefinite integer matrix, constant first."""
    ps = primes(coefficient_bits(matrix))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"p": [ps[i] for i in f["id"]], "c": [characteristic_mod(matrix, ps[i]) for i in f["id"]]})

    parts = max(1, min(len(ps) // 8, spark.sparkContext.defaultParallelism))
    got = spark.range(0, len(ps), 1, parts).mapInPandas(run, "p long, c array<long>").collect()
    residues = {r["p"]: list(r["c"]) for r in got}
    check = residues.pop(ps[-1])
    poly = remaindered(residues)
    if [c % ps[-1] for c in poly] != check:
        raise ArithmeticError("the characteristic polynomial does not fit the checking prime")
    return poly


# --- roots ---

def shifted(poly: list[int], a: int) -> list[int]:
    """p(x + a)."""
    c = list(poly)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    return c


def roots_above(poly: list[int], a: int) -> int:
    """Roots greater than ``a`` of a polynomial with real roots only, each as often as it occurs:
    the sign changes of p(x + a) (Descartes' rule is exact for them)."""
    signs = [c > 0 for c in shifted(poly, a) if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def value_sign(poly: list[int], x: int) -> int:
    v = 0
    for c in reversed(poly):
        v = v * x + c
    return (v > 0) - (v < 0)


def scaled(poly: list[int], s: int) -> list[int]:
    """Coefficients of the polynomial whose roots are 2^s times those of ``poly``."""
    d = len(poly) - 1
    return [c << (s * (d - k)) for k, c in enumerate(poly)]


def largest_roots(poly: list[int], k: int) -> list[tuple[int, int, int]]:
    """The ``k`` largest positive roots (all real) as ``(low, exponent, cluster)``: the root lies in
    (low, low + 1] * 2^-exponent, to 200 bits; roots that these do not tell apart share a cluster."""
    zeros = next(i for i, c in enumerate(poly) if c)
    poly = poly[zeros:]
    positive, top = roots_above(poly, 0), 1
    while roots_above(poly, top):
        top <<= 4
    out: list[tuple[int, int, int]] = []
    cluster = 0
    while len(out) < min(k, positive):
        j, s, p, lo, hi, over, under, side = len(out), 0, poly, 0, top, positive, 0, 0
        # roots above lo: over > j; above hi: under <= j; side: the sign at hi, once the root is alone
        while lo.bit_length() <= BITS or hi - lo > 1:
            if hi - lo == 1:
                s, lo, hi = s + 64, lo << 64, hi << 64
                p = scaled(poly, s)
            if not side and over - under == 1:
                side = value_sign(p, hi)                           # 0: hi is the root above it
            mid = (lo + hi) // 2
            n = under + (value_sign(p, mid) == -side) if side else roots_above(p, mid)
            if n > j:
                lo, over = mid, n
            else:
                hi, under, side = mid, n, value_sign(p, mid) if side else 0
        out += [(lo, s, cluster)] * (over - j)
        cluster += 1
        top = (hi >> s) + 1
    return out[:k]


# --- components ---

def null_vector(matrix: Matrix, value: Decimal, against: list[np.ndarray]) -> np.ndarray:
    """A unit vector of the null space of (matrix - value), orthogonal to those of ``against``, in
    decimals: inverse iteration on one elimination with row exchanges."""
    d = len(matrix)
    a = np.array([[Decimal(v) for v in row] for row in matrix], object).reshape(d, d)
    norm = max((abs(x) for x in a.flat), default=Decimal(1)) or Decimal(1)
    for i in range(d):
        a[i, i] -= value
    tiny = norm * Decimal(10) ** (20 - DIGITS)
    order = list(range(d))
    for m in range(d):
        i = m + max(range(d - m), key=lambda r: abs(a[m + r, m]))
        if i != m:
            a[[m, i]] = a[[i, m]]
            order[m], order[i] = order[i], order[m]
        if abs(a[m, m]) < tiny:
            a[m, m] = tiny
        for r in range(m + 1, d):
            if a[r, m]:
                a[r, m] /= a[m, m]
                a[r, m + 1:] -= a[r, m] * a[m, m + 1:]

    def unit(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for w in against:
                v = v - w * sum(v * w)
        size = sum(v * v).sqrt()
        return v / size if size else v

    best: tuple[Decimal, np.ndarray] | None = None
    for start in range(d + 1):
        v = unit(np.array([Decimal(1 + (i * 37 + 11) % 29) if not start else Decimal(int(i == start - 1)) for i in range(d)], object))
        if not any(v):
            continue
        for _ in range(3):
            v = v[order]
            for m in range(1, d):
                v[m] -= sum(a[m, :m] * v[:m])
            for m in range(d - 1, -1, -1):
                v[m] = (v[m] - sum(a[m, m + 1:] * v[m + 1:])) / a[m, m]
            v = unit(v)
        rest = max(abs(sum(Decimal(x) * y for x, y in zip(row, v)) - value * v[i]) for i, row in enumerate(matrix))
        if best is None or rest < best[0]:
            best = rest, v
        if rest <= norm * Decimal(10) ** -40:
            break
    return best[1]


@dataclass(frozen=True)
class Fit:
    """``n`` vectors of ``d`` entries; ``sums`` of the whole entries (without the shift) and exact
    ``scatter``; its eigenvalues (of the scatter: n^2 times those of the covariance) and components."""
    d: int
    n: int
    sums: list[int]
    scatter: Matrix
    values: list[Decimal]
    components: np.ndarray

    @property
    def trace(self) -> int:
        return sum(self.scatter[i][i] for i in range(self.d))


def components(spark: SparkSession, matrix: Matrix, k: int) -> tuple[list[Decimal], np.ndarray]:
    """The ``k`` largest eigenvalues and their unit vectors; those without variance have zero vectors."""
    d = len(matrix)
    roots = largest_roots(characteristic(spark, matrix), k)
    if not roots:
        return [Decimal(0)] * k, np.zeros((k, d))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with localcontext(Context(prec=DIGITS, Emax=10 ** 9, Emin=-10 ** 9)):
            for f in frames:
                for cluster in f["id"]:
                    found: list[np.ndarray] = []
                    for j, (low, s, c) in enumerate(roots):
                        if c != cluster:
                            continue
                        value = Decimal(2 * low + 1) / Decimal(1 << (s + 1))
                        found.append(null_vector(matrix, value, found))
                        yield pd.DataFrame({"j": [j], "value": [str(value)], "v": [[float(x) for x in found[-1]]]})

    n = roots[-1][2] + 1
    got = spark.range(0, n, 1, n).mapInPandas(run, "j int, value string, v array<double>").collect()
    values, out = [Decimal(0)] * k, np.zeros((k, d))
    for r in got:
        values[r["j"]], out[r["j"]] = Decimal(r["value"]), r["v"]
    return values, out


def fit(df: DataFrame, vector: str = "embedding", k: int = 8) -> Fit | None:
    """The whitening of all valid vectors of ``df``; none if there is no valid vector."""
    d = dimension(df, vector)
    got = moments(df, vector, d) if d else None
    if got is None:
        return None
    n, sums, product = got
    scatter = [[n * product[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    values, vecs = components(df.sparkSession, scatter, min(k, d))
    return Fit(d, n, sums, scatter, values, vecs)


# --- rows ---

class Projection:
    def __init__(self, fit: Fit) -> None:
        self.n, self.d, self.sums = fit.n, fit.d, fit.sums
        with localcontext(Context(prec=DIGITS)):
            self.mean = np.array([float(Decimal(s) / fit.n) for s in fit.sums])
            self.scale = np.array([float(fit.n / v.sqrt()) if v else math.nan for v in fit.values])
            self.explained = [float(v / fit.trace) if fit.trace else None for v in fit.values]
        self.axes = fit.components.T * np.nan_to_num(self.scale)
        self.defined = ~np.isnan(self.scale)

    def __call__(self, v: np.ndarray) -> np.ndarray:
        return (whole(v) - self.mean) @ self.axes

    def deviation(self, v: np.ndarray) -> list[int]:
        """Exact sums of (n x - S)^2 for each row."""
        y = whole(v)
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most * most * self.d < 1 << 63 else object
        whole_y = y.astype(np.int64).astype(kind) if kind is np.int64 else np.array([[int(x) for x in r] for r in y], object).reshape(y.shape)
        off = whole_y * self.n - np.array(self.sums, kind)
        return (off * off).sum(1).tolist()


def add_spread(a: str, b: str) -> str:
    """Chan's merge of two (n, mean, scatter)."""
    x, y = json.loads(a), json.loads(b)
    n, gap = x["n"] + y["n"], np.array(y["mean"]) - np.array(x["mean"])
    return json.dumps({"n": n, "mean": (np.array(x["mean"]) + gap * (y["n"] / n)).tolist(),
                       "spread": (np.array(x["spread"]) + np.array(y["spread"]) + np.outer(gap, gap) * (x["n"] * y["n"] / n)).tolist()})


def identity_error(df: DataFrame, fit: Fit, vector: str = "embedding") -> float | None:
    """Largest entry of (covariance of the whitened rows - identity)."""
    d = fit.d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, total, part = Projection(fit), None, None
        for batch in batches:
            part = batch.column("part")[0].as_py()
            _, v = vectors(batch.column("v"), d)
            if len(v):
                z = project(v)[:, project.defined]
                off = z - z.mean(0)
                s = json.dumps({"n": len(z), "mean": z.mean(0).tolist(), "spread": (off.T @ off).tolist()})
                total = s if total is None else add_spread(total, s)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "stats": pa.array([total])})

    rows = df.select(F.col(vector).alias("v"), F.spark_partition_id().alias("part"))
    got = merged(rows.mapInArrow(run, "part int, stats string"), add_spread)
    if got is None:
        return None
    s = json.loads(got)
    cov = np.array(s["spread"]) / s["n"]
    return float(np.abs(cov - np.eye(len(cov))).max()) if len(cov) else None


OUT = "component int, n long, deviation string, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, fit: Fit | None, vector: str = "embedding", columns: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """``columns`` of each valid row once for each component (from 1, by falling eigenvalue), with the
    whitened value, the exact ``deviation`` (a decimal text: it may outgrow a long), the component's share of
    the variance and the identity error of the whole."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)
    if fit is None:
        return df.sparkSession.createDataFrame([], f"{fields}, {OUT}")
    error = identity_error(df, fit, vector)
    k = len(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = Projection(fit)
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(at, ROWS)
                good, v = vectors(batch.column("_vector"), fit.d)
                rows = len(v)
                again = pa.array(np.repeat(np.flatnonzero(good), k))
                z = project(v).ravel()
                off = np.tile(~project.defined, rows)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(again) for c in columns), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                     pa.array(np.full(rows * k, fit.n)),
                     pa.array([str(x) for x in project.deviation(v)], pa.string()).take(pa.array(np.repeat(np.arange(rows), k))),
                     pa.array(z, mask=off), pa.array(project.explained * rows, pa.float64()), pa.array([error] * (rows * k), pa.float64())],
                    [*columns, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return df.select(*columns, F.col(vector).alias("_vector")).mapInArrow(run, f"{fields}, {OUT}")
