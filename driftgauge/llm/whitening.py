"""Embedding whitening by the exact characteristic polynomial of the integer scatter.

1. Entries become integers. Each task adds up its rows' products exactly; Spark adds the tasks'.
   With n rows and sums S the scatter n * sum(x x') - S S' is n^2 times the covariance, an
   integer matrix that doesn't depend on the order of rows.
2. Its characteristic polynomial: modulo each of as many 31-bit primes as a bound of the coefficients
   asks for, tasks reduce the matrix to Hessenberg form and read the polynomial off it; then Chinese
   remaindering gives each coefficient, one group each.
3. Its roots are real and not negative, so the sign variations of the polynomial shifted to a
   (Descartes) are exactly the number of roots above a. Bisection isolates the largest roots, then signs alone
   narrow each to ``BITS`` bits. Roots equal to that precision are one of that multiplicity.
4. Each component spans the null space of scatter - root: inverse iteration, then Newton steps whose
   residuals are exact integers. The component's largest entry is positive.

What reaches the driver has the size of the matrix, whatever the number of rows.

Vectors that are null, or hold null or non-finite entries, take no part and give no row, nor do vectors
of another length than most have (the longer, if tied). Null and repeated ids stay, a row each. Roots of 0 have no
component: constant vectors, and an empty table, give no rows. Entries of 2^42 or more are refused, as their
integers aren't exact doubles. Only the id and the vector are read, so other columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from math import comb, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, table

SCALE, SHIFT, BITS, HALF = 1024, 100_000, 100, 40
LARGEST = float(1 << 42)


def usable(vec: str) -> Column:
    v = F.col(vec).cast("array<double>")
    inf = float("inf")
    return F.col(vec).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (c < inf) & (c > -inf))


def whole_vectors(df: DataFrame, id_col: str, vec: str) -> tuple[DataFrame, int]:
    """(_id, _v) of the rows that take part, and the common length."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(vec).cast("array<double>").alias("_v")).where(usable("_v"))
    sizes = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = sizes[0].d if sizes else 0
    return rows.where(F.size("_v") == dim), dim


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    """floor(1024 c) of each entry."""
    x = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
    if len(x) and np.abs(x).max() >= LARGEST * SCALE:
        raise ValueError("entries of 2^42 or more can't be made exact integers")
    return x.astype(np.int64)


def exact_products(y: np.ndarray) -> np.ndarray:
    """y' y, exactly: in doubles or 64-bit integers where these can't overflow."""
    top = int(np.abs(y).max(initial=0)) ** 2 * max(len(y), 1)
    if top < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if top < 1 << 63:
        return (y.T @ y).astype(object)
    big = y.astype(object)
    return big.T @ big


def _partial(dim: int):
    def run(batches):
        n, sums, products = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                y = _integers(batch.column(0).slice(k, 4096), dim)
                n += len(y)
                sums += y.sum(0).astype(object)
                products += exact_products(y)
        if n:
            i, j = np.triu_indices(dim)
            values = [n, *sums, *products[i, j]]
            rows = {"i": np.r_[-2, np.full(dim, -1), i], "j": np.r_[0, np.arange(dim), j], "high": [int(v) >> HALF for v in values], "low": [int(v) & ((1 << HALF) - 1) for v in values]}
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("i", pa.int32()), ("j", pa.int32()), ("high", pa.int64()), ("low", pa.int64())]))

    return run


@dataclass
class Scatter:
    """n rows' sums of floor(1024 c), and n^2 times their covariance, as Python integers."""

    n: int
    sums: np.ndarray
    matrix: np.ndarray


def scatter(rows: DataFrame, dim: int) -> Scatter:
    parts = rows.select("_v").mapInArrow(_partial(dim), "i int, j int, high long, low long").groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    n, sums, products = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
    for r in parts.collect():  # dim * (dim + 3) / 2 + 1 numbers
        value = (r.high << HALF) + r.low
        if r.i == -2:
            n = value
        elif r.i == -1:
            sums[r.j] = value
        else:
            products[r.i, r.j] = products[r.j, r.i] = value
    return Scatter(n, sums, n * products - np.outer(sums, sums))


def primes(bits: int) -> list[int]:
    """Primes below 2^31, largest first, whose product has more than ``bits`` bits."""
    small = np.arange(3, isqrt(1 << 31) + 1, 2)
    out, left, p = [], float(bits + 1), (1 << 31) - 1
    while left > 0:
        if (p % small != 0).all():
            out.append(p)
            left -= 30.99
        p -= 2
    return out


def hessenberg_polynomials(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Characteristic polynomials, constant term first, of the matrices a[k] modulo the primes p[k]; all primes at once."""
    a, count, d = a.copy(), len(p), a.shape[1]
    q, at = p[:, None, None], np.arange(len(p))

    def inverse(x: np.ndarray) -> np.ndarray:
        out, base, power = np.ones_like(x), x % p, p - 2
        while power.any():
            out = np.where(power & 1, out * base % p, out)
            base, power = base * base % p, power >> 1
        return out

    for k in range(d - 2):
        pivot = k + 1 + np.argmax(a[:, k + 1 :, k] != 0, axis=1)
        a[at, pivot], a[at, k + 1] = a[at, k + 1].copy(), a[at, pivot].copy()
        a[at, :, pivot], a[at, :, k + 1] = a[at, :, k + 1].copy(), a[at, :, pivot].copy()
        u = a[:, k + 2 :, k] * inverse(a[:, k + 1, k])[:, None] % p[:, None]  # 0 where the whole column is
        a[:, k + 2 :] = (a[:, k + 2 :] - u[:, :, None] * a[:, k + 1, None] % q) % q
        a[:, :, k + 1] = (a[:, :, k + 1] + (a[:, :, k + 2 :] * u[:, None] % q).sum(2)) % p[:, None]
    polys = np.zeros((count, d + 1, d + 1), np.int64)
    polys[:, 0, 0] = 1
    for k in range(d):
        # det(x - H) of the leading k + 1 rows, by expansion along the last column
        t, run = np.zeros((count, k + 1), np.int64), np.ones(count, np.int64)
        for i in range(k, -1, -1):
            t[:, i] = a[:, i, k] * run % p
            if i:
                run = run * a[:, i, i - 1] % p
        new = -(t[:, :, None] * polys[:, : k + 1] % q).sum(1)
        new[:, 1:] += polys[:, k, :-1]
        polys[:, k + 1] = new % p[:, None]
    return polys[:, d]


def characteristic_polynomial(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Coefficients, constant term first, of det(x - m) of an integer matrix without negative eigenvalues."""
    d, trace = len(m), int(np.trace(m))
    # the k-th elementary symmetric function of such roots is at most comb(d, k) (trace / d)^k
    bound = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    used = primes(bound.bit_length() + 1)
    step = max(1, min(16, (1 << 22) // (d * d)))

    def residues(batches):
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            for k in range(0, len(numbers), step):
                p = np.array([used[i] for i in numbers[k : k + step]], np.int64)
                a = np.stack([(m % int(x)).astype(np.int64) for x in p])
                c = hessenberg_polynomials(a, p)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(d + 1), len(p))), pa.array(np.repeat(p, d + 1)), pa.array(c.reshape(-1))], names=["k", "p", "c"])

    def remainder(pdf: pd.DataFrame) -> pd.DataFrame:
        value, product = 0, 1
        for p, c in sorted(zip(pdf["p"].tolist(), pdf["c"].tolist(), strict=True)):
            value, product = value + product * ((c - value) * pow(product, -1, p) % p), product * p
        value -= product if 2 * value > product else 0
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "value": [hex(value)]})

    tasks = max(1, min(len(used), spark.sparkContext.defaultParallelism))
    rows = spark.range(0, len(used), 1, tasks).mapInArrow(residues, "k long, p long, c long").groupBy("k").applyInPandas(remainder, "k long, value string")
    return [int(r.value, 16) for r in sorted(rows.collect())]


class Roots:
    """Roots of a polynomial whose roots are all real; places are integers over 2^scale."""

    def __init__(self, coefficients: list[int]):
        self.c = coefficients
        self.d = len(coefficients) - 1

    def above(self, at: int, scale: int) -> int:
        """How many roots, as often as they count, are larger: sign variations of the shifted polynomial."""
        c = [x << scale * (self.d - k) for k, x in enumerate(self.c)]
        for i in range(self.d):
            for k in range(self.d - 1, i - 1, -1):
                c[k] += at * c[k + 1]
        signs = [x > 0 for x in c if x]
        return sum(a != b for a, b in zip(signs, signs[1:], strict=False))

    def sign(self, at: int, scale: int) -> int:
        value, power = 0, 0
        for x in reversed(self.c):
            value, power = value * at + (x << power), power + scale
        return (value > 0) - (value < 0)

    def largest(self, count: int, top: int, bits: int = BITS) -> list[tuple[Fraction, int]]:
        """(root, multiplicity), largest first, until ``count`` positive roots are named; all lie at ``top`` or below.

        A root lies within 2^-bits of its own size of what is given.
        """
        out: list[tuple[Fraction, int]] = []
        todo = [(0, top, 0, self.above(0, 0), 0)]  # low, high, scale: roots in (low, high], and how many lie above high
        while todo and sum(m for _, m in out) < count:
            low, high, scale, inside, over = todo.pop()
            if not inside:
                continue
            if low and (high - low) << bits <= low:
                out.append((Fraction(low + high, 2 << scale), inside))
                continue
            if high - low == 1:
                low, high, scale = low * 2, high * 2, scale + 1
            if inside == 1 and low and self.sign(high, scale):
                out.append((self._narrow(low, high, scale, bits), 1))
                continue
            mid = (low + high) // 2
            right = self.above(mid, scale) - over
            todo += [(low, mid, scale, inside - right, over + right), (mid, high, scale, right, over)]
        return out

    def _narrow(self, low: int, high: int, scale: int, bits: int) -> Fraction:
        """The one root in (low, high), where the sign changes; the last halving of ``low`` may meet it."""
        up = self.sign(high, scale)
        while (high - low) << bits > low:
            if high - low == 1:
                low, high, scale = low * 2, high * 2, scale + 1
            mid = (low + high) // 2
            s = self.sign(mid, scale)
            if s == 0:
                return Fraction(mid, 1 << scale)
            low, high = (low, mid) if s == up else (mid, high)
        return Fraction(low + high, 2 << scale)


def null_vectors(m: np.ndarray, unit: int, root: Fraction, many: int, others: list[np.ndarray]) -> list[np.ndarray]:
    """Orthonormal vectors that (m - root) / unit takes to 0: inverse iteration, refined by exact residuals."""
    d, scale = len(m), root.denominator
    shifted = m * scale
    shifted[np.diag_indices(d)] -= root.numerator
    b = (shifted / (unit * scale)).astype(np.float64)  # quotients of integers, rounded once
    near = b + np.eye(d) * (np.abs(b).max() or 1.0) * 2.0**-52
    w = np.linalg.qr(np.random.default_rng(many).standard_normal((d, many)))[0]
    for _ in range(6):
        w = np.linalg.solve(near, w)
        for o in others:
            w -= np.outer(o, o @ w)
        w = np.linalg.qr(w)[0]
    if many == 1:
        one = 1 << 80
        v = np.array([int(x * one) for x in w[:, 0]], object)
        for _ in range(4):
            f = (v / one).astype(np.float64)
            r = (shifted @ v / (unit * scale * one)).astype(np.float64)
            move = np.linalg.solve(np.block([[b, f[:, None]], [f[None], np.zeros((1, 1))]]), np.append(-r, 0.0))[:d]
            if not np.isfinite(move).all() or np.abs(move).max() > 0.1:
                break
            v = v + np.array([int(x * one) for x in move], object)
        f = (v / one).astype(np.float64)
        w = (f / np.linalg.norm(f))[:, None]
    return [x * (1 if x[np.argmax(np.abs(x))] > 0 else -1) for x in w.T]


@dataclass
class Whitener:
    """Components (rows) by falling eigenvalue of the covariance, and shares of its trace."""

    fit: Scatter
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def fit_whitener(rows: DataFrame, dim: int, count: int = 8) -> Whitener:
    """The first ``count`` components over ``rows`` of ``whole_vectors``."""
    fit = scatter(rows, dim) if dim else Scatter(0, np.zeros(0, object), np.zeros((0, 0), object))
    trace = int(np.trace(fit.matrix)) if dim else 0
    if not trace:
        return Whitener(fit, np.zeros((0, dim)), np.zeros(0), np.zeros(0))
    roots = Roots(characteristic_polynomial(rows.sparkSession, fit.matrix)).largest(count, trace)
    vectors, values = [], []
    for root, many in roots:
        vectors += null_vectors(fit.matrix, fit.n**2, root, many, vectors)
        values += [root] * many
    values = values[:count]
    return Whitener(fit, np.array(vectors[:count]), np.array([float(v / fit.n**2) for v in values]), np.array([float(v / trace) for v in values]))


def _project(dim: int, fitted: Whitener):
    n, sums = fitted.fit.n, fitted.fit.sums
    axes = (fitted.components / np.sqrt(fitted.eigenvalues)[:, None]).T

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                y = _integers(batch.column(1).slice(k, 4096), dim)
                narrow = n * (int(np.abs(y).max(initial=0)) + 1) + int(max(abs(s) for s in sums)) < 1 << 62
                away = n * y - sums.astype(np.int64) if narrow else n * y.astype(object) - sums
                top = int(np.abs(away).max(initial=0)) ** 2 * dim
                square = (away * away).sum(1) if top < 1 << 62 else (away.astype(object) ** 2).sum(1)
                w = (away / n).astype(np.float64) @ axes
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 4096), pa.array([str(s) for s in square.tolist()]), lists], names=["_id", "deviation", "whitened"])

    return run


def whiten(rows: DataFrame, dim: int, fitted: Whitener) -> DataFrame:
    """(_id as text, deviation decimal(38,0), whitened array<double>) of each row."""
    out = rows.select(F.col("_id").cast("string").alias("_id"), "_v").mapInArrow(_project(dim, fitted), "_id string, deviation string, whitened array<double>")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(whitened: DataFrame, count: int) -> float:
    """Largest distance of an entry of the covariance of ``whitened`` from the identity; centred before multiplying."""
    mean = np.array(whitened.agg(*[F.avg(F.col("whitened")[k]).alias(f"m{k}") for k in range(count)]).first())

    def run(batches):
        n, total = 0, np.zeros((count, count))
        for batch in batches:
            w = batch.column(0).flatten().to_numpy().reshape(-1, count) - mean
            n, total = n + len(w), total + w.T @ w
        if n:
            i, j = np.indices((count, count)).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.reshape(-1)), pa.array(np.full(count * count, n))], names=["i", "j", "s", "n"])

    cells = whitened.select("whitened").mapInArrow(run, "i long, j long, s double, n long").groupBy("i", "j").agg((F.sum("s") / F.sum("n")).alias("c"))
    return float(cells.agg(F.max(F.abs(F.col("c") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))).first()[0])


def whitened_components(df: DataFrame, count: int = 8, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each row and component."""
    rows, dim = whole_vectors(df, id_col, vec)
    fitted = fit_whitener(rows, dim, count)
    found = len(fitted.eigenvalues)
    if not found:
        kept = stored(rows.limit(0).select(F.col("_id").cast("string").alias("_id"), F.lit(0).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened")), "whitened")
        error = 0.0
    else:
        kept = stored(whiten(rows, dim, fitted), "whitened")
        error = identity_error(kept, found)
    each = kept.select("_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    share = F.array(*[F.lit(float(x)) for x in fitted.explained]) if found else F.array().cast("array<double>")
    return each.select(
        F.col("_id").cast(df.schema[id_col].dataType).alias(id_col),
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(fitted.fit.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("k")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitened_components(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))
