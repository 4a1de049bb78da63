"""Whitening against numpy's eigenvectors and integer arithmetic."""

from fractions import Fraction

import numpy as np

from driftgauge.llm import whitening as W
from driftgauge.llm.common import table


def determinant(m) -> Fraction:
    m, out = [[Fraction(x) for x in r] for r in m], Fraction(1)
    for k in range(len(m)):
        p = next((i for i in range(k, len(m)) if m[i][k]), None)
        if p is None:
            return Fraction(0)
        if p != k:
            m[k], m[p], out = m[p], m[k], -out
        out *= m[k][k]
        for i in range(k + 1, len(m)):
            f = m[i][k] / m[k][k]
            m[i] = [a - f * b for a, b in zip(m[i], m[k], strict=True)]
    return out


def test_polynomial_is_the_determinant(spark):
    draw = np.random.default_rng(0)
    for d, rank in ((1, 1), (2, 2), (5, 5), (6, 3), (8, 8)):
        x = draw.integers(-10_000, 10_000, (d, rank)).astype(object)
        m = x @ x.T
        c = W.characteristic_polynomial(spark, m)
        assert c[-1] == 1 and len(c) == d + 1
        for at in (0, 7, -3, 10**9):
            assert sum(a * at**k for k, a in enumerate(c)) == determinant([[at * (i == j) - m[i, j] for j in range(d)] for i in range(d)])


def test_polynomial_of_matrices_with_zero_pivots(spark):
    m = np.array([[2, 0, 0, 1], [0, 3, 0, 0], [0, 0, 3, 0], [1, 0, 0, 2]], object)
    assert W.characteristic_polynomial(spark, m) == [27, -54, 36, -10, 1]


def polynomial(roots):
    c = [1]
    for r in roots:
        c = [b - r * a for a, b in zip([*c, 0], [0, *c], strict=True)]
    return c


def test_roots_and_multiplicities():
    roots = [0, 0, 5, 9, 9, 9, 10**12, 10**12 + 1]
    got = W.Roots(polynomial(roots)).largest(8, 3 * 10**12)
    assert [m for _, m in got] == [1, 1, 3, 1]
    assert all(abs(a / b - 1) < Fraction(1, 2**95) for (a, _), b in zip(got, [10**12 + 1, 10**12, 9, 5], strict=True))
    assert W.Roots(polynomial([4, 4, 4])).largest(2, 12)[0][1] == 3
    assert [r for r, _ in W.Roots(polynomial([1, 2, 3])).largest(1, 8)] == [3]


def check(rows, got, count=8):
    """``got`` against numpy on the rows' vectors."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(1024 * np.array([v for _, v in good], np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    away = [[n * int(a) - int(s) for a, s in zip(r, sums, strict=True)] for r in x]
    c = np.array(away, np.float64) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    count = min(count, int((e > 1e-9 * e[0]).sum()))
    want = c @ v[:, :count] / np.sqrt(e[:count])
    assert len(got) == n * count
    by = {(r.vec_id, r.component): r for r in got}
    for k in range(count):
        mine = np.array([by[i, k + 1].whitened for i, _ in good])
        sign = np.sign(mine @ want[:, k])
        assert np.abs(mine * sign - want[:, k]).max() < 1e-7
        assert abs(by[good[0][0], k + 1].explained / (e[k] / e.sum()) - 1) < 1e-9
    for (i, _), a in zip(good, away, strict=True):
        assert by[i, 1].deviation == sum(t * t for t in a) and by[i, 1].n == n
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_query_against_numpy(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    got = W.op13_embedding_whitening(spark, sf)
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["component"] == "int"
    check(rows, got.collect())


def test_rows_that_take_no_part(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=5).tolist()) for i in range(60)]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows] + [(104, [], 1, 2), (105, [1.0, 2.0], 1, 2)], "vec_id long, embedding array<double>, n int, component int")
    check(rows, W.whitened_components(df).collect())
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert W.whitened_components(same).count() == 0
    assert W.whitened_components(df.limit(0)).count() == 0
    assert W.whitened_components(df.where("vec_id >= 100 and vec_id < 104")).count() == 0


def test_wide_numbers_and_equal_eigenvalues(spark):
    rows = [(2 * k + s, [(1 - 2 * s) * 3e9 * (i == k) for i in range(4)]) for k in range(4) for s in (0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = W.whitened_components(df).collect()
    assert len(got) == 8 * 4 and got[0].identity_error < 1e-9 and all(abs(r.explained - 0.25) < 1e-12 for r in got)
    x = [[int(1024 * c) for c in v] for _, v in rows]
    assert {r.deviation for r in got} == {sum((8 * c) ** 2 for c in v) for v in x}


def test_close_eigenvalues_by_exact_residuals():
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((6, 6)))[0]
    m = np.array([[int(x) for x in r] for r in np.round(2.0**40 * (q * np.array([5, 1 + 2e-7, 1 + 1e-7, 1, 0.5, 0.1])) @ q.T)], object)
    m = (m + m.T)  # whole and symmetric
    values = np.linalg.eigvalsh(m.astype(np.float64))[::-1]
    vectors = []
    for k in range(4):
        root = Fraction(int(values[k] * 2**20), 2**20)
        for _ in range(3):  # Rayleigh quotients in whole numbers stand in for the polynomial's roots
            v = np.array([int(x * 2**60) for x in W.null_vectors(m, 1 << 41, root, 1, [])[0]], object)
            root = Fraction(int(v @ m @ v), int(v @ v))
        vectors.append(W.null_vectors(m, 1 << 41, root, 1, [])[0])
    gram = np.array(vectors) @ np.array(vectors).T
    assert np.abs(gram - np.eye(4)).max() < 1e-8
