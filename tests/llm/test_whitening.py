import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import whitening


def exact_characteristic(m):
    """Faddeev and LeVerrier's recursion on fractions."""
    d = len(m)
    a = [[Fraction(x) for x in row] for row in m]
    eye = [[Fraction(int(i == j)) for j in range(d)] for i in range(d)]
    mul = lambda p, q: [[sum(p[i][k] * q[k][j] for k in range(d)) for j in range(d)] for i in range(d)]
    coefficients, b = [Fraction(1)], eye
    for k in range(1, d + 1):
        ab = mul(a, b)
        c = -sum(ab[i][i] for i in range(d)) / k
        coefficients.append(c)
        b = [[ab[i][j] + c * eye[i][j] for j in range(d)] for i in range(d)]
    return [int(c) for c in reversed(coefficients)]


def gram(d, rows, seed, width=50):
    rnd = random.Random(seed)
    v = [[rnd.randrange(-width, width) for _ in range(d)] for _ in range(rows)]
    return [[sum(r[i] * r[j] for r in v) for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("matrix", [gram(7, 20, 1), gram(8, 3, 2), [[5]], [[2, 0, 0], [0, 2, 0], [0, 0, 3]], [[0, 0], [0, 4]], [[4, 0, 0, 2], [0, 0, 0, 0], [0, 0, 9, 0], [2, 0, 0, 1]]])
def test_characteristic_polynomial(spark, matrix):
    assert whitening.characteristic(spark, matrix) == exact_characteristic(matrix)


def test_roots_are_isolated_and_counted():
    def poly(values):
        out = [1]
        for v in values:
            out = [a - v * b for a, b in zip([0] + out, out + [0])]
        return out

    values = [0, 0, 3, 7, 7, 7, 8, 1000, 10**12, 10**12 + 1]
    assert [whitening.above(poly(values), t, 0) for t in (0, 7, 8, 10**12)] == [8, 4, 3, 1]
    got = whitening.roots(poly(values), 99)
    assert [t for _, t in got] == [1, 1, 1, 1, 3, 1] and all(abs(r - v) < Fraction(1, 10**30) * v for (r, _), v in zip(got, [10**12 + 1, 10**12, 1000, 8, 7, 3]))
    assert sum(t for _, t in whitening.roots(poly(values), 4)) == 4
    assert whitening.roots([0, 0, 1], 5) == []


def test_primes():
    assert whitening.is_prime(2**31 - 1) and not whitening.is_prime(2**31 - 3) and math.prod(whitening.primes_for(10**40)) > 10**40


def test_exact_products():
    rnd = random.Random(4)
    for top in (10, 2**21, 2**45, 2**61):
        rows = [[rnd.randrange(-top, top) for _ in range(3)] for _ in range(50)]
        got = whitening.products(np.array(rows, np.int64))
        assert got.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(3)] for i in range(3)]


def expected(rows):
    fine = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for _, v in fine)
    x = [[math.floor(64 * c) + 1_000_000 for c in list(v) + [0.0] * (d - len(v))] for _, v in fine]
    n, s = len(x), [sum(c) for c in zip(*x)]
    dev = [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(r, s)] for r in x])
    return fine, n, dev, centred


def check(spark, rows, count):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("x")).withColumn("whitened", F.lit(0)).repartition(3)
    got = whitening.whitened_components(df, count=count).collect()
    fine, n, dev, centred = expected(rows)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = int((values > 1e-9 * values[0]).sum())
    k = min(count, rank)
    assert len(got) == len(fine) * k and all(r.n == n and r.identity_error < 1e-9 for r in got)
    assert sorted((repr(r.vec_id), int(r.deviation)) for r in got if r.component == 1) == sorted((repr(i), e) for (i, _), e in zip(fine, dev))
    for c in range(k):
        mine = sorted((repr(r.vec_id), r.whitened) for r in got if r.component == c + 1)
        assert all(abs(r.explained - values[c] / values.sum()) < 1e-9 for r in got if r.component == c + 1)
        if min(abs(values[c] - v) for i, v in enumerate(values) if i != c) > 1e-6 * values[0]:
            want = centred @ vectors[:, c] / math.sqrt(values[c])
            plus, minus = (sorted((repr(i), x) for (i, _), x in zip(fine, sign * want)) for sign in (1, -1))
            assert any(np.allclose([x for _, x in mine], [x for _, x in w], atol=1e-7) for w in (plus, minus))


def test_against_floats(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 1 + j) for j in range(6)]) for i in range(300)]
    odd = [(1, rows[5][1]), (300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [0.5] * 6), (304, [1.0, 2.0]), (305, [])]
    check(spark, rows + odd, 4)
    check(spark, [(i, [1e9 * v[0], 3e7 * v[1]]) for i, v in rows], 9)  # beyond the fast path


def test_rank_and_repeated_eigenvalues(spark):
    rnd = random.Random(6)
    low = [(i, [float(a), 2.0 * a, float(b), 5.0]) for i in range(80) for a, b in [(rnd.randrange(9), rnd.randrange(9))]]
    check(spark, low, 32)
    cross = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [-1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [0.0, -1.0, 0.0, 0.0]), (4, [0.0, 0.0, 2.0, 0.0]), (5, [0.0, 0.0, -2.0, 0.0])]
    check(spark, cross, 3)
    check(spark, cross, 2)  # one of two equal ones


def test_nothing_to_whiten(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert whitening.whitened_components(df).collect() == [] and whitening.whitened_components(df.limit(0)).collect() == []
    assert whitening.whitened_components(spark.createDataFrame([(1, [1.0]), (2, [1.0])], "vec_id long, embedding array<float>")).collect() == []
