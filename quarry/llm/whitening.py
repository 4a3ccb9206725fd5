"""Whitening of embeddings from the exact characteristic polynomial of their integer scatter.

Vectors become integers; tasks sum them and their products exactly, so M = n * sum(x x') - S S' is an integer matrix
whatever the number of rows and tasks.  Then, on matrices of the vectors' dimension only:

1. det(t I - M) modulo primes below 2**31, by reduction to Hessenberg form, the primes dealt to tasks; Chinese remainders
   give the integer coefficients, as many primes as their bound needs.
2. All roots of it are real, so the sign changes of its coefficients shifted to t count the roots above t exactly (Descartes).
   Bisection by that count isolates the roots as dyadic intervals, repeated roots together; signs refine them.
3. A component is the null space of M - root * I, by inverse iteration in long decimals, a task a root.

Rows are projected where they lie.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import map_rows
from quarry.llm.topk import usable

SCALE, COMPONENTS = 64, 32
#: Added to every entry; it cancels in scatter and deviations, which tasks therefore compute without it.
OFFSET = 1_000_000
#: A root's interval is narrower than its value, and than its distance to the next root, by so many bits.
BITS = 110
#: Bits of a limb: products of two, summed over ROWS rows, stay below 2**53.
LIMB, ROWS = 20, 4096


def integers(vectors: pa.Array, dims: int | None = None, scale: int = SCALE) -> np.ndarray:
    """floor(scale * c) of each entry, shorter vectors padded with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    width = max(int(lengths.max(initial=0)), dims or 0)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale
    if not (np.abs(values) < 2.0**62).all():
        raise OverflowError("an entry leaves 64 bits when scaled")
    grid = np.zeros((len(lengths), width), np.int64)
    grid[np.arange(width) < lengths[:, None]] = np.floor(values).astype(np.int64)
    return grid


def products(grid: np.ndarray) -> np.ndarray:
    """Exact sum of v v' over at most ROWS rows, as Python integers: float products of limbs that can't round."""
    limbs, left = [], grid
    while (np.abs(left) >= 1 << LIMB).any():
        limbs.append((left & ((1 << LIMB) - 1)).astype(np.float64))
        left = left >> LIMB
    limbs.append(left.astype(np.float64))
    total = np.zeros((grid.shape[1], grid.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            total += (a.T @ b).astype(np.int64).astype(object) * (1 << (LIMB * (i + j)))
    return total


def grown(array: np.ndarray, *shape: int) -> np.ndarray:
    """An array with zeros added up to a shape."""
    out = np.zeros(shape, array.dtype)
    out[tuple(map(slice, array.shape))] = array
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's rows -> sums (i, j, total): of products for i <= j, of entries for j = -1, of rows for i = j = -1."""
    n, first, second = 0, np.zeros(0, object), np.zeros((0, 0), object)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            grid = integers(batch.column(1).slice(at, ROWS))
            d = max(grid.shape[1], len(first))
            first, second, grid = grown(first, d), grown(second, d, d), grown(grid, len(grid), d)
            n += len(grid)
            # object sums, as entries can be near 2**62
            first = first + (grid >> 31).sum(0).astype(object) * (1 << 31) + (grid & ((1 << 31) - 1)).sum(0).astype(object)
            second = second + products(grid)
    d = len(first)
    rows = [(-1, -1, n)] + [(i, -1, int(first[i])) for i in range(d)] + [(i, j, int(second[i, j])) for i in range(d) for j in range(i, d)]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([decimal.Decimal(r[2]) for r in rows], pa.decimal128(38, 0))], ["i", "j", "total"])


def is_prime(n: int) -> bool:
    """Miller and Rabin's test with bases that decide every n below 3,215,031,751."""
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if base % n and x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """The largest primes below 2**31 whose product is above a bound."""
    found, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(p):
            found.append(p)
            product *= p
        p -= 2
    return found


def characteristic_mod(matrix: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients of det(t I - matrix), lowest first, modulo each prime: one row a prime."""
    d, count = len(matrix), len(primes)
    p = np.array(primes, np.int64)[:, None, None]
    h = np.array([[[x % q for x in row] for row in matrix] for q in primes], np.int64).reshape(count, d, d)
    every = np.arange(count)
    for m in range(1, d - 1):
        pivot = m + (h[:, m:, m - 1] != 0).argmax(1)
        h[every, m], h[every, pivot] = h[every, pivot], h[every, m]
        h[every, :, m], h[every, :, pivot] = h[every, :, pivot], h[every, :, m]
        inverse = np.array([pow(x, -1, q) if x else 0 for x, q in zip(h[:, m, m - 1].tolist(), primes, strict=True)], np.int64)
        u = h[:, m + 1 :, m - 1] * inverse[:, None] % p[:, 0]
        h[:, m + 1 :] = (h[:, m + 1 :] - u[:, :, None] * h[:, m, None] % p) % p
        h[:, :, m] = (h[:, :, m] + (h[:, :, m + 1 :] * u[:, None] % p).sum(2)) % p[:, 0]
    flat = p[:, 0]
    polys = np.zeros((d + 1, count, d + 1), np.int64)
    polys[0, :, 0] = 1
    for k in range(1, d + 1):
        new = -(polys[k - 1] * h[:, k - 1, k - 1, None] % flat)
        new[:, 1:] += polys[k - 1, :, :-1]
        below = np.ones((count, 1), np.int64)
        for i in range(k - 1, 0, -1):
            below = below * h[:, i, i - 1, None] % flat
            new -= polys[i - 1] * (below * h[:, i - 1, k - 1, None] % flat) % flat
        polys[k] = new % flat
    return polys[d]


def remainders_joined(residues: list[list[int]], primes: list[int]) -> list[int]:
    """Signed integers from their residues modulo primes."""
    whole = math.prod(primes)
    basis = [whole // q * pow(whole // q, -1, q) for q in primes]
    joined = [sum(r[i] * b for r, b in zip(residues, basis, strict=True)) % whole for i in range(len(residues[0]))]
    return [x - whole if x > whole // 2 else x for x in joined]


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Integer coefficients of det(t I - matrix), lowest first, of a symmetric matrix without negative eigenvalues.

    Its coefficients are elementary symmetric sums of eigenvalues: the k-th is at most C(d, k) (trace / d) ** k.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = 2 * max(math.comb(d, k) * -(-(trace**k) // d**k) for k in range(d + 1))
    primes = primes_for(bound)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = characteristic_mod(matrix, batch.column(0).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.tolist(), pa.list_(pa.int64()))], ["prime", "residues"])

    dealt = spark.createDataFrame([(q,) for q in primes], "prime long").repartition(max(1, len(primes) // 16))
    rows = map_rows(dealt, run, "prime long, residues array<long>", 64).collect()  # d + 1 numbers a prime
    return remainders_joined([r.residues for r in rows], [r.prime for r in rows])


def above(poly: list[int], t: int, s: int) -> int:
    """How many roots exceed t / 2**s, repeated ones as often as they occur; all roots of poly must be real."""
    d = len(poly) - 1
    c = [x << (s * (d - k)) for k, x in enumerate(poly)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += t * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def sign_at(poly: list[int], t: int, s: int) -> int:
    d, v = len(poly) - 1, 0
    for k in range(d, -1, -1):
        v = v * t + (poly[k] << (s * (d - k)))
    return (v > 0) - (v < 0)


def roots(poly: list[int], count: int, bits: int = BITS) -> list[tuple[Fraction, int]]:
    """The `count` largest positive roots, and those equal to the last, falling: (value, how often).

    poly is monic with real roots >= 0.  Values are right to `bits` bits of themselves and of the gap to their neighbours;
    roots that 2 * bits bits can't tell apart count as equal.
    """
    zeros = next(k for k, c in enumerate(poly) if c)
    poly = poly[zeros:]
    d = len(poly) - 1
    top = max(1, -poly[d - 1] if d else 1).bit_length()
    found: list[tuple[int, int, int, int, int]] = []  # (low, high, s, roots inside, roots above): root in (low, high] / 2**s
    todo, seen = [(0, 1 << top, 0, d, 0)] if d else [], 0
    while todo and seen < count:
        low, high, s, most, least = todo.pop()
        if most - least == 0:
            continue
        narrow = low > 0 and (high - low) << (2 * bits) <= low
        if narrow or (most - least == 1 and low > 0):
            found.append((low, high, s, most - least, least))
            seen += most - least
            continue
        low, high, s = 2 * low, 2 * high, s + 1
        mid = (low + high) // 2
        inside = above(poly, mid, s)
        todo += [(low, mid, s, most, inside), (mid, high, s, inside, least)]
    out: list[tuple[Fraction, int]] = []
    for i, (low, high, s, times, least) in enumerate(found):
        near = [abs(Fraction(low, 1 << s) - Fraction(o[0], 1 << o[2])) for j, o in enumerate(found) if abs(i - j) == 1]
        gap = min([x for x in near if x] + [Fraction(low, 1 << s)])
        over = (-1) ** least
        while times == 1 and Fraction(high - low, 1 << s) * (1 << bits) > gap:
            low, high, s = 2 * low, 2 * high, s + 1
            mid = (low + high) // 2
            sign = sign_at(poly, mid, s)
            low, high = (mid, mid) if not sign else (low, mid) if sign == over else (mid, high)
        out.append((Fraction(low + high, 2 << s), times))
    return out


def null_space(matrix: list[list[int]], root: Fraction, times: int, digits: int) -> np.ndarray:
    """`times` orthonormal vectors (rows) of the null space of matrix - root * I, by inverse iteration with `digits` digits."""
    with decimal.localcontext(prec=digits, Emin=-10**9, Emax=10**9):
        d, unit = len(matrix), decimal.Decimal(1)
        a = np.array([[decimal.Decimal(x) for x in row] for row in matrix], object)
        a[np.arange(d), np.arange(d)] -= decimal.Decimal(root.numerator) / root.denominator
        tiny = max(abs(x) for x in a.ravel()) * unit.scaleb(-digits)
        order = np.arange(d)
        for k in range(d):
            best = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            a[[k, best]], order[[k, best]] = a[[best, k]], order[[best, k]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
        found: list[np.ndarray] = []
        for start in range(times):
            y = np.array([unit / (1 + (i * 7 + start * 13 + i * i * (start + 1)) % 101) for i in range(d)], object)
            for _ in range(3):
                z = y[order]
                for k in range(d):
                    z[k + 1 :] -= a[k + 1 :, k] * z[k]
                for k in range(d - 1, -1, -1):
                    z[k] = z[k] / a[k, k]
                    z[:k] -= a[:k, k] * z[k]
                for _ in range(2):
                    z = z / (z @ z).sqrt()
                    for other in found:
                        z = z - other * (other @ z)
                y = z / (z @ z).sqrt()
            found.append(y)
        return np.array([[float(x) for x in y] for y in found])


@dataclass
class Whitening:
    """n vectors with sums (of floor(scale * c)) per dimension; components as columns, largest eigenvalue first."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: list[float]
    explained: list[float]
    scale: int = SCALE

    def project(self, grid: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Exact sums of (n * x - S) ** 2, and whitened values."""
        most = max((abs(s) for s in self.sums), default=0) + self.n * int(np.abs(grid).max(initial=0))
        kind = np.int64 if most * most * max(1, len(self.sums)) < 2**62 else object
        away = grid.astype(kind) * self.n - np.array(self.sums, kind)
        whitened = (away.astype(np.float64) / self.n) @ self.components / np.sqrt(np.array(self.eigenvalues))
        return (away * away).sum(1).tolist(), whitened


def fit_whitening(vectors: DataFrame, vector_col: str = "embedding", count: int = COMPONENTS) -> Whitening | None:
    """The components of all usable vectors; None without any.  At most the scatter's rank, however many are asked for."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(vector_col)).select(F.lit(0).alias("k"), F.col(vector_col).cast("array<double>").alias("v"))
    sums = rows.mapInArrow(_sums, "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total").alias("total"))
    total = {(r.i, r.j): int(r.total) for r in sums.collect()}  # (d + 1)(d + 2) / 2 numbers
    n = total.get((-1, -1), 0)
    if not n:
        return None
    d = 1 + max(i for i, _ in total)
    s = [total[i, -1] for i in range(d)]
    scatter = [[n * total[min(i, j), max(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)]
    shared = math.gcd(*[x for row in scatter for x in row]) if d else 0
    if not shared:
        return Whitening(n, s, np.zeros((d, 0)), [], [])
    matrix = [[x // shared for x in row] for row in scatter]
    trace = sum(matrix[i][i] for i in range(d))
    found = roots(characteristic(spark, matrix), count)
    gaps = [a[0] - b[0] for a, b in zip(found, found[1:], strict=False)] + [r for r, _ in found]
    digits = 40 + 2 * math.ceil(BITS * 0.30103) + math.ceil(math.log10(trace / min(gaps))) if found else 0

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [r.as_py() for r in batch.column(0)]
        out = [null_space(matrix, found[r][0], found[r][1], digits).tolist() for r in rows]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.list_(pa.float64())))], ["root", "vectors"])

    dealt = spark.createDataFrame([(i,) for i in range(len(found))], "root int").repartition(max(1, len(found)), "root")
    spaces = {r.root: r.vectors for r in map_rows(dealt, run, "root int, vectors array<array<double>>").collect()}  # d numbers a component
    flat = [(v, root) for i, (root, _) in enumerate(found) for v in spaces[i]][:count]
    values = [float(root * shared / (n * n)) for _, root in flat]
    return Whitening(n, s, np.array([v for v, _ in flat]).T, values, [float(root / trace) for _, root in flat])


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per usable vector: (vec_id, deviation decimal, whitened array, one value a component)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        away, whitened = model.project(integers(batch.column(1), len(model.sums), model.scale))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(decimal.Decimal, away), pa.decimal128(38, 0)), pa.array(whitened.tolist(), pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"])

    rows = vectors.where(usable(vector_col)).select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return map_rows(rows, run, f"vec_id {vectors.schema[id_col].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>", ROWS)


def identity_error(whitened: DataFrame, count: int) -> float:
    """Largest absolute entry of the covariance of whitened values minus the identity, from sums of one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(count), np.zeros((count, count))
        for batch in batches:
            y = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, count)
            n, first, second = n + len(y), first + y.sum(0), second + y.T @ y
        rows = [(-1, -1, float(n))] + [(i, -1, first[i]) for i in range(count)] + [(i, j, second[i, j]) for i in range(count) for j in range(i, count)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64())], ["i", "j", "total"])

    total = {(r.i, r.j): r.total for r in whitened.select("whitened").mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
    n = total.get((-1, -1), 0)
    # values are centred exactly before they are projected, so their means are rounding only
    return max((abs(total[i, j] / n - total[i, -1] / n * total[j, -1] / n - (i == j)) for i in range(count) for j in range(i, count)), default=0.0) if n else 0.0


def whitened_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable vector and component.

    A vector that is null or holds null or non-finite entries takes no part, in the fit neither; a shorter one counts as padded
    with zeros, an empty one too.  Rows may repeat, and their ids may be null or repeat: each is a row of the fit and of the result.
    A direction without variance can't be whitened and is no component, so equal rows only, or no rows, give none.
    Entries whose scaled value leaves 64 bits, or deviations beyond 38 digits, are errors.  Other columns play no part.
    """
    schema = f"vec_id {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit_whitening(vectors, vector_col, count)
    if model is None or not model.eigenvalues:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = whiten(vectors, model, id_col, vector_col)
    error = identity_error(rows, len(model.eigenvalues))
    told = F.array(*[F.lit(x) for x in model.explained])
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", told[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )
