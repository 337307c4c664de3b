"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

1. Entries become whole numbers x = floor(1024 c) + 100000. Counts, sums and sums of products over all rows are exact: in tasks
   as products of limbs that doubles hold exactly, between tasks as limbs in columns of long. The scatter M = n sum(x x') - S S'
   (n^2 times the covariance) is a matrix of whole numbers of any size; it doesn't change if all x are shifted.
2. Its characteristic polynomial: modulo primes of 31 bits, by similarity to Hessenberg form and the recurrence of its leading
   minors, a task some primes; put together by Chinese remainders. There are as many primes as the bound
   C(d, k) (trace / d)^k on the coefficients of a positive semidefinite matrix asks for.
3. All roots are real, so by Descartes' rule the sign changes of p(x + a) count the roots above a, multiplicities included.
   Halving with exact shifts isolates the largest roots and goes on to DIGITS bits below the leading one.
4. Components: inverse iteration on M - root in decimals of PRECISION digits. A start vector of a root of multiplicity m is made
   orthogonal to the earlier ones, which gives a basis of the null space. The entry of largest size is made positive.

Rows whose vector is null or holds null, NaN or infinite entries are dropped, and so are those whose length isn't the
commonest one (of equally common ones the larger stays) and empty vectors. Entries beyond 2^62 / 1024 count as that. Null
identifiers and repeated rows are rows like others. Components end where roots are zero: of n equal vectors there are none, and
no rows then; an empty table gives none either. deviation is null where it passes 64 bits, deviation_exact where it
passes 38 digits. Other columns are ignored.

The driver holds the d x d scatter and the polynomial, tasks a batch of vectors: nothing there grows with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Bits of a root below its leading one; digits of the decimals; bits of a limb in products and in the columns between tasks.
DIGITS, PRECISION, LIMB, WIDE = 160, 120, 20, 40
_MOST = (1 << 62) - 1


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))), F.lit(False))


def whole(vectors: pa.Array, dims: int) -> np.ndarray:
    """floor(1024 c) of a batch's vectors (row, dimension)."""
    c = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
    return np.clip(np.floor(SCALE * c), -float(1 << 62), float(_MOST - 1023)).astype(np.int64)


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """y as doubles: sum of limb k times 2^(20 k), the last one signed."""
    out, top = [], int(np.abs(y).max(initial=0))
    while top >> LIMB:
        out.append((y & ((1 << LIMB) - 1)).astype(float))
        y = y >> LIMB
        top >>= LIMB
    return [*out, y.astype(float)]


def products(y: np.ndarray) -> np.ndarray:
    """Sums over the rows of y_i y_j, as Python's integers."""
    total = np.zeros((y.shape[1],) * 2, object)
    for a in range(0, len(y), 8192):  # 8192 products of two limbs are under 2^53
        limbs = _limbs(y[a : a + 8192])
        for i, p in enumerate(limbs):
            for j, q in enumerate(limbs[i:], i):
                s = (p.T @ q).astype(np.int64).astype(object) << (LIMB * (i + j))
                total = total + (s if i == j else s + s.T)
    return total


def scatter(vectors: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """Rows, sums of floor(1024 c) and sums of products over all rows of a column v, exact."""
    i, j = np.triu_indices(dims)
    at = np.concatenate([[-2], i * dims + j, dims * dims + np.arange(dims)])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, square = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for b in batches:
            y = whole(b.column(0), dims)
            n += len(y)
            square = square + products(y)
            sums = sums + np.array([(y >> 32).sum(0), (y & 0xFFFFFFFF).sum(0)], object).T @ np.array([1 << 32, 1], object)
        if n:
            rest, columns = np.concatenate([[n], square[i, j], sums]), []
            for _ in range(4):
                columns.append(pa.array((rest & ((1 << WIDE) - 1)).tolist(), pa.int64()))
                rest = rest >> WIDE
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *columns, pa.array(rest.tolist(), pa.int64())], names=["at", "p0", "p1", "p2", "p3", "p4"])

    parts = vectors.select("v").mapInArrow(part, "at long, p0 long, p1 long, p2 long, p3 long, p4 long")
    found = parts.groupBy("at").agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in range(5)]).collect()  # d (d + 3) / 2 + 1 rows
    value = {r["at"]: sum(r[f"p{k}"] << (WIDE * k) for k in range(5)) for r in found}
    square = np.zeros((dims, dims), object)
    for a, b in zip(i.tolist(), j.tolist()):
        square[a, b] = square[b, a] = value.get(a * dims + b, 0)
    return value.get(-2, 0), [value.get(dims * dims + k, 0) for k in range(dims)], square


def _is_prime(n: int) -> bool:
    """For odd n under 3215031751: Miller and Rabin's test with bases 2, 3, 5 and 7 is exact there."""
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes(bits: int) -> list[int]:
    """Primes under 2^31, largest first, whose product has more than so many bits."""
    out, n, have = [], (1 << 31) - 1, 0.0
    while have <= bits + 1:
        if _is_prime(n):
            out.append(n)
            have += math.log2(n)
        n -= 2
    return out


def polynomial_mod(m: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - m) modulo a prime under 2^31, constant first; m: entries modulo p."""
    h, d = m.astype(np.int64) % p, len(m)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        r = k + 1 + int(below[0])
        if r != k + 1:
            h[[k + 1, r]] = h[[r, k + 1]]
            h[:, [k + 1, r]] = h[:, [r, k + 1]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1][None, :] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u[None, :] % p).sum(1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)  # of the leading k x k part, constant first
    minors[0, 0] = 1
    for k in range(d):
        new = np.zeros(d + 1, np.int64)
        new[1:] = minors[k, :-1]
        new = (new - int(h[k, k]) * minors[k]) % p
        t = 1
        for i in range(k - 1, -1, -1):
            t = t * int(h[i + 1, i]) % p
            if not t:
                break
            new = (new - int(h[i, k]) * t % p * minors[i]) % p
        minors[k + 1] = new
    return minors[d].tolist()


def polynomial(spark: SparkSession, m: np.ndarray) -> list[int]:
    """The characteristic polynomial of a positive semidefinite matrix of integers, constant first. Tasks take some primes each."""
    d, trace = len(m), sum(int(m[k, k]) for k in range(len(m)))
    bound = max(math.comb(d, k) * (-(-trace // d)) ** k for k in range(d + 1))
    moduli = primes(2 * bound.bit_length() + 2 if bound < 2 else bound.bit_length() + 2)
    entries = [int(x) for x in m.ravel()]

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                c = polynomial_mod(np.array([x % p for x in entries], np.int64).reshape(d, d), p)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([c], pa.list_(pa.int64()))], names=["p", "c"])

    tasks = max(1, min(len(moduli), spark.sparkContext.defaultParallelism * 4))
    rows = spark.createDataFrame([(p,) for p in moduli], "p long").repartition(tasks).mapInArrow(some, "p long, c array<long>").collect()
    value, modulus = [0] * (d + 1), 1
    for r in sorted(rows, key=lambda r: -r["p"]):
        p = r["p"]
        inverse = pow(modulus, -1, p)
        value = [v + modulus * ((c - v) * inverse % p) for v, c in zip(value, r["c"])]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in value]


def _signs(c: list[int]) -> int:
    """Sign changes of the coefficients."""
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _shifted(c: list[int]) -> list[int]:
    """Coefficients of p(x + 1), constant first."""
    c = c[:]
    for k in range(len(c) - 1):
        for i in range(len(c) - 2, k - 1, -1):
            c[i] += c[i + 1]
    return c


def largest_roots(c: list[int], k: int) -> list[tuple[int, int, int]]:
    """(numerator, exponent, multiplicity) of the largest positive roots of a monic polynomial whose roots are all real and not negative, k or more with multiplicity if there are so many: root = numerator / 2^exponent, off by less than its last place. Roots that DIGITS bits don't tell apart are one."""
    d = len(c) - 1
    width = max(0, -c[d - 1]).bit_length()  # no root is above their sum, as none is negative
    out: list[tuple[int, int, int]] = []
    # An interval [a, a + 1) / 2^e of roots: polynomial with that interval as [0, 1), and sign changes at both ends.
    start = [x << (width * i) for i, x in enumerate(c)]
    todo = [(0, -width, start, _signs(start), 0)]
    while todo and sum(m for *_, m in out) < k:
        a, e, p, low, high = todo.pop()
        if low == high:
            continue
        if a and a.bit_length() > DIGITS:
            out.append((2 * a + 1, e + 1, low - high))
            continue
        if not a and -e < -DIGITS:  # below any root that isn't zero
            continue
        left = [x << (d - i) for i, x in enumerate(p)]
        right = _shifted(left)
        mid = _signs(right)
        todo.append((2 * a, e + 1, left, low, mid))
        todo.append((2 * a + 1, e + 1, right, mid, high))  # the larger half first
    return out


def components(m: np.ndarray, roots: list[tuple[int, int, int]], k: int) -> tuple[list[Decimal], np.ndarray]:
    """Roots, each as often as its multiplicity, and unit vectors of the null spaces of m - root, at most k."""
    d, values, found = len(m), [], []
    with localcontext() as ctx:
        ctx.prec = PRECISION
        exact = np.array([[Decimal(int(x)) for x in row] for row in m], object)
        for numerator, exponent, multiplicity in roots:
            root = Decimal(numerator) / (Decimal(2) ** exponent if exponent >= 0 else Decimal(1) / Decimal(2) ** -exponent)
            tiny = root * Decimal(10) ** (30 - PRECISION)
            lu, order = exact - np.diag([root] * d), list(range(d))
            for c in range(d):  # elimination with partial pivoting
                r = max(range(c, d), key=lambda x: abs(lu[x, c]))
                lu[[c, r]] = lu[[r, c]]
                order[c], order[r] = order[r], order[c]
                if abs(lu[c, c]) < tiny:
                    lu[c, c] = tiny
                lu[c + 1 :, c] = lu[c + 1 :, c] / lu[c, c]
                lu[c + 1 :, c + 1 :] = lu[c + 1 :, c + 1 :] - np.outer(lu[c + 1 :, c], lu[c, c + 1 :])
            space: list[np.ndarray] = []
            for turn in range(multiplicity):
                v = np.array([Decimal(int(x)) for x in np.random.default_rng(turn).integers(-1000, 1001, d)], object)
                for _ in range(3):
                    for u in space:
                        v = v - u * sum(u * v)
                    v = v[order]
                    for c in range(d):
                        v[c + 1 :] = v[c + 1 :] - lu[c + 1 :, c] * v[c]
                    for c in range(d - 1, -1, -1):
                        v[c] = (v[c] - sum(lu[c, c + 1 :] * v[c + 1 :])) / lu[c, c]
                    for u in space:
                        v = v - u * sum(u * v)
                    v = v / sum(v * v).sqrt()
                space.append(v)
                values.append(root)
                found.append(v * (1 if v[max(range(d), key=lambda x: abs(v[x]))] > 0 else -1))
                if len(found) == k:
                    return values, np.array(found, float)
    return values, np.array(found, float).reshape(-1, d)


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, deviation_exact, whitened, explained, identity_error for each usable row and each of the first components: see the module and op11's contract."""
    spark = rows.sparkSession
    fit = rows.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    kind = dict(fit.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, explained double, identity_error double"
    sizes = fit.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dims = sizes["d"]
    fit = fit.filter(F.size("v") == dims)
    n, sums, square = scatter(fit, dims)
    m = n * square - np.outer(np.array(sums, object), np.array(sums, object))
    trace = sum(int(m[k, k]) for k in range(dims))
    if not trace:
        return spark.createDataFrame([], schema)
    values, vectors = components(m, largest_roots(polynomial(spark, m), most), most)
    explained = np.array([float(v / trace) for v in values])
    scale = np.array([float(v.sqrt() / n) for v in values])  # n^2 e is a root of m
    k = len(values)

    def projected(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n x - S, exact, and the whitened rows."""
        narrow = n * (int(np.abs(y).max(initial=0)) + 1) + max(abs(s) for s in sums) < 1 << 62
        away = n * y - np.array(sums, np.int64) if narrow else n * y.astype(object) - np.array(sums, object)
        return away, (away / n).astype(float) @ vectors.T / scale

    def second_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            w = projected(whole(b.column(0), dims))[1]
            total += w.T @ w
            first += w.sum(0)
        both = np.r_[total.ravel(), first]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both))), pa.array(both)], names=["at", "s"])

    sums_w = fit.select("v").mapInArrow(second_moments, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()  # k (k + 1) rows
    at = {r["at"]: r["s"] / n for r in sums_w}
    mean = np.array([at[k * k + i] for i in range(k)])
    covariance = np.array([at[i] for i in range(k * k)]).reshape(k, k) - np.outer(mean, mean)
    error = float(np.abs(covariance - np.eye(k)).max())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            away, w = projected(whole(b.column(1), dims))
            if away.dtype != object and dims * int(np.abs(away).max(initial=0)) ** 2 < 1 << 63:
                deviation = (away * away).sum(1).tolist()
            else:
                deviation = [sum(x * x for x in row) for row in away.astype(object).tolist()]
            rows = len(w)
            each = np.repeat(np.arange(rows), k)
            exact = pa.array([Decimal(x) if x < 10**38 else None for x in deviation], pa.decimal128(38, 0)).take(pa.array(each))
            short = pa.array([x if x < 1 << 63 else None for x in deviation], pa.int64()).take(pa.array(each))
            columns = [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n)), short, exact, pa.array(w.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "deviation_exact", "whitened", "explained", "identity_error"])

    return fit.mapInArrow(emit, schema)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings on the first eight components of all. Edge cases: see the module."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
