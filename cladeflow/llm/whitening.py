"""Embedding whitening by spectrum slicing: leading eigenvalues are isolated by counting signs, then refined to full precision.

Every component c of a vector becomes the whole number floor(256 c). Distinct whole-number vectors are the fit list. Spark
sums its components and, after they are centred, their products, in whole numbers: the covariance is exact before it is
rounded once, on any cluster and in any order. Only d x d numbers, as wide as the vectors, reach the driver. There an LDLᵀ
factorisation of the covariance less a shift counts the eigenvalues above it; bisection with such counts isolates each
leading eigenvalue, Rayleigh quotient iteration converges on it, and two more counts certify its number.

Null vectors, and those with null or non-finite entries, are left out. Vectors of different lengths are read as filled up
with zeros; one without entries is all zeros. Components beyond the width of the vectors do not exist; the values on one
whose eigenvalue is zero to rounding are null, and it counts in no identity error. A deviation beyond a long is null. Repeated
rows are answered each, ties of eigenvalues give some basis of their space, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cladeflow.session import settle

SCALE, COMPONENTS = 256, 4
#: Whole numbers below this are summed exactly in double precision; limbs of whole numbers in sums have so many bits.
EXACT, LIMB = 1 << 53, 60
#: Vectors that a task multiplies at once.
ROWS = 4096


def usable(vec: Column) -> Column:
    """Whether a vector is there and holds finite entries only."""
    return vec.isNotNull() & ~F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))


def whole_numbers(vec: Column) -> Column:
    return F.transform(vec.cast("array<double>"), lambda c: F.floor(c * SCALE))


# -- whole-number sums over the cluster ----------------------------------------------------------------------------------


def _matrices(batches: Iterator[pa.RecordBatch], at: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with at most `ROWS` vectors and their whole numbers as a matrix, shorter vectors filled up with zeros."""
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            column = batch.column(at)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            if (lengths == width).all():
                yield batch, flat.reshape(len(column), width)
                continue
            x = np.zeros((len(column), width), dtype=np.int64)
            x[np.arange(width) < lengths[:, None]] = flat
            yield batch, x


def _exactly(x: np.ndarray, shift: list[int]) -> np.ndarray:
    """`x` less a shift as whole numbers, in 64 bits or, where these may not do, as Python's."""
    if all(abs(s) < 1 << 61 for s in shift) and (not x.size or (np.abs(x.astype(float)) < 2.0**61).all()):
        return x - np.array(shift, dtype=np.int64)
    return x.astype(object) - np.array(shift, dtype=object)


def _column_sums(z: np.ndarray) -> np.ndarray:
    fits = z.dtype != object and np.abs(z.astype(float)).max(initial=0.0) * len(z) < 2.0**62
    return (z if fits else z.astype(object)).sum(axis=0).astype(object)


def _products(z: np.ndarray) -> np.ndarray:
    """zᵀz, exact: by the fast product of doubles in pieces of rows whose sums stay below 2^53, else by Python's whole numbers."""
    most = int(np.abs(z).max()) if z.size else 0
    if most * most >= EXACT:
        z = z.astype(object)
        return z.T @ z
    rows = max(1, min(len(z), EXACT // max(1, most * most)))
    total = np.zeros((z.shape[1], z.shape[1]), dtype=object)
    for start in range(0, len(z), rows):
        part = z[start : start + rows].astype(float)
        total = total + (part.T @ part).astype(np.int64)
    return total


def _sum_over_tasks(fit: DataFrame, width: int, shift: list[int], products: bool) -> list[int]:
    """Sums of the components, or of the products of components, less a shift; tasks add up first, the cluster adds the tasks."""
    size = width * width if products else width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=object)
        for _, x in _matrices(batches, 0, width):
            z = _exactly(x, shift)
            total = total + (_products(z).ravel() if products else _column_sums(z))
        high = [int(v) >> LIMB for v in total]
        low = [int(v) & ((1 << LIMB) - 1) for v in total]
        kind = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(high, kind), pa.array(low, kind)], names=["i", "high", "low"])

    parts = fit.select("x").mapInArrow(run, "i int, high decimal(38,0), low decimal(38,0)")
    rows = parts.groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    found = [0] * size
    for r in rows:
        found[r["i"]] = (int(r["high"]) << LIMB) + int(r["low"])
    return found


# -- spectrum slicing on the driver --------------------------------------------------------------------------------------


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are above a shift: the positive pivots of LDLᵀ of the matrix less the shift.

    Rows and columns are exchanged so that the greatest entry left is the pivot; where it stands off the diagonal, a block of
    two by two is, with one positive and one negative eigenvalue.
    """
    a = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(a):
        n = len(a)
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        off = np.abs(np.triu(a, 1))
        i, j = divmod(int(off.argmax()), n)
        # Fixed value: the ratio that bounds the growth of entries in factorisations with blocks.
        if diagonal[p] >= 0.6404 * off[i, j]:
            if diagonal[p] == 0:
                return positive
            rest = np.delete(np.arange(n), p)
            positive += a[p, p] > 0
            column = a[rest, p]
            a = a[np.ix_(rest, rest)] - np.outer(column, column / a[p, p])
        else:
            block, rest = [i, j], np.delete(np.arange(n), [i, j])
            positive += 1
            side = a[np.ix_(rest, block)]
            a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(block, block)], side.T)
        a = (a + a.T) / 2
    return positive


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            v = v - (b @ v) * b
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def _solve(matrix: np.ndarray, shift: float, v: np.ndarray, tiny: float) -> np.ndarray:
    for nudge in (0.0, tiny, 4 * tiny):
        try:
            found = np.linalg.solve(matrix - (shift + nudge) * np.eye(len(matrix)), v)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(found).all():
            return found
    return v


def leading_pairs(matrix: np.ndarray, count: int) -> list[tuple[float, np.ndarray]]:
    """The greatest `count` eigenvalues of a symmetric matrix in falling order, with unit eigenvectors.

    Eigenvalues closer than rounding cannot be told apart by counts; they get orthogonal vectors of their common space.
    """
    d = len(matrix)
    count = min(count, d)
    scale = float(np.abs(matrix).sum(axis=1).max()) if d else 0.0
    tiny = 8 * d * np.finfo(float).eps * scale
    if not scale:
        return [(0.0, np.eye(d)[k]) for k in range(count)]
    found: list[tuple[float, np.ndarray]] = []
    rng = np.random.default_rng(1)

    def apart(k: int, low: float, high: float) -> bool:
        """Whether no other eigenvalue is within four widths of the interval, so that iteration from inside stays there."""
        margin = 4 * (high - low)
        return count_above(matrix, low - margin) == k and count_above(matrix, high + margin) == k - 1

    for k in range(1, count + 1):
        low, high = -scale - tiny, scale + tiny  # k or more eigenvalues are above `low`, fewer than k above `high`
        above_low, above_high = d, 0
        while high - low > tiny and not (above_low == k and above_high == k - 1 and apart(k, low, high)):
            middle = (low + high) / 2
            above = count_above(matrix, middle)
            if above >= k:
                low, above_low = middle, above
            else:
                high, above_high = middle, above
        alone = above_low == k and above_high == k - 1
        near = [v for value, v in found if low - tiny <= value <= high + tiny]
        start = _orthogonal(rng.standard_normal(d), near)
        value = (low + high) / 2
        v = start
        # Inverse iteration to the middle of the interval until the quotient lies inside, then the quotient is the shift.
        for _ in range(60):
            v = _orthogonal(_solve(matrix, value, v, tiny), near)
            quotient = float(v @ matrix @ v)
            inside = low - tiny <= quotient <= high + tiny
            residual = np.linalg.norm(matrix @ v - quotient * v)
            value = quotient if inside else (low + high) / 2
            if inside and residual <= tiny:
                break
        # One more step takes what is left of other vectors out.
        better = _orthogonal(_solve(matrix, value, v, tiny), near)
        if np.linalg.norm(matrix @ better - (better @ matrix @ better) * better) <= np.linalg.norm(matrix @ v - value * v):
            v, value = better, float(better @ matrix @ better)
        if alone and (count_above(matrix, value + 4 * tiny) >= k or count_above(matrix, value - 4 * tiny) < k):
            raise ArithmeticError(f"the counts do not certify eigenvalue {k}: {value}")
        v = v * np.sign(v[np.abs(v).argmax()])
        found.append((value, v))
    return found


# -- the operator --------------------------------------------------------------------------------------------------------


@dataclass
class Whitening:
    """The fit: number of distinct vectors, their sums, eigenvalues and unit eigenvectors, trace, and the identity error."""

    n: int
    sums: list[int]
    values: list[float]
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def width(self) -> int:
        return len(self.sums)

    def factors(self) -> np.ndarray:
        """Divisors by component: the root of its eigenvalue, NaN where that is zero to rounding."""
        least = 8 * max(1, self.width) * np.finfo(float).eps * max(self.trace, 0.0)
        return np.array([np.sqrt(e) if e > least else np.nan for e in self.values])

    def project(self, x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """The deviations and whitened values of whole-number vectors."""
        small = all(abs(s) < 1 << 61 for s in self.sums) and np.abs(x.astype(float)).max(initial=0.0) * self.n < 2.0**61
        spread = (self.n * x if small else self.n * x.astype(object)) - np.array(self.sums, dtype=np.int64 if small else object)
        fits = small and np.abs(spread.astype(float)).max(initial=0.0) ** 2 * self.width < 2.0**62
        squares = (spread * spread if fits else spread.astype(object) ** 2).sum(axis=1)
        deviation = [int(s) if int(s) < 1 << 63 else None for s in squares.tolist()]
        centred = (spread / self.n).astype(float)
        return deviation, centred @ self.vectors.T / self.factors()


def fit(df: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> tuple[Whitening, DataFrame] | None:
    """The whitening of a table's distinct vectors, and these as a settled table `x`; None where the table holds no vector."""
    given = df.where(usable(F.col(vec_col))).select(whole_numbers(F.col(vec_col)).alias("x"))
    distinct = settle(given.distinct(), "vectors")
    shape = distinct.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    n, width = shape["n"], shape["most"] or 0
    if shape["least"] != shape["most"]:
        filled = F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("x")))
        distinct = settle(distinct.select(filled.alias("x")).distinct(), "vectors")
        n = distinct.count()
    if not n:
        return None
    sums = _sum_over_tasks(distinct, width, [0] * width, products=False)
    # Centred at the whole number next to the mean; what is left of the mean is taken off exactly.
    shift = [(2 * s + n) // (2 * n) for s in sums]
    left = [s - n * m for s, m in zip(sums, shift)]
    products = _sum_over_tasks(distinct, width, shift, products=True)
    exact = [[n * products[i * width + j] - left[i] * left[j] for j in range(width)] for i in range(width)]
    covariance = np.array([[v / (n * n) for v in row] for row in exact]).reshape(width, width)
    trace = sum(exact[i][i] for i in range(width)) / (n * n)
    pairs = leading_pairs(covariance, components)
    vectors = np.array([v for _, v in pairs]).reshape(len(pairs), width)
    model = Whitening(n, sums, [e for e, _ in pairs], vectors, trace)
    model.identity_error = _identity_error(distinct, model)
    return model, distinct


def _identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """The largest entry of the covariance of whitened values less the identity, over components that have variance.

    Each part of the rows is centred at its own mean before it is multiplied; the means are brought together afterwards.
    """
    used = np.flatnonzero(~np.isnan(model.factors()))
    k = len(used)
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, products = 0, np.zeros(k), np.zeros((k, k))
        for _, x in _matrices(batches, 0, model.width):
            w = model.project(x)[1][:, used]
            own = w.mean(axis=0)
            part, apart = w - own, own - mean
            products += part.T @ part + np.outer(apart, apart) * (n * len(w) / (n + len(w)))
            mean, n = mean + apart * (len(w) / (n + len(w))), n + len(w)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "mean": [mean.tolist()], "products": [products.ravel().tolist()]})

    parts = distinct.select("x").mapInArrow(run, "n long, mean array<double>, products array<double>")
    # The means of the parts lie near zero, since whitening centres: their own spread is added around it.
    sums = [F.sum(F.col("products")[i * k + j] + F.col("n") * F.col("mean")[i] * F.col("mean")[j]) for i in range(k) for j in range(k)]
    means = [F.sum(F.col("n") * F.col("mean")[i]) for i in range(k)]
    row = list(parts.agg(*sums, *means).first())
    mean = np.array(row[k * k :]) / model.n
    covariance = np.array(row[: k * k]).reshape(k, k) / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(df: DataFrame, model: Whitening, key_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """`<key>, component, n, deviation, whitened, explained, identity_error`: one row for every usable vector and component."""
    rows = df.where(usable(F.col(vec_col))).select(F.col(key_col).alias("key"), whole_numbers(F.col(vec_col)).alias("x"))
    count = len(model.values)
    fields = [T.StructField("key", df.schema[key_col].dataType), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches, 1, model.width):
            deviation, whitened = model.project(x)
            values = pa.array(whitened.ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * count, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), lists], names=["key", "deviation", "whitened"])

    found = rows.mapInArrow(run, T.StructType(fields)).select("key", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(e / model.trace if model.trace > 0 else None).cast("double") for e in model.values])
    return found.select(
        F.col("key").alias(key_col),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


def whitened_vectors(df: DataFrame, key_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fit on the table's distinct vectors and whiten all of its rows."""
    fitted = fit(df, vec_col, components)
    # Without a vector there is nothing to fit and no row to return.
    model = fitted[0] if fitted else Whitening(1, [0], [0.0], np.ones((1, 1)), 0.0)
    return whiten(df, model, key_col, vec_col)
