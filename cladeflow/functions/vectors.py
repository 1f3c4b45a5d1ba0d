"""Column functions on `array<double>` vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def total(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def bind(value: Column, body) -> Column:
    """Evaluate `value` once and use it many times inside `body`."""
    return F.transform(F.array(value), body).getItem(0)


def softmax(vec: Column) -> Column:
    """Shifted by the maximum, so that large logits do not overflow."""
    weights = bind(F.array_max(vec), lambda top: F.transform(vec, lambda x: F.exp(x - top)))
    return bind(weights, lambda w: bind(total(w), lambda s: F.transform(w, lambda e: e / s)))


def argmax(vec: Column) -> Column:
    """Index of the greatest element, the first one on ties."""
    return (F.array_position(vec, F.array_max(vec)) - 1).cast("int")


def top_k(vec: Column, k: int) -> Column:
    """The k greatest elements in descending order; shorter when there are fewer."""
    return F.slice(F.sort_array(vec, asc=False), 1, k)


def l2_normalize(vec: Column) -> Column:
    scaled = lambda norm: F.when(norm > 0, F.transform(vec, lambda x: x / norm)).otherwise(vec)
    return bind(F.sqrt(dot(vec, vec)), scaled)


def similarity(distance: Column, factor: float = 1.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance / F.lit(factor))


def low_dim_probability(distance: Column, a: float, b: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.lit(a) * F.pow(distance, F.lit(2.0 * b)))


def hyperbolic_distance(a: Column, b: Column, tol: float = 1e-6) -> Column:
    """Distance on the hyperboloid; within `tol` of one the argument counts as the same point."""
    arg = F.sqrt(1 + dot(a, a)) * F.sqrt(1 + dot(b, b)) - dot(a, b)
    return bind(arg, lambda x: F.when(x < 1 + tol, F.lit(0.0)).otherwise(F.acosh(x)))
