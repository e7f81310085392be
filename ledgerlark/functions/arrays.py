"""Column functions over arrays of numbers and vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def _squares(a: Column) -> Column:
    """Sum of squared deviations from the mean."""
    return let(mean(a), lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x.cast("double") - m) * (x.cast("double") - m)))


def variance(a: Column) -> Column:
    """Population variance."""
    return F.when(F.size(a) > 0, _squares(a) / F.size(a))


def std_pop(a: Column) -> Column:
    return F.sqrt(variance(a))


def std_sample(a: Column) -> Column:
    return F.when(F.size(a) > 1, F.sqrt(_squares(a) / (F.size(a) - 1)))


def standard_error(a: Column) -> Column:
    """Sample deviation over sqrt(n); 0 for fewer than two values or none at all."""
    return F.coalesce(F.when(F.size(a) > 1, std_sample(a) / F.sqrt(F.size(a))), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def fit_dim(a: Column, n: int) -> Column:
    """Cut a vector to ``n`` numbers and scale it to length 1; vectors of that size stay as they are."""
    cut = F.slice(a, 1, n)
    length = norm(cut)
    scaled = F.when(length > 1e-9, F.transform(cut, lambda x: (x / length).cast("float"))).otherwise(cut)
    return F.when(F.size(a) == n, a).otherwise(scaled)
