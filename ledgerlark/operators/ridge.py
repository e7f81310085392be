"""Ridge regression of all folds from one scan: cross products per fold, leave-one-out by subtraction.

A task adds up the cross products of its rows per fold; Spark sums them by position. The products of a training part are those of
all folds less its own, so every row is read once whatever the number of folds. Missing values count in columns of their
own, from which the products with imputed means of any training part follow. What reaches the driver is one small matrix per
fold, as in a fit by normal equations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

MOST_FEATURES = 256  # beyond it the matrices of the folds are no longer small; the caller fits fold by fold


@dataclass(frozen=True)
class Line:
    """A fitted ridge: missing values are replaced by ``means``."""

    intercept: float
    weights: np.ndarray
    means: np.ndarray


@dataclass(frozen=True)
class Moments:
    """Cross products of (1, target, features, missing flags) per fold, values taken relative to ``shift``."""

    products: dict[int, np.ndarray]
    shift: np.ndarray
    null_targets: int

    def without(self, fold: int | None) -> np.ndarray:
        return sum(g for f, g in self.products.items() if f != fold)


def fold_moments(rows: DataFrame, names: Sequence[str], target: str) -> Moments:
    """Moments of a frame with ``fold``, numeric features and a numeric target. Features without a value are null or NaN.

    Values are taken relative to those of one row, which keeps the products small; the result does not depend on the row.
    """
    p = len(names)
    numbers = rows.select(F.col("fold").cast("int").alias("fold"), F.col(target).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    one = numbers.drop("fold").first()
    shift = np.nan_to_num(np.array([np.nan if v is None else v for v in one] if one else [0.0] * (p + 1), dtype="float64"))
    size = 2 * p + 2

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        nulls = 0
        for batch in batches:
            nulls += int(batch["_y"].isna().sum())
            for fold, part in batch.groupby("fold"):
                values = part.drop(columns="fold").to_numpy(dtype="float64") - shift
                missing = np.isnan(values[:, 1:])
                z = np.hstack([np.ones((len(values), 1)), np.nan_to_num(values), missing])
                sums[int(fold)] = sums.get(int(fold), 0.0) + z.T @ z
        for fold, g in sums.items():
            yield pd.DataFrame({"fold": fold, "at": np.arange(size * size), "v": g.ravel()})
        yield pd.DataFrame({"fold": [-2], "at": [0], "v": [float(nulls)]})  # folds start at -1

    # one value per task and position, added in order of size, so that a repeated run gives the same sum to the last digit
    ordered = F.aggregate(F.array_sort(F.collect_list("v")), F.lit(0.0), lambda a, v: a + v)
    got = numbers.mapInPandas(add, "fold int, at int, v double").groupBy("fold", "at").agg(ordered.alias("v")).toPandas()
    products, nulls = {}, 0
    for fold, part in got.groupby("fold"):
        if fold == -2:
            nulls = int(part["v"].sum())
            continue
        g = np.zeros(size * size)
        g[part["at"].to_numpy()] = part["v"].to_numpy()
        products[int(fold)] = g.reshape(size, size)
    return Moments(products, shift, nulls)


def solve(products: np.ndarray, shift: np.ndarray, penalty: float) -> Line | None:
    """The ridge of summed cross products: features scaled to unit deviation, the penalty relative to the target's deviation.

    None if there is no row or a feature has no value at all. Constant features have weight zero.
    """
    p = len(shift) - 1
    n = products[0, 0]
    present = n - products[0, 2 + p:]
    if n <= 0 or (present <= 0).any():
        return None
    fill = products[0, 2:2 + p] / present
    impute = np.zeros((2 * p + 2, p + 2))
    impute[np.arange(p + 2), np.arange(p + 2)] = 1.0
    impute[2 + p + np.arange(p), 2 + np.arange(p)] = fill
    g = impute.T @ products @ impute / n
    mean = g[0, 1:]
    cov = g[1:, 1:] - np.outer(mean, mean)
    var = np.diag(cov)
    spread = np.sqrt(np.where(var > 1e-14 * np.maximum(np.diag(g)[1:], 1e-300), var, 0.0))
    weights = np.zeros(p)
    use = np.flatnonzero(spread[1:] > 0)
    if spread[0] > 0 and len(use):
        scale = spread[1:][use]
        left = cov[1:, 1:][np.ix_(use, use)] / np.outer(scale, scale) + np.eye(len(use)) * penalty / spread[0]
        weights[use] = np.linalg.solve(left, cov[0, 1:][use] / (scale * spread[0])) * spread[0] / scale
    means = fill + shift[1:]
    return Line(float(mean[0] + shift[0] - weights @ (mean[1:] + shift[1:])), weights, means)


def predicted(names: Sequence[str], lines: dict[int, Line]) -> Column:
    """The prediction of a row by the line of its fold, as one column expression."""
    folds = sorted(lines)
    place = F.array_position(F.lit(folds), F.col("fold").cast("int")).cast("int") - 1
    values = F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in names])
    table = lambda rows: F.get(F.array(*[F.lit([float(v) for v in row]) for row in rows]), place)
    filled = F.zip_with(values, table([lines[f].means for f in folds]), lambda x, m: F.coalesce(x, m))
    terms = F.zip_with(filled, table([lines[f].weights for f in folds]), lambda x, w: x * w)
    start = F.get(F.lit([lines[f].intercept for f in folds]), place)
    return F.aggregate(terms, start, lambda a, x: a + x)


def fold_lines(rows: DataFrame, names: Sequence[str], target: str, penalty: float) -> dict[int, Line] | None:
    """The line of every fold from 0 on, fitted on all other rows (fold -1 always among them). None where a closed form does not
    apply: too many features, targets without a value, or a feature that some training part never has."""
    if not names or len(names) > MOST_FEATURES:
        return None
    moments = fold_moments(rows, names, target)
    if moments.null_targets:
        return None
    lines = {f: solve(moments.without(f), moments.shift, penalty) for f in moments.products if f >= 0 and len(moments.products) > 1}
    return lines if lines and None not in lines.values() else None
