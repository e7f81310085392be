"""Evaluation metrics as aggregations over (target, prediction) rows, optionally per key (fold, seed, member).

Everything is a partial aggregation. AUC first counts rows per distinct score and runs one sliced cumulative sum
over the scores, so neither ties nor a single hot key end in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import METRICS
from . import prefix

EPS = 2.220446049250313e-16


def _agg(expr: Callable[[Column, Column], Column]):
    def run(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
        return df.groupBy(*keys).agg(expr(F.col(y), F.col(p)).alias("score"))

    return run


logloss = _agg(lambda y, p: -F.avg(
    F.when(y == 1, F.log(F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS)))).otherwise(F.log(F.lit(1.0) - F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))))
))
accuracy = _agg(lambda y, p: F.avg((y == p).cast("double")))
rmse = _agg(lambda y, p: F.sqrt(F.avg((y - p) * (y - p))))
mae = _agg(lambda y, p: F.avg(F.abs(y - p)))
rmsle = _agg(lambda y, p: F.sqrt(F.avg(F.pow(F.log1p(F.greatest(p, F.lit(0.0))) - F.log1p(y), 2))))
f1 = _agg(lambda y, p: F.coalesce(F.try_divide(
    2 * F.count_if((y == 1) & (p == 1)), 2 * F.count_if((y == 1) & (p == 1)) + F.count_if((y == 1) != (p == 1))
), F.lit(0.0)))


def auc(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; equal scores share their rank."""
    positive = F.col(y) == 1
    counted = df.groupBy(*keys, F.col(p).cast("double").alias("_p")).agg(F.count_if(positive).alias("_pos"), F.count_if(~positive).alias("_neg"))
    by = list(keys)
    if not by:
        counted, by = counted.withColumn("_all", F.lit(1)), ["_all"]
    cum = prefix.running(prefix.with_slice(counted, by, F.col("_p")), by, [F.col("_p")], {"_upto": ("sum", F.col("_neg"))})
    pairs = F.sum(F.col("_pos") * (F.col("_upto") - F.col("_neg") / 2))
    out = cum.groupBy(*by).agg(F.try_divide(pairs, F.sum("_pos").cast("double") * F.sum("_neg")).alias("score"))
    return out.select(*keys, "score")


def balanced_accuracy(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean recall over the classes that occur in the target."""
    recall = df.groupBy(*keys, F.col(y).alias("_y")).agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("_r"))
    return recall.groupBy(*keys).agg(F.avg("_r").alias("score"))


def qwk(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Quadratic weighted kappa over class positions (classes of target and prediction in sorted order).

    Observed and expected disagreement follow from sums of positions, squares and squared differences; the
    confusion counts per (key, target, prediction) are the only thing the positions are joined to.
    """
    by = list(keys)
    base = df
    if not by:
        base, by = df.withColumn("_all", F.lit(1)), ["_all"]
    cells = base.groupBy(*by, F.col(y).alias("_y"), F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    classes = cells.select(*by, F.col("_y").alias("_c")).unionByName(cells.select(*by, F.col("_p").alias("_c"))).distinct()
    sliced = prefix.with_slice(classes, by, F.lit(0) if dict(classes.dtypes)["_c"] == "string" else F.col("_c"))
    place = prefix.running(sliced, by, [F.col("_c")], {"_i": ("count", F.lit(1))})
    rows = cells.join(place.select(*by, F.col("_c").alias("_y"), F.col("_i")), [*by, "_y"]).join(place.select(*by, F.col("_c").alias("_p"), F.col("_i").alias("_j")), [*by, "_p"])
    n, i, j = F.col("_n"), F.col("_i"), F.col("_j")
    sums = rows.groupBy(*by).agg(
        F.sum(n).alias("_t"), F.sum(n * (i - j) * (i - j)).alias("_o"), F.sum(n * i).alias("_si"), F.sum(n * j).alias("_sj"),
        F.sum(n * i * i).alias("_ii"), F.sum(n * j * j).alias("_jj"),
    )
    expected = F.col("_ii") + F.col("_jj") - 2 * F.col("_si").cast("double") * F.col("_sj") / F.col("_t")
    return sums.select(*keys, (F.lit(1.0) - F.try_divide(F.col("_o").cast("double"), expected)).alias("score"))


@dataclass(frozen=True)
class Metric:
    name: str
    fn: Callable[..., DataFrame]
    sign: int
    metric_class: str

    def __call__(self, df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
        return self.fn(df, y, p, keys)


_FUNCTIONS = {
    "auc": auc, "roc_auc": auc, "logloss": logloss, "accuracy": accuracy, "f1": f1, "qwk": qwk,
    "balanced_accuracy": balanced_accuracy, "rmse": rmse, "mae": mae, "rmsle": rmsle,
}
_REGISTRY = {name: Metric(name, _FUNCTIONS[name], sign, cls) for name, (sign, cls) in METRICS.items()}


def get_metric(name: str) -> Metric:
    """The metric of that name in any case; unknown names fail."""
    if name.lower() not in _REGISTRY:
        raise ValueError(f"Unknown metric {name!r}. Registered: {sorted(_REGISTRY)}")
    return _REGISTRY[name.lower()]


def register_metric(name: str, expr: Callable[[Column, Column], Column], sign: int, metric_class: str) -> Metric:
    """Add a metric given as an aggregate expression of (target, prediction)."""
    _REGISTRY[name.lower()] = Metric(name.lower(), _agg(expr), sign, metric_class)
    return _REGISTRY[name.lower()]


def mean_baseline(df: DataFrame, target: str, metric: str, fold: str = "fold") -> DataFrame:
    """Score per fold of predicting the mean of all other rows; sums per fold give every training mean."""
    sums = df.groupBy(fold).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    total = sums.agg(F.struct(F.sum("_s").alias("s"), F.sum("_n").alias("n"))).scalar()
    means = sums.filter(F.col(fold) >= 0).select(fold, ((total.getField("s") - F.col("_s")) / (total.getField("n") - F.col("_n"))).alias("_mean"))
    # a row per fold: without the hint the rows would be shuffled by fold, a fold to a task
    return get_metric(metric)(df.join(F.broadcast(means), fold), target, "_mean", [fold])
