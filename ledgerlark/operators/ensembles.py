"""Combining predictions in long form: one row per (row_id, member) with prediction and weight.

A row has one prediction per member, so every group is as small as the number of members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def _complete(preds: DataFrame, members: int | None):
    """Every row must have all members; a missing prediction stops the job."""
    if members is None:
        return F.lit(True)
    message = F.lit("members predict different rows")
    return F.when(F.col("_members") != members, F.raise_error(message).cast("boolean")).otherwise(True)


def ensemble_average(preds: DataFrame, members: int | None = None) -> DataFrame:
    """Weighted mean of the member predictions; labels that are text are voted on instead."""
    if isinstance(preds.schema["pred"].dataType, T.StringType):
        return ensemble_vote(preds, members)
    out = preds.groupBy("row_id").agg(
        (F.sum(F.col("weight") * F.col("pred")) / F.sum("weight")).alias("pred"), F.count(F.lit(1)).alias("_members")
    )
    return out.filter(_complete(out, members)).drop("_members")


def ensemble_vote(preds: DataFrame, members: int | None = None) -> DataFrame:
    """Weighted majority; on equal weight the label an earlier member gave."""
    votes = preds.groupBy("row_id", "pred").agg(F.sum("weight").alias("_w"), F.min("member").alias("_first"), F.count(F.lit(1)).alias("_k"))
    out = votes.groupBy("row_id").agg(F.min_by("pred", F.struct(-F.col("_w"), F.col("_first"))).alias("pred"), F.sum("_k").alias("_members"))
    return out.filter(_complete(out, members)).drop("_members")


def bag_mean(preds: DataFrame) -> DataFrame:
    return preds.groupBy("row_id").agg(F.avg("pred").alias("pred"))


def bag_vote(preds: DataFrame) -> DataFrame:
    """Majority over seeds; on a tie the smallest label."""
    votes = preds.groupBy("row_id", "pred").agg(F.count(F.lit(1)).alias("_n"))
    return votes.groupBy("row_id").agg(F.min_by("pred", F.struct(-F.col("_n"), F.col("pred"))).alias("pred"))


def bag_spread(preds: DataFrame) -> DataFrame:
    """Mean over rows of the deviation between seeds."""
    return preds.groupBy("row_id").agg(F.stddev_pop("pred").alias("_s")).agg(F.avg("_s").alias("spread"))


def class_multipliers(proba: DataFrame, classes: list, rounds: int = 3, steps: int = 41, span: float = 2.0) -> tuple[dict, float]:
    """One multiplier per class that maximises balanced accuracy, searched coordinate by coordinate.

    ``proba`` has the target ``y`` and a map ``p`` of class to probability. For a fixed class a row switches to it
    at one multiplier, so one aggregation per coordinate counts the rows per (target, other class, first winning
    step); at most steps x classes^2 counts come back to decide among all steps.
    """
    import math

    values = [math.exp(-span + 2 * span * i / (steps - 1)) for i in range(steps)]
    weight = {c: 1.0 for c in classes}
    proba = proba.withColumn("_row", F.struct(*[F.col("p").getItem(c).alias(str(i)) for i, c in enumerate(classes)]))

    def counts(c_index: int) -> list:
        others = [i for i in range(len(classes)) if i != c_index]
        scored = [F.struct((F.col(f"_row.`{i}`") * weight[classes[i]]).alias("s"), F.lit(-i).alias("i")) for i in others]
        best = F.greatest(*scored) if len(scored) > 1 else scored[0]
        own = F.col(f"_row.`{c_index}`")
        rows = proba.select("y", own.alias("_own"), best.alias("_best"))
        wins = [(F.col("_own") * v > F.col("_best.s")) | ((F.col("_own") * v == F.col("_best.s")) & (F.lit(c_index) < -F.col("_best.i"))) for v in values]
        first = F.coalesce(*[F.when(w, k) for k, w in enumerate(wins)], F.lit(steps))
        return rows.groupBy("y", (-F.col("_best.i")).alias("other"), first.alias("first")).agg(F.count(F.lit(1)).alias("n")).collect()

    def balanced(cells: list, c_index: int, step_of) -> float:
        total, right = {}, {}
        for cell in cells:
            total[cell["y"]] = total.get(cell["y"], 0) + cell["n"]
            pred = classes[c_index] if step_of(cell["first"]) else classes[cell["other"]]
            if pred == cell["y"]:
                right[cell["y"]] = right.get(cell["y"], 0) + cell["n"]
        return sum(right.get(y, 0) / n for y, n in total.items()) / len(total)

    best_score = None
    for _ in range(rounds):
        for ci, c in enumerate(classes):
            cells = counts(ci)
            if best_score is None:
                middle = (steps - 1) // 2  # exp(0) = 1, the starting multiplier
                best_score = balanced(cells, ci, lambda f: f <= middle)
            for k, v in enumerate(values):
                score = balanced(cells, ci, lambda f, k=k: f <= k)
                if score > best_score:
                    best_score, weight[c] = score, v
    return weight, best_score
