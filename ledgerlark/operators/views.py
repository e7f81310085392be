"""Derived views over the ledger: progressions, lesson impact, bandit belief, calibration, error recurrence.

Comparisons of scores go through the competition's ``metric_sign``. The competition table joins without a hint:
Spark broadcasts it while it is below its size limit and splits a skewed sort-merge join beyond.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..constants import BANDIT_DECAY, DUPLICATE_COSINE, LB_DEADBAND, OUTCOME_WORTH
from ..functions import arrays, rules
from . import prefix


def _share(a: Column, b: Column, digits: int = 4) -> Column:
    return rules.round_half(F.try_divide(a, b), digits)


# --- attempts with their competition -------------------------------------------------------------------------------


def stg_attempts(attempts: DataFrame, competitions: DataFrame) -> DataFrame:
    return attempts.join(competitions.select("competition_id", "metric_sign"), "competition_id")


def stg_attempts_reflexion(attempts: DataFrame, competitions: DataFrame) -> DataFrame:
    return stg_attempts(attempts.filter("stage = 'reflexion'"), competitions)


def _with_running_best(staged: DataFrame) -> DataFrame:
    sliced = prefix.with_slice(staged, ["competition_id"], prefix.time_position("run_ts"))
    out = prefix.running(
        sliced, ["competition_id"], [F.col("run_ts"), F.col("attempt_id")],
        {"attempt_no": ("count", F.lit(1)), "_best": ("max", F.col("metric_sign") * F.col("cv_score"))},
    )
    return out.withColumn("best_so_far", F.col("_best") * F.col("metric_sign")).drop("_best")


def score_progression(attempts: DataFrame, competitions: DataFrame) -> DataFrame:
    """Number and signed running best of every attempt of a competition, in time order."""
    cols = ["attempt_id", "competition_id", "run_ts", "stage", "action_type", "cv_score", "lb_score", "label", "gain_vs_best"]
    staged = stg_attempts(attempts.select(*cols), competitions)
    return _with_running_best(staged).select(*cols[:2], "attempt_no", *cols[2:], "best_so_far")


def cold_start_progression(attempts: DataFrame, competitions: DataFrame) -> DataFrame:
    """The same over scored attempts only."""
    cols = ["competition_id", "attempt_id", "run_ts", "stage", "cv_score"]
    staged = stg_attempts(attempts.filter("cv_score IS NOT NULL").select(*cols), competitions)
    return _with_running_best(staged).select("competition_id", "attempt_id", "attempt_no", "run_ts", "stage", "cv_score", "best_so_far")


def holdout_cv_gap_trend(attempts: DataFrame, competitions: DataFrame) -> DataFrame:
    staged = stg_attempts(attempts.filter("holdout_score IS NOT NULL"), competitions)
    gap = F.col("metric_sign") * (F.col("cv_score") - F.col("holdout_score"))
    return staged.select("attempt_id", "competition_id", "run_ts", "cv_score", "holdout_score", gap.alias("overfit_gap"))


# --- lessons --------------------------------------------------------------------------------------------------------


def reflection_impact(attempts: DataFrame) -> DataFrame:
    """Relative gain of the attempts that cite a lesson, split evenly over the lessons of each attempt."""
    scored = attempts.filter(
        (F.col("stage") == "reflexion") & rules.is_not_false(F.col("was_promoted"))
        & F.col("gain_vs_best_relative").isNotNull() & F.col("reflection_ids").isNotNull()
    )
    share = F.col("gain_vs_best_relative") / F.size("reflection_ids")
    cited = scored.select(F.explode("reflection_ids").alias("reflection_id"), share.alias("gain"))
    return cited.groupBy("reflection_id").agg(
        F.count(F.lit(1)).alias("times_applied"),
        rules.round_half(F.avg("gain"), 5).alias("avg_gain"),
        F.count_if(F.col("gain") > 0).alias("jumps"),
        rules.round_half(F.max("gain"), 5).alias("best_jump"),
    )


def with_impact(lessons: DataFrame, impact: DataFrame) -> DataFrame:
    """Lessons with their impact; 0 where none was measured."""
    return lessons.join(impact, "reflection_id", "left").fillna(
        {"times_applied": 0, "avg_gain": 0.0, "jumps": 0, "best_jump": 0.0}
    )


def lesson_funnel(lessons: DataFrame, attempts: DataFrame) -> DataFrame:
    """Where lessons are lost on the way from written over retrieved and cited to a gain."""
    written = lessons.filter("NOT archived").groupBy("competition_id").agg(F.count(F.lit(1)).alias("written"))
    retrieved, cited = F.size("retrieved_ids") > 0, F.size("reflection_ids") > 0
    stats = attempts.filter("stage = 'reflexion'").groupBy("competition_id").agg(
        F.count(F.lit(1)).alias("total_attempts"),
        F.count_if(F.col("retrieved_ids").isNotNull() & retrieved).alias("retrieved"),
        F.count_if(F.col("reflection_ids").isNotNull() & cited).alias("cited"),
        F.count_if(F.col("reflection_ids").isNotNull() & cited & (F.col("gain_vs_best_relative") > 0)).alias("positive_gain"),
        F.bool_or(F.col("retrieved_ids").isNotNull()).alias("retrieved_precise"),
    )
    counts = ["written", "total_attempts", "retrieved", "cited", "positive_gain"]
    joined = written.join(stats, "competition_id", "full_outer")
    return joined.select(
        "competition_id",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        _share(F.col("retrieved"), F.col("total_attempts")).alias("retrieve_rate"),
        _share(F.col("cited"), F.col("total_attempts")).alias("cite_rate"),
        _share(F.col("positive_gain"), F.col("cited")).alias("gain_rate"),
        F.coalesce("retrieved_precise", F.lit(False)).alias("retrieved_precise"),
    )


def lesson_dead_reason(times: Column, avg_gain: Column) -> Column:
    return F.when(times == 0, "never_cited").when(avg_gain <= 0, "applied_negative")


def lesson_dead(lessons: DataFrame, impact: DataFrame) -> DataFrame:
    """Lessons never cited or without a positive average gain."""
    live = lessons.filter("NOT archived").select("reflection_id", "competition_id", "lesson_type", "generality", "created_at")
    joined = live.join(impact.select("reflection_id", "times_applied", "avg_gain"), "reflection_id", "left")
    times = F.coalesce("times_applied", F.lit(0))
    out = joined.withColumn("times_cited", times).withColumn("reason", lesson_dead_reason(times, F.col("avg_gain")))
    return out.filter("reason IS NOT NULL").drop("times_applied")


def transfer_matrix(attempts: DataFrame, lessons: DataFrame) -> DataFrame:
    """How often attempts of one competition cite lessons of another."""
    cited = attempts.select("competition_id", F.explode("reflection_ids").alias("reflection_id"))
    counted = cited.groupBy("reflection_id", F.col("competition_id").alias("target_comp")).agg(F.count(F.lit(1)).alias("_n"))
    src = lessons.select("reflection_id", F.col("competition_id").alias("source_comp"))
    return counted.join(src, "reflection_id").groupBy("source_comp", "target_comp").agg(F.sum("_n").alias("citations"))


def times_retrieved(lessons: DataFrame, attempts: DataFrame) -> DataFrame:
    """Number of attempts whose retrieved ids hold the lesson."""
    ids = attempts.select(F.explode(F.array_distinct("retrieved_ids")).alias("reflection_id"))
    counts = ids.groupBy("reflection_id").agg(F.count(F.lit(1)).alias("times_retrieved"))
    return lessons.join(counts, "reflection_id", "left").fillna({"times_retrieved": 0})


def lesson_duplicates(
    lessons: DataFrame, threshold: float = DUPLICATE_COSINE, newest: int | None = None
) -> DataFrame:
    """Pairs of live lessons of one competition whose vectors are nearer than the threshold.

    All live lessons are compared. With ``newest`` only that many of each competition are, the newest ones: one matrix
    product per competition, only pairs above the threshold leave the task. Lessons without a vector, or with one whose
    length is not the usual one of their competition, have no pairs.
    """
    if newest is None:
        return lesson_duplicates_all(lessons, threshold)
    live = _with_vectors(lessons, ["reflection_id", "competition_id", "created_at", "embedding"])
    recent = prefix.newest_per_key(live, ["competition_id"], [F.col("created_at").desc(), F.col("reflection_id").desc()], newest)

    cols = recent.select("competition_id", "reflection_id", "embedding")
    return cols.groupBy("competition_id").applyInPandas(_near_pairs(threshold), _pair_schema(lessons))


FEW_BLOCKS = 8  # blocks of a competition: 36 tasks, and a lesson goes to 8 of them
MOST_BLOCK = 2048  # lessons of a block, at most: two blocks and one matrix of their products fit a task


def lesson_duplicates_all(lessons: DataFrame, threshold: float = DUPLICATE_COSINE, block: int = 512) -> DataFrame:
    """The same over all live lessons, however many a competition has.

    Lessons are spread over blocks by a hash of their id; a task compares two blocks (or one with itself), so it
    holds about two blocks of vectors and no competition has to fit anywhere. ``block`` is the least size of a block: a competition
    of many lessons takes larger ones, up to ``MOST_BLOCK``, so that it has at most ``FEW_BLOCKS`` while it can and a lesson goes to few
    tasks. The work grows with the square of a competition's lessons, as any exact comparison does.
    """
    live = _with_vectors(lessons, ["reflection_id", "competition_id", "embedding"])
    sizes = live.groupBy("competition_id").agg(F.count(F.lit(1)).alias("_n"))
    size = F.greatest(F.lit(block), F.least(F.lit(MOST_BLOCK), F.ceil(F.col("_n") / FEW_BLOCKS)))
    sizes = sizes.select("competition_id", F.ceil(F.col("_n") / size).cast("long").alias("_blocks"))
    placed = live.join(sizes, "competition_id").withColumn("_own", F.pmod(F.xxhash64("reflection_id"), F.col("_blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_other")
    meeting = placed.select("competition_id", "reflection_id", "embedding", "_own", other)
    meeting = meeting.withColumns({"_lo": F.least("_own", "_other"), "_hi": F.greatest("_own", "_other")})
    keys = ["competition_id", "_lo", "_hi"]
    return meeting.groupBy(*keys).applyInPandas(_near_pairs(threshold), _pair_schema(lessons))


def _with_vectors(lessons: DataFrame, columns: list[str]) -> DataFrame:
    """Live lessons whose vector has no null and the most frequent length of its competition (the greater of equally frequent)."""
    sound = lessons.filter("NOT archived AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)").select(*columns, F.size("embedding").alias("_dim"))
    counts = sound.groupBy("competition_id", "_dim").agg(F.count(F.lit(1)).alias("_n"))
    usual = counts.groupBy("competition_id").agg(F.max(F.struct("_n", "_dim"))["_dim"].alias("_usual")).filter("_usual > 0")
    return sound.join(usual, "competition_id").filter("_dim = _usual").select(*columns)


def _pair_schema(lessons: DataFrame) -> str:
    kind = dict(lessons.select("competition_id", "reflection_id").dtypes)
    return (
        f"competition_id {kind['competition_id']}, reflection_id_a {kind['reflection_id']}, "
        f"reflection_id_b {kind['reflection_id']}, cos_sim double"
    )


def _near_pairs(threshold: float):
    """Pairs above the threshold within a group of vectors; between two blocks if the group has a block column."""

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(group["embedding"].to_numpy()).astype("float64")
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
        ids = group["reflection_id"].to_numpy()
        left = right = np.arange(len(ids))
        if "_own" in group and group["_lo"].iloc[0] != group["_hi"].iloc[0]:
            own = group["_own"].to_numpy()
            left, right = np.nonzero(own == group["_lo"].iloc[0])[0], np.nonzero(own == group["_hi"].iloc[0])[0]
        sim = vectors[left] @ vectors[right].T
        near = sim > threshold
        if left is right:
            near = np.triu(near, k=1)
        i, j = np.nonzero(near)
        a, b = ids[left[i]], ids[right[j]]
        return pd.DataFrame({
            "competition_id": group["competition_id"].iloc[0], "reflection_id_a": np.minimum(a, b), "reflection_id_b": np.maximum(a, b),
            "cos_sim": sim[i, j],
        })

    return pairs


# --- bandit ---------------------------------------------------------------------------------------------------------


def noop_tie(gain: Column, cv: Column) -> Column:
    return F.coalesce(F.abs(gain) <= rules.noise_tolerance(cv), F.lit(False))


def bandit_replay(attempts: DataFrame) -> DataFrame:
    """Belief per competition and action after all attempts in order, each decaying the earlier evidence."""
    deltas = attempts.select(
        "competition_id", "action_type", "run_ts", "attempt_id",
        rules.bandit_deltas(
            F.col("label"), F.col("gain_vs_best"), F.col("error_trace"), noop_tie(F.col("gain_vs_best"), F.col("cv_score"))
        ).alias("_d"),
    )
    sliced = prefix.with_slice(deltas, ["competition_id", "action_type"], prefix.time_position("run_ts"))
    sums = prefix.later_weighted_sum(
        sliced, ["competition_id", "action_type"], [F.col("run_ts"), F.col("attempt_id")],
        {"_a": F.col("_d.alpha"), "_b": F.col("_d.beta")}, BANDIT_DECAY,
    )
    return sums.select(
        F.lit("local").alias("scope"), F.col("competition_id").alias("scope_key"), "action_type",
        (F.lit(1.0) + F.col("_a")).alias("alpha"), (F.lit(1.0) + F.col("_b")).alias("beta"), "updates",
    )


def bandit_posterior(bandit: DataFrame) -> DataFrame:
    total = F.col("alpha") + F.col("beta")
    return bandit.select(
        "scope", "scope_key", "action_type", (F.col("alpha") / total).alias("posterior_mean"), total.alias("trials"), "alpha", "beta"
    )


def bandit_calibration(bandit: DataFrame, attempts: DataFrame) -> DataFrame:
    """Belief against the weighted success the attempts really had."""
    failed = (F.col("label") == "regression") | F.col("error_trace").isNotNull()

    def worth(i: int) -> Column:
        jump, gain, fail, even = (OUTCOME_WORTH[k][i] for k in ("jump", "gain", "failed", "even"))
        return F.when(F.col("label") == "jump", jump).when(F.col("gain_vs_best") > 0, gain).when(failed, fail).otherwise(even)

    won, weight = worth(0), worth(1)
    scored = attempts.filter("stage = 'reflexion' AND cv_score IS NOT NULL")
    realised = scored.groupBy(F.col("competition_id").alias("scope_key"), "action_type").agg(
        F.sum(won).alias("_won"), F.sum(weight).alias("_weight"),
        F.count(F.lit(1)).alias("picks"), F.max("run_ts").alias("last_picked_ts"),
    )
    joined = bandit_posterior(bandit).join(realised, ["scope_key", "action_type"], "left")
    success = F.try_divide("_won", "_weight")
    return joined.select(
        "scope", "scope_key", "action_type", "alpha", "beta", "posterior_mean",
        (F.col("trials") - 2).alias("net_evidence"), "picks", "last_picked_ts",
        success.alias("weighted_success"), F.abs(F.col("posterior_mean") - success).alias("calibration_gap"),
    )


def bandit_health(calibration: DataFrame) -> DataFrame:
    return calibration.groupBy("scope_key").agg(
        F.coalesce(F.max("posterior_mean") - F.min("posterior_mean"), F.lit(0.0)).alias("posterior_spread"),
        F.coalesce(F.max("calibration_gap"), F.lit(0.0)).alias("calibration_gap"),
    )


# --- errors ---------------------------------------------------------------------------------------------------------


def error_recurrence(attempts: DataFrame, lessons: DataFrame) -> DataFrame:
    """Repeats of every error signature; from the second on it counts as a known pitfall.

    How often a signature returned after that follows from its count alone, so no ordered pass is needed.
    """
    errors = attempts.filter("label = 'error' AND error_signature IS NOT NULL")
    keys = ["competition_id", "action_type"]
    groups = errors.groupBy(*keys, "error_signature").agg(
        F.count(F.lit(1)).alias("total"), F.min("run_ts").alias("first_seen"), F.max("run_ts").alias("last_seen")
    )
    avoided = (
        lessons.filter("lesson_type = 'failure' AND NOT archived").select("attempt_id")
        .join(attempts.select("attempt_id", *keys), "attempt_id").groupBy(*keys).agg(F.lit(True).alias("_avoid"))
    )
    return groups.join(avoided, keys, "left").select(
        *keys, "error_signature", "total", "first_seen", "last_seen",
        (F.col("total") >= 2).alias("pitfall_active"),
        F.greatest(F.col("total") - 2, F.lit(0)).alias("occurrences_after_active"),
        F.coalesce("_avoid", F.lit(False)).alias("has_avoid_lesson"),
    )


def top_pitfalls(attempts: DataFrame, k: int = 5, window: int = 100, min_count: int = 2) -> DataFrame:
    """Most frequent signatures among the newest errors of a competition and action; the window of newest errors is part of
    the definition."""
    keys = ["competition_id", "action_type"]
    errors = attempts.filter("error_trace IS NOT NULL").select(*keys, "run_ts", "attempt_id", "error_signature")
    recent = prefix.newest_per_key(errors, keys, [F.col("run_ts").desc(), F.col("attempt_id").desc()], window)
    named = recent.filter("error_signature IS NOT NULL AND error_signature <> ''")
    counts = named.groupBy(*keys, "error_signature").agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("_newest"))
    best = prefix.newest_per_key(counts, keys, [F.col("n").desc(), F.col("_newest")], k, rank="place")
    return best.filter(F.col("n") >= min_count).drop("_newest")


# --- leaderboard and submissions ---------------------------------------------------------------------------------------


def cv_lb_gap_trend(subs: DataFrame, attempts: DataFrame, competitions: DataFrame) -> DataFrame:
    done = subs.filter("status = 'complete' AND lb_score IS NOT NULL")
    joined = done.join(attempts.filter("cv_score IS NOT NULL").select("attempt_id", "cv_score"), "attempt_id")
    joined = joined.join(competitions.select("competition_id", "metric_sign"), "competition_id")
    gap = F.col("metric_sign") * (F.col("cv_score") - F.col("lb_score"))
    return joined.select("submission_id", "competition_id", "submitted_at", "attempt_id", "cv_score", "lb_score", "lb_percentile", gap.alias("cv_lb_gap"))


def _with_previous(done: DataFrame) -> DataFrame:
    sliced = prefix.with_slice(done, ["competition_id"], prefix.time_position("submitted_at"))
    return prefix.previous(
        sliced, ["competition_id"], [F.col("submitted_at"), F.col("submission_id")],
        {"prev_cv": F.col("cv_score"), "prev_lb": F.col("lb_score")},
    )


def _deltas(ordered: DataFrame) -> DataFrame:
    sign = F.col("metric_sign")
    dcv, dlb = sign * (F.col("cv_score") - F.col("prev_cv")), sign * (F.col("lb_score") - F.col("prev_lb"))
    known = F.col("prev_cv").isNotNull() & F.col("prev_lb").isNotNull()
    diverged = known & (dcv > 0) & (dlb < -LB_DEADBAND * F.abs("prev_lb"))
    return ordered.withColumns({"delta_cv": dcv, "delta_lb": dlb, "diverged": diverged})


def cv_lb_calibration(subs: DataFrame, competitions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Change of own and external score against the previous complete submission, and whether they diverge."""
    done = subs.filter("status = 'complete' AND lb_score IS NOT NULL").select("submission_id", "competition_id", "submitted_at", "attempt_id", "lb_score")
    done = done.join(competitions.select("competition_id", "metric_sign"), "competition_id")
    done = done.join(attempts.select("attempt_id", "cv_score"), "attempt_id", "left")
    out = _deltas(_with_previous(done))
    return out.select("submission_id", "competition_id", "submitted_at", "attempt_id", "cv_score", "lb_score", "delta_cv", "delta_lb", "diverged")


def cv_lb_tripwire(subs: DataFrame, attempts: DataFrame, competitions: DataFrame) -> DataFrame:
    """Competitions where at least two of the newest three changes diverge."""
    done = subs.filter("status = 'complete' AND lb_score IS NOT NULL").select("submission_id", "competition_id", "submitted_at", "attempt_id", "lb_score")
    done = done.join(attempts.filter("cv_score IS NOT NULL").select("attempt_id", "cv_score"), "attempt_id")
    newest = prefix.newest_per_key(done, ["competition_id"], [F.col("submitted_at").desc(), F.col("submission_id").desc()], 4)
    newest = newest.join(competitions.select("competition_id", "metric_sign"), "competition_id")
    older = newest.select("competition_id", (F.col("rn") - 1).alias("rn"), F.col("cv_score").alias("prev_cv"), F.col("lb_score").alias("prev_lb"))
    steps = _deltas(newest.join(older, ["competition_id", "rn"]))
    grouped = steps.groupBy("competition_id").agg(
        F.count(F.lit(1)).alias("n_deltas"), F.count_if("diverged").alias("n_diverged"),
        F.min_by("attempt_id", "rn").alias("newest_attempt"),
    )
    return grouped.withColumn("tripped", F.col("n_diverged") >= 2)


def lb_gap_to_p90(board: DataFrame, subs: DataFrame, competitions: DataFrame) -> DataFrame:
    """Distance of the own best external score to the 90th percentile of the leaderboard."""
    signs = competitions.select("competition_id", "metric_sign")
    signed = board.select("competition_id", "score").join(signs, "competition_id")
    p90 = prefix.ordered_percentiles(signed, ["competition_id", "metric_sign"], F.col("metric_sign") * F.col("score"), {"p90": 0.9})
    done = subs.filter("status = 'complete' AND lb_score IS NOT NULL").select("competition_id", "lb_score").join(signs, "competition_id")
    best = done.groupBy("competition_id").agg((F.max(F.col("lb_score") * F.col("metric_sign")) * F.first("metric_sign")).alias("best_lb_score"))
    joined = p90.withColumn("p90_score", F.col("metric_sign") * F.col("p90")).join(best, "competition_id")
    gap = F.col("metric_sign") * (F.col("p90_score") - F.col("best_lb_score"))
    return joined.select("competition_id", "p90_score", "best_lb_score", gap.alias("gap_to_p90"))


def competition_snr(board: DataFrame, attempts: DataFrame, competitions: DataFrame) -> DataFrame:
    """Leaderboard spread p90 - p50 in units of the fold standard error."""
    signed = board.select("competition_id", "score").join(competitions.select("competition_id", "metric_sign"), "competition_id")
    spread = prefix.ordered_percentiles(signed, ["competition_id"], F.col("metric_sign") * F.col("score"), {"p90": 0.9, "p50": 0.5})
    folds = attempts.filter("cv_fold_var IS NOT NULL AND fold_scores IS NOT NULL").groupBy("competition_id").agg(
        F.avg("cv_fold_var").alias("avg_fold_var"), F.avg(F.size("fold_scores")).alias("avg_n_splits")
    )
    joined = spread.join(folds, "competition_id").withColumn("p90_p50_spread", F.col("p90") - F.col("p50"))
    noise = F.sqrt(F.try_divide("avg_fold_var", "avg_n_splits"))
    return joined.select("competition_id", "p90_p50_spread", "avg_fold_var", "avg_n_splits", F.try_divide(F.col("p90_p50_spread"), noise).alias("snr"))


def lb_percentile(subs: DataFrame, board: DataFrame, competitions: DataFrame) -> DataFrame:
    """Share of teams (percent) whose score is strictly worse than each complete submission.

    Both sides are counted by distinct score and merged into one ordered stream, so neither the leaderboard nor
    the submissions of one competition have to fit anywhere, and no pair of rows is formed.
    """
    signs = competitions.select("competition_id", "metric_sign")
    teams = board.select("competition_id", "score").join(signs, "competition_id").filter("score IS NOT NULL")
    teams = teams.groupBy("competition_id", (F.col("metric_sign") * F.col("score")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    done = subs.filter("status = 'complete' AND lb_score IS NOT NULL").select("submission_id", "competition_id", "lb_score")
    done = done.join(signs, "competition_id").withColumn("_v", F.col("metric_sign") * F.col("lb_score"))
    points = done.select("competition_id", "_v").distinct().withColumn("_c", F.lit(0).cast("long")).withColumn("_side", F.lit(0))
    merged = teams.withColumn("_side", F.lit(1)).unionByName(points)
    cum = prefix.running(prefix.with_slice(merged, ["competition_id"], F.col("_v")), ["competition_id"], [F.col("_v"), F.col("_side")], {"_worse": ("sum", F.col("_c"))})
    totals = teams.groupBy("competition_id").agg(F.sum("_c").alias("_n"))
    at = cum.filter("_side = 0").join(totals, "competition_id").select(
        "competition_id", "_v", (F.lit(100.0) * F.coalesce("_worse", F.lit(0)) / F.col("_n")).alias("lb_percentile")
    )
    return done.join(at, ["competition_id", "_v"]).select("submission_id", "competition_id", "lb_score", "lb_percentile")
