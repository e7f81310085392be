"""Decisions on the way from a scored attempt to a stored pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import CEILING_SE, CONFIRM_SEEDS
from ..functions import arrays, rules
from ..operators import listings, prefix
from ..sources import tables


def confirm(evaluations: DataFrame, holdout: DataFrame, seeds: Sequence[int] = CONFIRM_SEEDS) -> DataFrame:
    """Verdict per candidate: better than the baseline on every seed and not worse on the holdout.

    ``evaluations`` has one row per (candidate_id, seed) with both scores, the sign and an error; ``holdout`` one
    per candidate. An error rejects without a memo. A candidate whose holdout score is missing is rejected too; a
    missing baseline holdout blocks nothing.
    """
    gain = F.col("metric_sign") * (F.col("candidate_cv") - F.col("baseline_cv"))
    seedwise = evaluations.filter(F.col("seed").isin(*seeds)).groupBy("candidate_id").agg(
        F.count_distinct("seed").alias("_seeds"),
        F.every(F.coalesce(gain > 0, F.lit(False)) & F.col("error").isNull()).alias("_won"),
        F.bool_or(F.col("error").isNotNull() | F.col("baseline_cv").isNull()).alias("errored"),
        F.first("metric_sign").alias("metric_sign"),
    )
    rows = seedwise.join(holdout, "candidate_id", "left")
    measured = ~F.col("errored")
    regressed = measured & F.coalesce(F.col("metric_sign") * (F.col("candidate_holdout") - F.col("baseline_holdout")) < 0, F.lit(False))
    failed = measured & F.col("candidate_holdout").isNull()
    confirmed = F.col("_won") & (F.col("_seeds") == len(seeds)) & ~regressed & ~failed
    return rows.select(
        "candidate_id", "errored", F.when(measured, F.col("candidate_holdout")).alias("holdout_score"),
        regressed.alias("holdout_regressed"), confirmed.alias("confirmed"),
        (~confirmed & ~F.col("errored") & ~failed).alias("memo"),
    )


def effective_label(label: Column, confirmed: Column) -> Column:
    """A jump that was checked and not confirmed counts as regression; unchecked labels stay."""
    return F.when((label == "jump") & (confirmed == F.lit(False)), "regression").otherwise(label)


def ceiling_violations(attempts: DataFrame, board: DataFrame, competitions: DataFrame) -> DataFrame:
    """Attempts above the best leaderboard score by more than three fold standard errors."""
    signs = competitions.select("competition_id", "metric_sign")
    best = board.select("competition_id", "score").join(signs, "competition_id").groupBy("competition_id", "metric_sign").agg(
        (F.max(F.col("metric_sign") * F.col("score")) * F.col("metric_sign")).alias("world_best")
    )
    rows = attempts.filter("cv_score IS NOT NULL").select("attempt_id", "competition_id", "cv_score", "fold_scores").join(best, "competition_id")
    margin = F.lit(CEILING_SE) * arrays.standard_error(F.col("fold_scores"))
    rows = rows.withColumn("margin", margin)
    over = F.col("metric_sign") * (F.col("cv_score") - F.col("world_best")) > F.col("margin")
    return rows.filter(over).select("attempt_id", "competition_id", "cv_score", "world_best", "margin")


def memo_key(context: Column, cv: Column, folds: Column, seeds: Sequence[int] = CONFIRM_SEEDS) -> Column:
    """Digest of the evaluation context, the confirm seeds and the rounded behaviour of a candidate."""
    return F.sha2(F.concat(context, F.lit("\0"), F.lit(",".join(map(str, seeds))), F.lit("\0"), rules.behaviour_key(cv, folds)), 256)


def context_key(parts: Sequence[Column]) -> Column:
    return F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256)


def memo_lookup(candidates: DataFrame, memo: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Candidates whose behaviour was rejected before, within the life time of the memo."""
    fresh = tables.ttl(memo, "created_at", f"'{days}' DAY", now)
    known = fresh.groupBy("memo_key").agg(F.max("created_at").alias("rejected_at"))
    return candidates.join(known, "memo_key")


def baseline_lookup(wanted: DataFrame, cache: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Cached baseline scores by context key, mode and seed; a stale or missing one reads as null."""
    keys = ["cache_key", "mode", "seed"]
    fresh = tables.newest_by_key(tables.ttl(cache, "created_at", f"'{days}' DAY", now), keys, ["created_at"])
    return wanted.join(fresh.select(*keys, "score"), keys, "left")


# --- guards ----------------------------------------------------------------------------------------------------------


def data_fingerprint(df: DataFrame) -> DataFrame:
    """Digest of the sorted column names with types and the row count of a training frame."""
    kinds = "|".join(f"{name}:{kind}" for name, kind in sorted(df.dtypes))
    return df.agg(F.count(F.lit(1)).alias("_h")).select(F.sha2(F.concat(F.lit(f"{kinds}|h="), F.col("_h").cast("string")), 256).alias("fingerprint"))


def fingerprint_guard(competitions: DataFrame, current: DataFrame, column: str, pause_prefix: str) -> DataFrame:
    """Stored against current fingerprint: stamp the first one, pass (and lift the own pause) or pause.

    ``current`` has competition_id and fingerprint. The result is the new state with what happened.
    """
    rows = competitions.join(current.select("competition_id", F.col("fingerprint").alias("_now")), "competition_id")
    stored, now, paused = F.col(column), F.col("_now"), F.col("auto_submit_paused_reason")
    outcome = F.when(stored.isNull(), "stamp").when(stored == now, "pass").otherwise("mismatch")
    reason = F.concat(F.lit(pause_prefix + ": stored "), F.left(stored, F.lit(12)), F.lit(" != current "), F.left(now, F.lit(12)))
    new_pause = F.when(outcome == "mismatch", F.coalesce(paused, reason)).when((outcome == "pass") & paused.startswith(pause_prefix), F.lit(None)).otherwise(paused)
    return rows.select("competition_id", F.coalesce(stored, now).alias(column), new_pause.alias("auto_submit_paused_reason"), outcome.alias("outcome"))


def source_guard(pipelines: DataFrame, attempts: DataFrame, texts: DataFrame) -> DataFrame:
    """Digest of the stored base text against the newest valid pipeline; a missing hash or text is skipped."""
    valid = listings.promotions(pipelines, attempts).filter("invalid_reason IS NULL")
    trusted = F.coalesce("materialized_sha256", "pipeline_sha256")
    newest = valid.groupBy("competition_id").agg(F.max_by(F.struct(trusted.alias("trusted")), F.struct("run_ts", "pipeline_id")).alias("r")).select("competition_id", "r.trusted")
    actual = F.sha2(F.col("text"), 256)
    state = F.when(F.col("trusted").isNull() | F.col("text").isNull(), "skip").when(actual == F.col("trusted"), "match").otherwise("mismatch")
    return newest.join(texts, "competition_id", "left").select("competition_id", state.alias("state"))


def snapshot_corruption(pipelines: DataFrame) -> DataFrame:
    """Stored snapshots whose digest differs from the recorded one."""
    trusted = F.coalesce("materialized_sha256", "pipeline_sha256")
    rows = pipelines.filter("materialized_code IS NOT NULL").withColumns({"trusted": trusted, "actual": F.sha2("materialized_code", 256)})
    return rows.filter("trusted IS NOT NULL AND actual <> trusted").select("pipeline_id", "competition_id", "trusted", "actual")


def merge_verify(winners: DataFrame, rescored: DataFrame) -> DataFrame:
    """Whether the merged pipeline reproduces the winner's score within the noise tolerance."""
    rows = winners.join(rescored, "attempt_id", "left")
    same = F.abs(F.col("rescored_cv") - F.col("cv_score")) <= rules.noise_tolerance(F.col("cv_score"))
    return rows.withColumn("verified", F.coalesce(same, F.lit(False)))


# --- quarantine and re-measurement ---------------------------------------------------------------------------------------


def quarantine_since(pipelines: DataFrame, lessons: DataFrame, attempts: DataFrame, competition, since: Column, reason: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mark the pipelines and archive the lessons of a competition from an instant on; also returns the counts."""
    times = attempts.select("attempt_id", F.col("run_ts").alias("_ts"))
    dated = pipelines.join(times, "attempt_id", "left")
    hit = (F.col("competition_id") == competition) & F.col("invalid_reason").isNull() & (F.col("_ts") >= since)
    marked, changed = tables.update_where(dated, hit, {"invalid_reason": F.lit(reason)})
    stale = (F.col("competition_id") == competition) & ~F.col("archived") & (F.col("created_at") >= since)
    archived, gone = tables.update_where(lessons, stale, {"archived": F.lit(True)})
    n = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return marked.drop("_ts"), archived, n(changed, "pipelines").unionByName(n(gone, "lessons"))


def apply_remeasure(pipelines: DataFrame, scores: DataFrame) -> DataFrame:
    """New scores and folds for valid confirmed pipelines; those whose re-evaluation failed are quarantined.

    ``scores``: pipeline_id, new_cv, new_folds, failed. Pipelines without a new row stay as they are.
    """
    rows = pipelines.join(scores, "pipeline_id", "left")
    usable = (
        F.col("invalid_reason").isNull() & F.col("cv_score").isNotNull() & F.col("failed").isNotNull()
        & ~F.coalesce("materialized_origin", F.lit("")).startswith("unverifiable:")
    )
    bad = usable & (F.col("failed") | F.col("new_cv").isNull())
    good = usable & ~F.coalesce(F.col("failed"), F.lit(True)) & F.col("new_cv").isNotNull()
    new = {
        "cv_score": F.when(good, F.col("new_cv")).otherwise(F.col("cv_score")),
        "fold_scores": F.when(good, F.col("new_folds")).otherwise(F.col("fold_scores")),
        "invalid_reason": F.when(bad, "remeasure_failed:train_fingerprint").otherwise(F.col("invalid_reason")),
    }
    return rows.withColumns(new).select(*pipelines.columns)


def reproduction_verdict(pipelines: DataFrame, attempts: DataFrame, rescored: DataFrame, competitions: DataFrame, allow_chain: bool = True) -> DataFrame:
    """How far a stored pipeline can be trusted after re-evaluation: digest, equal score, chain, or not at all.

    ``rescored``: pipeline_id, text, comparable, new_cv, new_folds, new_var. The chain tier compares with the
    promotion directly before that was re-evaluated at all.
    """
    rows = listings.promotions(pipelines, attempts).drop("cv_score", "error_trace").join(pipelines.select("pipeline_id", "cv_score"), "pipeline_id")
    rows = rows.join(rescored, "pipeline_id", "left").join(competitions.select("competition_id", "metric_sign"), "competition_id")
    sliced = prefix.with_slice(rows, ["competition_id"], prefix.time_position("run_ts"))
    seen = F.when(F.col("new_cv").isNotNull(), F.struct(F.col("new_cv").alias("cv"), F.col("new_folds").alias("folds")))
    rows = prefix.running(sliced, ["competition_id"], [F.col("run_ts"), F.col("pipeline_id")], {"_prev": ("last", seen)}, before=True)
    stored = F.col("materialized_code").isNotNull()
    trusted = F.coalesce("materialized_sha256", "pipeline_sha256")
    corrupt = stored & trusted.isNotNull() & (F.sha2("materialized_code", 256) != trusted)
    same_text = F.coalesce(F.sha2("text", 256) == F.col("pipeline_sha256"), F.lit(False))
    same_cv = F.abs(F.col("new_cv") - F.col("cv_score")) <= rules.noise_tolerance(F.col("cv_score"))
    comparable = F.coalesce("comparable", F.lit(False)) & F.col("cv_score").isNotNull()
    prev_better = rules.is_significant(
        F.col("_prev.folds"), F.col("new_folds"), F.col("metric_sign") * (F.col("_prev.cv") - F.col("new_cv")), F.coalesce("new_var", F.lit(0.0)), F.col("metric_sign")
    )
    verdict = (
        F.when(corrupt, "unverifiable:snapshot_corrupt")
        .when(stored, F.coalesce("materialized_origin", F.lit("promote")))
        .when(F.col("text").isNull(), "unverifiable:eval_error")
        .when(same_text, "backfill:sha")
        .when(F.col("new_cv").isNull(), "unverifiable:eval_error")
        .when(comparable & same_cv, "backfill:cv")
        .when(comparable, "unverifiable:cv_mismatch")
    )
    if allow_chain:
        verdict = verdict.when(F.col("_prev").isNull() | ~prev_better, "backfill:chain").otherwise("unverifiable:chain_regression")
    else:
        verdict = verdict.otherwise("unverifiable:train_drift")
    return rows.select("pipeline_id", "competition_id", verdict.alias("verdict"))
