"""Listings and rankings: filtered pages, newest or best rows per key, candidates for submission.

Pages with a limit are top-n reports: every task keeps its own first rows. "Per key" rankings reduce to one row
with ``max_by`` / ``min_by`` or to k rows per key before the shuffle.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import SUBMISSIONS_PER_DAY
from ..functions import rules
from . import prefix, summaries

MAX_PAGE = 500


def page(df: DataFrame, order: Sequence[Column], limit: int, most: int | None = None) -> DataFrame:
    """The first ``limit`` rows; a listing page has at most ``most``, and a caller who asks for more is warned."""
    if most is not None and limit > most:
        warnings.warn(f"a page holds at most {most} rows, {limit} were asked for", stacklevel=3)
        limit = most
    return df.orderBy(*order).limit(limit)


def attempts_query(
    progress: DataFrame, attempts: DataFrame, *, competition=None, action_type=None, label=None, stage=None,
    has_error: bool | None = None, super_cycle=None, limit: int = 50,
) -> DataFrame:
    """Newest attempts with their number and running best, under any of the filters."""
    extra = attempts.select("attempt_id", "super_cycle_id", F.col("error_trace").isNotNull().alias("has_error"))
    rows = progress.join(extra, "attempt_id")
    wanted = {"competition_id": competition, "action_type": action_type, "label": label, "stage": stage, "has_error": has_error, "super_cycle_id": super_cycle}
    for col, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(col) == value)
    return page(rows, [F.col("run_ts").desc(), F.col("attempt_id").desc()], limit, MAX_PAGE)


LESSON_SORTS = ("created_at", "avg_gain", "times_applied", "jumps")


def lessons_query(
    lessons: DataFrame, *, competition=None, generality=None, lesson_type=None, archived: bool | None = None,
    sort: str = "created_at", limit: int = 50,
) -> DataFrame:
    """Lessons (with impact columns) of one competition or general ones, sorted by a known column."""
    rows = lessons.filter(F.col("archived") == F.lit(bool(archived)))
    if competition is not None:
        rows = rows.filter(own_or_general(competition))
    if generality is not None:
        rows = rows.filter(F.col("generality") == generality)
    if lesson_type is not None:
        rows = rows.filter(F.col("lesson_type") == lesson_type)
    key = sort if sort in LESSON_SORTS else "created_at"
    return page(rows, [F.col(key).desc(), F.col("reflection_id")], limit, MAX_PAGE)


def own_or_general(competition) -> Column:
    return (F.col("competition_id") == competition) | F.col("generality").isin("L2_class", "L3_general")


def list_queue(queue: DataFrame) -> DataFrame:
    return queue.orderBy(F.col("priority").desc(), F.col("created_at"), F.col("queue_id"))


def list_submissions(subs: DataFrame, competition=None, limit: int = 50) -> DataFrame:
    rows = subs if competition is None else subs.filter(F.col("competition_id") == competition)
    return page(rows, [F.col("submitted_at").desc(), F.col("submission_id").desc()], limit, MAX_PAGE)


def in_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys, keys.columns, "left_semi")


def latest_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    out = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return out.select(key, "_r.*").select(*df.columns)


def top_attempts(attempts: DataFrame, competitions: DataFrame, k: int) -> DataFrame:
    """Best k scored attempts with code per competition."""
    rows = attempts.filter("cv_score IS NOT NULL AND error_trace IS NULL AND code_path IS NOT NULL").select("attempt_id", "competition_id", "cv_score", "code_path")
    rows = rows.join(competitions.select("competition_id", "metric_sign"), "competition_id")
    return prefix.newest_per_key(rows, ["competition_id"], [(F.col("metric_sign") * F.col("cv_score")).desc(), F.col("attempt_id")], k, rank="place")


def error_like(attempts: DataFrame, pattern: str) -> DataFrame:
    return attempts.filter(F.col("error_trace").like(pattern))


def without_baseline(competitions: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Competitions without a valid, reproducible pipeline."""
    usable = pipelines.filter(F.col("invalid_reason").isNull() & ~F.coalesce("materialized_origin", F.lit("")).startswith("unverifiable:"))
    return competitions.join(usable.select("competition_id"), "competition_id", "left_anti")


def never_submitted(attempts: DataFrame, subs: DataFrame, status: str | None = None) -> DataFrame:
    done = subs if status is None else subs.filter(F.col("status") == status)
    return attempts.join(done.filter("attempt_id IS NOT NULL").select("attempt_id"), "attempt_id", "left_anti")


# --- candidates for submission -----------------------------------------------------------------------------------------


def promotions(pipelines: DataFrame, attempts: DataFrame) -> DataFrame:
    """Pipelines with competition, time and attempt fields of the attempt that made them."""
    own = pipelines.select("pipeline_id", "attempt_id", "invalid_reason", "materialized_code", "materialized_origin", "materialized_sha256", "pipeline_sha256", "code")
    return own.join(attempts.select("attempt_id", "competition_id", "run_ts", "cv_score", "error_trace"), "attempt_id")


def asof_promotion(attempts: DataFrame, pipelines: DataFrame) -> DataFrame:
    """The newest promotion strictly before each attempt of the same competition."""
    right = promotions(pipelines, attempts).select("competition_id", "run_ts", "attempt_id", "pipeline_id")
    left = attempts.select("attempt_id", "competition_id", "run_ts")
    return prefix.as_of(left, right, ["competition_id"], "run_ts", ["pipeline_id"], tie="attempt_id")


def promotion_chain(pipelines: DataFrame, attempts: DataFrame) -> DataFrame:
    """Position of every promotion in the history of its competition, quarantined ones included."""
    rows = promotions(pipelines, attempts).select("competition_id", "pipeline_id", "attempt_id", "run_ts", "invalid_reason")
    sliced = prefix.with_slice(rows, ["competition_id"], prefix.time_position("run_ts"))
    return prefix.running(sliced, ["competition_id"], [F.col("run_ts"), F.col("pipeline_id")], {"position": ("count", F.lit(1))})


def submittable(pipelines: DataFrame, attempts: DataFrame) -> DataFrame:
    """Promotions that can be sent: own snapshot usable and the promotion before it usable too.

    Adds ``prior_snapshot``: whether the promotion before has a stored snapshot (true where there is none before).
    """
    rows = promotions(pipelines, attempts)
    usable = F.col("materialized_code").isNotNull() | F.col("materialized_origin").isNull()
    marked = rows.withColumns({"_usable": usable, "_snap": F.col("materialized_code").isNotNull()})
    right = marked.select("competition_id", "run_ts", "pipeline_id", "_usable", "_snap")
    out = prefix.as_of(marked, right, ["competition_id"], "run_ts", ["_usable", "_snap"], tie="pipeline_id", prefix="_prev")
    out = out.filter(F.col("_usable") & F.coalesce("_prev_usable", F.lit(True)))
    return out.withColumn("prior_snapshot", F.coalesce("_prev_snap", F.lit(True))).drop("_usable", "_snap", "_prev_usable", "_prev_snap")


def _candidates(pipelines: DataFrame, attempts: DataFrame, competitions: DataFrame) -> DataFrame:
    rows = submittable(pipelines, attempts).filter("cv_score IS NOT NULL AND error_trace IS NULL AND invalid_reason IS NULL")
    rows = rows.join(competitions.select("competition_id", "metric_sign"), "competition_id")
    return rows.withColumn("_score", F.col("metric_sign") * F.col("cv_score"))


def best_submittable(pipelines: DataFrame, attempts: DataFrame, competitions: DataFrame, subs: DataFrame) -> DataFrame:
    """Best confirmed attempt per competition that has no complete submission yet."""
    rows = never_submitted(_candidates(pipelines, attempts, competitions), subs, "complete")
    best = F.min_by(F.struct("attempt_id", "cv_score"), F.struct(-F.col("_score"), F.col("run_ts"), F.col("attempt_id")))
    return rows.groupBy("competition_id").agg(best.alias("r")).select("competition_id", "r.*")


def unsubmitted_confirmed(
    pipelines: DataFrame, attempts: DataFrame, competitions: DataFrame, subs: DataFrame, k: int = SUBMISSIONS_PER_DAY
) -> DataFrame:
    """Never submitted confirmed attempts, those above a stored snapshot first, then by score."""
    rows = never_submitted(_candidates(pipelines, attempts, competitions), subs)
    order = [F.col("prior_snapshot").desc(), F.col("_score").desc(), F.col("run_ts"), F.col("attempt_id")]
    ranked = prefix.newest_per_key(rows, ["competition_id"], order, k, rank="place")
    return ranked.select("competition_id", "attempt_id", "cv_score", "prior_snapshot", "place")


def last_submitted(subs: DataFrame, now: Column) -> DataFrame:
    """Attempt of the newest submission that did not fail and is not stuck for more than an hour."""
    stuck = (F.col("status") == "submitted") & (F.col("checked_at") < now - F.expr("INTERVAL '1' HOUR"))
    rows = subs.filter(F.col("attempt_id").isNotNull() & ~F.col("status").isin("error", "invalid", "timeout") & ~F.coalesce(stuck, F.lit(False)))
    return rows.groupBy("competition_id").agg(F.max_by("attempt_id", F.struct("submitted_at", "submission_id")).alias("attempt_id"))


def pick_winner(attempts: DataFrame) -> DataFrame:
    """Winner of every super cycle: highest gain, first on ties; without any gain the first scored attempt."""
    gain = F.col("gain_vs_best")
    order = F.struct(gain.isNull(), -gain, F.col("run_ts"), F.col("attempt_id"))
    usable = attempts.filter("gain_vs_best IS NOT NULL OR cv_score IS NOT NULL")
    return usable.groupBy("super_cycle_id").agg(F.min_by("attempt_id", order).alias("attempt_id"))


def next_pending(queue: DataFrame) -> DataFrame:
    """Pending queue rows in the order they are taken."""
    return queue.filter("status = 'pending'").orderBy(F.col("priority").desc(), F.coalesce("last_leased_at", "created_at"), F.col("queue_id"))


def latest_tuned(tunes: DataFrame) -> DataFrame:
    """All rows of the newest tuning run of every competition, unless nothing in it improved."""
    run = tunes.groupBy("competition_id").agg(F.max_by("tuning_run_id", F.struct("created_at", "tuning_run_id")).alias("tuning_run_id"))
    rows = tunes.join(run, ["competition_id", "tuning_run_id"])
    good = rows.groupBy("competition_id").agg(F.bool_or("improved").alias("_any")).filter("_any").select("competition_id")
    return rows.join(good, "competition_id", "left_semi")


# --- lessons -----------------------------------------------------------------------------------------------------------


def top_lessons(impact: DataFrame, lessons: DataFrame, competition, k: int = 10) -> DataFrame:
    rows = lessons.filter(own_or_general(competition)).select("reflection_id", "competition_id", "generality").join(impact, "reflection_id")
    return page(rows, [F.col("avg_gain").desc(), F.col("reflection_id")], k)


def bootstrap_seeds(pipelines: DataFrame, similar: DataFrame, n: int = 2) -> DataFrame:
    """Best winning pipelines of similar competitions."""
    rows = pipelines.filter("gain_vs_best > 0").join(similar.select("competition_id"), "competition_id", "left_semi")
    return page(rows.select("pipeline_id", "competition_id", "code", "cv_score", "gain_vs_best"), [F.col("gain_vs_best").desc(), F.col("pipeline_id")], n)


def cold_start_lessons(lessons: DataFrame, impact: DataFrame, similar: DataFrame, k: int = 10) -> DataFrame:
    """Class lessons of similar competitions and all general lessons, by impact."""
    near = similar.select("competition_id").withColumn("_near", F.lit(True))
    rows = lessons.filter("NOT archived").join(near, "competition_id", "left")
    rows = rows.filter((F.col("_near") & (F.col("generality") == "L2_class")) | (F.col("generality") == "L3_general"))
    scored = rows.join(impact.select("reflection_id", "avg_gain"), "reflection_id", "left").fillna({"avg_gain": 0.0})
    return page(scored.select("reflection_id", "competition_id", "generality", "avg_gain"), [F.col("avg_gain").desc(), F.col("reflection_id")], k)


def failure_lessons(lessons: DataFrame, impact: DataFrame, competition, k: int = 3) -> DataFrame:
    """Newest failure lessons, own or general."""
    rows = lessons.filter(own_or_general(competition)).filter("NOT archived AND lesson_type = 'failure'")
    rows = rows.join(impact.select("reflection_id", "avg_gain"), "reflection_id", "left").fillna({"avg_gain": 0.0})
    return page(rows.select("reflection_id", "competition_id", "created_at", "avg_gain"), [F.col("created_at").desc(), F.col("reflection_id")], k)


def archive_candidates(lessons: DataFrame, impact: DataFrame, min_applied: int = 3, max_gain: float = 0.0) -> DataFrame:
    """Live lessons that were applied often and gained nothing."""
    weak = impact.filter((F.col("avg_gain") <= max_gain) & (F.col("times_applied") >= min_applied))
    live = lessons.filter("NOT archived").select("reflection_id", "generality", "competition_id")
    return live.join(weak.select("reflection_id", "times_applied", "avg_gain"), "reflection_id")


def merge_ranked(first: DataFrame, second: DataFrame, key: str, rank: str) -> DataFrame:
    """Two ranked lists as one: entries of the first list lead, an entry in both counts once."""
    both = first.select(key, rank, F.lit(0).alias("_list")).unionByName(second.select(key, rank, F.lit(1).alias("_list")))
    out = both.groupBy(key).agg(F.min(F.struct("_list", rank)).alias("_at"))
    return out.select(key, F.col("_at._list").alias("source_list"), F.col(f"_at.{rank}").alias(rank))
