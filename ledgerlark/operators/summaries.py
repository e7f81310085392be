"""Aggregations that monitor the fleet: best rows, recent activity, tuning, duplicates, kills, ties.

"Newest n" parts go through ``newest_per_key`` (a bounded number of rows per key after the map side); everything
else is a partial aggregation, so a hot competition costs one pre-aggregated row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import ACTION_TYPES, FUTILITY_STD
from ..functions import arrays, rules, text
from . import prefix, views


def newest_first() -> list[Column]:
    return [F.col("run_ts").desc(), F.col("attempt_id").desc()]


def confirmed(pipelines: DataFrame) -> DataFrame:
    """Pipelines with a score, not quarantined and reproducible."""
    return pipelines.filter(
        F.col("cv_score").isNotNull() & F.col("invalid_reason").isNull()
        & ~F.coalesce("materialized_origin", F.lit("")).startswith("unverifiable:")
    )


def best_confirmed(pipelines: DataFrame, competitions: DataFrame) -> DataFrame:
    joined = confirmed(pipelines).select("competition_id", "cv_score").join(competitions.select("competition_id", "metric_sign"), "competition_id")
    return joined.groupBy("competition_id").agg((F.max(F.col("metric_sign") * F.col("cv_score")) * F.max("metric_sign")).alias("best_cv"))


def best_row(pipelines: DataFrame, attempts: DataFrame, competitions: DataFrame) -> DataFrame:
    """The best confirmed pipeline per competition with its attempt; its own folds win over the attempt's."""
    own = confirmed(pipelines).select("competition_id", "attempt_id", "pipeline_id", "cv_score", F.col("fold_scores").alias("_folds"))
    joined = own.join(competitions.select("competition_id", "metric_sign"), "competition_id").join(
        attempts.select("attempt_id", "model_type", "hypothesis", F.col("fold_scores").alias("_att")), "attempt_id"
    )
    row = F.struct("pipeline_id", "attempt_id", "cv_score", "model_type", "hypothesis", F.coalesce("_folds", "_att").alias("fold_scores"))
    order = F.struct(-F.col("metric_sign") * F.col("cv_score"), F.col("pipeline_id"))
    return joined.filter("cv_score IS NOT NULL").groupBy("competition_id").agg(F.min_by(row, order).alias("r")).select("competition_id", "r.*")


def gain_stats(impact: DataFrame) -> DataFrame:
    return impact.agg(
        F.coalesce(F.avg("avg_gain"), F.lit(0.0)).alias("gain_mean"), F.coalesce(F.stddev_pop("avg_gain"), F.lit(0.0)).alias("gain_std")
    )


def confirmed_counts(pipelines: DataFrame) -> DataFrame:
    bad = F.col("invalid_reason").isNotNull()
    return pipelines.groupBy("competition_id").agg(F.count_if(~bad).alias("confirmed"), F.count_if(bad).alias("quarantined"))


def recent_activity(attempts: DataFrame, now: Column, days: int = 14) -> DataFrame:
    recent = attempts.filter(F.col("run_ts") > now - F.expr(f"INTERVAL '{days}' DAY"))
    return recent.groupBy("competition_id").agg(
        F.count(F.lit(1)).alias("attempts_14d"),
        F.count_if(F.col("label") == "jump").alias("jumps_14d"),
        F.count_if(F.col("label") == "error").alias("errors_14d"),
        F.count_if(F.col("error_trace").contains("rc=-9")).alias("oom_14d"),
        F.max("run_ts").alias("last_attempt"),
    )


def tuning_summary(tunes: DataFrame, now: Column) -> DataFrame:
    out = tunes.groupBy("competition_id").agg(
        F.max("created_at").alias("last_tune_at"), F.count(F.lit(1)).alias("n_results"),
        F.count_if("improved").alias("n_improved"), F.count_distinct("tuning_run_id").alias("n_runs"),
    )
    return out.withColumn("hours_since_last_tune", rules.seconds_between(F.col("last_tune_at"), now) / 3600.0)


def tune_status(hours: Column) -> Column:
    return F.when(hours.isNull(), "never").when(hours > 48, "stale").otherwise("ok")


def recent_actions(attempts: DataFrame, n: int = 10) -> DataFrame:
    scored = attempts.filter("cv_score IS NOT NULL").select("competition_id", "action_type", "run_ts", "attempt_id")
    return prefix.newest_per_key(scored, ["competition_id"], newest_first(), n).groupBy("competition_id", "action_type").agg(F.count(F.lit(1)).alias("cnt"))


def _failures(attempts: DataFrame, n: int) -> DataFrame:
    failed = attempts.filter("label = 'regression' OR error_trace IS NOT NULL")
    return prefix.newest_per_key(failed.select("competition_id", "action_type", "hypothesis", "run_ts", "attempt_id"), ["competition_id"], newest_first(), n)


def recent_failures(attempts: DataFrame, n: int = 10) -> DataFrame:
    return _failures(attempts, n).groupBy("competition_id", "action_type").agg(
        F.count(F.lit(1)).alias("cnt"), F.max("hypothesis").alias("sample_hypothesis")
    )


def failure_summary(attempts: DataFrame, n: int = 5, shown: int | None = None) -> DataFrame:
    """One line of the newest failures per competition; ``shown`` cuts every hypothesis to so many characters for display."""
    hypothesis = F.coalesce("hypothesis", F.lit(""))
    line = F.concat(F.col("action_type"), F.lit(": "), hypothesis if shown is None else F.left(hypothesis, F.lit(shown)))
    rows = _failures(attempts, n).groupBy("competition_id").agg(F.sort_array(F.collect_list(F.struct("rn", line.alias("line")))).alias("_l"))
    return rows.select("competition_id", F.array_join(F.transform("_l", lambda s: s["line"]), "; ").alias("summary"))


def last_hypothesis(attempts: DataFrame) -> DataFrame:
    known = attempts.filter("hypothesis IS NOT NULL")
    return known.groupBy("competition_id").agg(F.max_by("hypothesis", F.struct("run_ts", "attempt_id")).alias("hypothesis"))


def retrieval_text(attempts: DataFrame, cards: DataFrame, shown: int | None = None) -> DataFrame:
    """Search text per competition: newest hypothesis and what to avoid, else its data card."""
    joined = cards.join(last_hypothesis(attempts), "competition_id", "left").join(failure_summary(attempts, shown=shown), "competition_id", "left")
    avoid = F.when(F.col("summary") != "", F.concat(F.lit("avoid: "), F.col("summary")))
    query = F.concat_ws("; ", F.nullif("hypothesis", F.lit("")), avoid)
    return joined.select("competition_id", F.coalesce(F.nullif(query, F.lit("")), F.col("card")).alias("query_text"))


def since_last_confirmed(attempts: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Attempts after the newest valid confirmed pipeline of their competition; none where there is no such."""
    valid = pipelines.filter("cv_score IS NOT NULL AND invalid_reason IS NULL").select("attempt_id")
    base = valid.join(attempts.select("attempt_id", "competition_id", "run_ts"), "attempt_id")
    latest = base.groupBy("competition_id").agg(F.max("run_ts").alias("_since"))
    return attempts.join(latest, "competition_id").filter("run_ts > _since").drop("_since")


def tried_on_base(attempts: DataFrame, pipelines: DataFrame, limit: int | None = None, shown: int | None = None) -> DataFrame:
    """Distinct outcomes since the last confirmed pipeline, numbered from the most repeated; ``limit`` keeps so many of a
    competition, ``shown`` cuts hypotheses to so many characters for display."""
    cols = ["attempt_id", "competition_id", "run_ts", "action_type", "gain_vs_best", "hypothesis", "error_trace"]
    rows = since_last_confirmed(attempts.select(*cols), pipelines).filter("error_trace IS NULL AND gain_vs_best IS NOT NULL")
    groups = rows.groupBy("competition_id", "action_type", rules.round_half(F.col("gain_vs_best"), 7).alias("gain")).agg(
        F.count(F.lit(1)).alias("cnt"), F.max_by("hypothesis", F.struct("run_ts", "attempt_id")).alias("hypothesis"), F.max("run_ts").alias("_last")
    )
    order = [F.col("cnt").desc(), F.col("_last").desc(), F.col("action_type"), F.col("gain")]
    if limit is None:
        placed = groups.withColumn("place", F.row_number().over(W.partitionBy("competition_id").orderBy(*order)))
    else:
        placed = prefix.newest_per_key(groups, ["competition_id"], order, limit, rank="place")
    return placed.drop("_last").withColumn("hypothesis", text.squeeze(F.coalesce("hypothesis", F.lit("")), shown))


def recent_tunes_failed(tunes: DataFrame, n: int = 5) -> DataFrame:
    """True where the newest n tuning runs exist and none of them improved anything."""
    runs = tunes.groupBy("competition_id", "tuning_run_id").agg(F.bool_or("improved").alias("_any"), F.max("created_at").alias("_at"))
    newest = prefix.newest_per_key(runs, ["competition_id"], [F.col("_at").desc(), F.col("tuning_run_id").desc()], n)
    out = newest.groupBy("competition_id").agg(F.count(F.lit(1)).alias("runs"), F.bool_or("_any").alias("_any"))
    return out.select("competition_id", "runs", ((F.col("runs") == n) & ~F.col("_any")).alias("all_failed"))


def last_run(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("competition_id").agg(F.max("run_ts").alias("last_run_ts"))


def last_queue(queue: DataFrame) -> DataFrame:
    rest = F.struct("status", "n_cycles", "cycles_done", "created_at", "queue_id")
    out = queue.groupBy("competition").agg(F.max_by(rest, F.struct("created_at", "queue_id")).alias("r"))
    return out.select("competition", F.col("r.status").alias("queue_status"), "r.n_cycles", "r.cycles_done", "r.created_at")


def gate_counts(attempts: DataFrame, now: Column) -> DataFrame:
    """Successes, finished attempts and seconds since the first full result of every super cycle."""
    full = ~F.coalesce("futility_early_exit", F.lit(False))
    first = F.min(F.when(full, F.col("run_ts")))
    out = attempts.groupBy("super_cycle_id").agg(
        F.count_if(F.col("cv_score").isNotNull() & full).alias("n_success"),
        F.count_if(F.col("cv_score").isNotNull() | F.col("error_trace").isNotNull()).alias("n_done"),
        first.alias("_first"),
    )
    return out.withColumn("span_sec", rules.seconds_between(F.col("_first"), now)).drop("_first")


def pacing_counts(attempts: DataFrame, now: Column, session_hours: int = 5) -> DataFrame:
    return attempts.agg(
        F.count_if(F.col("run_ts") >= now - F.expr(f"INTERVAL '{session_hours}' HOUR")).alias("session_count"),
        F.count_if(F.col("run_ts") >= now - F.expr("INTERVAL '7' DAY")).alias("week_count"),
    )


def submissions_today(subs: DataFrame, now: Column) -> DataFrame:
    today = subs.filter((F.col("submitted_at") >= F.date_trunc("DAY", now)) & (F.col("status") != "error"))
    return today.groupBy("competition_id").agg(F.count(F.lit(1)).alias("n_today"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("cnt"))


def progress_pivot(progress: DataFrame, competitions: list) -> DataFrame:
    """Attempt number by competition; the columns are given, so no pass over the data finds them."""
    return progress.groupBy("attempt_no").pivot("competition_id", competitions).agg(F.avg("best_so_far"))


def transfer_pivot(matrix: DataFrame, targets: list) -> DataFrame:
    return matrix.groupBy("source_comp").pivot("target_comp", targets).agg(F.sum("citations")).fillna(0)


def warm_start(progress: DataFrame, competitions: DataFrame, signed: bool = False) -> DataFrame:
    """Best bootstrap score over the best score; by default greater is better, ``signed`` follows the metric."""
    sign = F.col("metric_sign") if signed else F.lit(1)
    joined = progress.select("competition_id", "stage", "best_so_far").join(competitions.select("competition_id", "name", "metric_sign"), "competition_id")
    best = sign * F.col("best_so_far")
    out = joined.groupBy("competition_id", "name", "metric_sign").agg(
        F.max(F.when(F.col("stage") == "bootstrap", best)).alias("_boot"), F.max(best).alias("_all")
    )
    boot, overall = rules.round_half(sign * F.col("_boot"), 5), rules.round_half(sign * F.col("_all"), 5)
    out = out.select("competition_id", "name", boot.alias("bootstrap_best"), overall.alias("overall_best"))
    return out.withColumn("warm_start_ratio", F.when(F.col("overall_best") != 0, rules.round_half(F.col("bootstrap_best") / F.col("overall_best"), 4)))


def holdout_summary(attempts: DataFrame) -> DataFrame:
    rows = attempts.filter("holdout_score IS NOT NULL AND cv_score IS NOT NULL")
    return rows.groupBy("competition_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("cv_score") - F.col("holdout_score")).alias("avg_gap"))


def divergence_count(calibration: DataFrame) -> DataFrame:
    return calibration.groupBy("competition_id").agg(F.count_if(F.coalesce("diverged", F.lit(False))).alias("n_diverged"))


def _repeats(rows: DataFrame, keys: list[str], cost: str | None) -> DataFrame:
    """Per group: how many rows repeat an earlier row of the group, and what they cost (all but the first)."""
    first = F.struct("run_ts", "attempt_id")
    aggs = [F.count(F.lit(1)).alias("_n")]
    if cost:
        aggs += [F.sum(cost).alias("_all"), F.min_by(cost, first).alias("_first")]
    return rows.groupBy(*keys).agg(*aggs)


def duplicate_compute(attempts: DataFrame) -> DataFrame:
    """Attempts that repeat an earlier vector of fold scores of their competition, and the CPU hours spent on it."""
    rows = attempts.filter("fold_scores IS NOT NULL")
    groups = _repeats(rows, ["competition_id", "fold_scores"], "peak_cpu_sec").filter("_n > 1")
    return groups.groupBy("competition_id").agg(
        F.sum(F.col("_n") - 1).alias("repeats"), (F.sum(F.col("_all") - F.col("_first")) / 3600.0).alias("cpu_hours")
    )


def duplicate_gain(attempts: DataFrame) -> DataFrame:
    """Share of attempts that repeat an earlier gain (seven places) of their competition."""
    rows = attempts.filter("stage = 'reflexion' AND error_trace IS NULL AND gain_vs_best IS NOT NULL")
    groups = _repeats(rows.withColumn("_g", rules.round_half(F.col("gain_vs_best"), 7)), ["competition_id", "_g"], None)
    return groups.groupBy("competition_id").agg(F.sum("_n").alias("n"), F.sum(F.col("_n") - 1).alias("repeats"))


def kill_stages(attempts: DataFrame) -> DataFrame:
    """Where CPU kills hit: stage and fold of the last progress line."""
    killed = attempts.filter("error_trace LIKE 'cpu budget exceeded%' AND error_trace LIKE '%[last_progress]%'")
    rows = killed.select(text.kill_stage(F.col("error_trace")).alias("_k"), "peak_cpu_sec")
    return rows.groupBy(F.col("_k.stage").alias("stage"), F.col("_k.fold").alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), rules.round_half(F.sum("peak_cpu_sec") / 3600.0, 1).alias("cpu_h")
    )


def tie_rates(attempts: DataFrame) -> DataFrame:
    rows = attempts.filter("stage = 'reflexion' AND error_trace IS NULL AND gain_vs_best IS NOT NULL")
    gain = F.col("gain_vs_best")
    near = (gain != 0) & (F.abs(gain) <= rules.noise_tolerance(F.col("cv_score")))
    return rows.groupBy("action_type").agg(
        F.count_if(gain == 0).alias("exact_tie"), F.count_if(near).alias("near_tie"), F.count(F.lit(1)).alias("n")
    )


def futility_rate(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("action_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("futility_early_exit", F.lit(False))).alias("futile"))


def futility_audit(attempts: DataFrame, pipelines: DataFrame, competitions: DataFrame) -> DataFrame:
    """Completed attempts that met the stop rule: how many of them gained after all.

    The base of an attempt is the newest valid pipeline promoted before it.
    """
    cols = ["attempt_id", "competition_id", "run_ts", "label", "gain_vs_best", "fold_scores"]
    done = attempts.filter("fold_scores IS NOT NULL AND NOT coalesce(futility_early_exit, false)").select(*cols)
    base = pipelines.filter("cv_score IS NOT NULL AND invalid_reason IS NULL").select("attempt_id", F.col("fold_scores").alias("_p"))
    base = base.join(attempts.select("attempt_id", "competition_id", "run_ts", F.col("fold_scores").alias("_a")), "attempt_id")
    base = base.select("competition_id", "run_ts", "attempt_id", F.coalesce("_p", "_a").alias("base_folds"))
    rows = prefix.as_of(done, base, ["competition_id"], "run_ts", ["base_folds"], tie="attempt_id", prefix="")
    rows = rows.join(competitions.select("competition_id", "metric_sign"), "competition_id")
    fold1, b = F.get("fold_scores", F.lit(0)), F.col("base_folds")
    met = F.col("metric_sign") * (fold1 - F.get(b, F.lit(0))) < -FUTILITY_STD * arrays.std_pop(b)
    wrong = (F.col("gain_vs_best") > 1e-4) | (F.col("label") == "jump")
    return rows.filter(met).groupBy("competition_id").agg(F.count(F.lit(1)).alias("audited"), F.count_if(wrong).alias("false_stops"))


def fold_stats(attempts: DataFrame) -> DataFrame:
    f = F.col("fold_scores")
    return attempts.select("attempt_id", arrays.mean(f).alias("fold_mean"), arrays.variance(f).alias("fold_var"), arrays.std_pop(f).alias("fold_std"))


def fold_se(attempts: DataFrame) -> DataFrame:
    return attempts.select("attempt_id", arrays.standard_error(F.col("fold_scores")).alias("fold_se"))


def stagnation(attempts: DataFrame, window: int = 5, threshold: int = 3) -> DataFrame:
    """Winners since the last jump, jumps among the newest winners, actions unused lately."""
    newest = prefix.newest_per_key(attempts.select("competition_id", "action_type", "run_ts", "attempt_id"), ["competition_id"], newest_first(), window * 3)
    used = newest.groupBy("competition_id").agg(F.collect_set("action_type").alias("_used"))
    winners = prefix.newest_per_key(
        attempts.filter("was_promoted").select("competition_id", "label", "run_ts", "attempt_id"), ["competition_id"], newest_first(), window
    )
    counts = winners.groupBy("competition_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("label") == "jump").alias("jumps_in_window"), F.min(F.when(F.col("label") == "jump", F.col("rn"))).alias("_jump")
    )
    since = F.coalesce(F.col("_jump") - 1, F.col("_n"), F.lit(0))
    unused = F.array_except(F.array(*[F.lit(a) for a in ACTION_TYPES]), F.col("_used"))
    return used.join(counts, "competition_id", "left").select(
        "competition_id", F.coalesce("jumps_in_window", F.lit(0)).alias("jumps_in_window"), since.cast("long").alias("stagnant_for"),
        (since >= threshold).alias("is_stagnant"), unused.alias("underused_actions"),
    )


def error_slope(attempts: DataFrame, newest: int = 200, minimum: int = 20) -> DataFrame:
    """Sign of the error-rate change between the older and the newer half of the newest attempts; the window of ``newest``
    attempts is the definition of the slope."""
    rows = attempts.filter("stage = 'reflexion'").select("competition_id", "label", "run_ts", "attempt_id")
    recent = prefix.newest_per_key(rows, ["competition_id"], newest_first(), newest)
    size = recent.groupBy("competition_id").agg(F.count(F.lit(1)).alias("n"))
    error, recent_half = (F.col("label") == "error").cast("double"), F.col("rn") <= F.floor(F.col("n") / 2)
    rates = recent.join(size, "competition_id").groupBy("competition_id", "n").agg(
        F.avg(F.when(recent_half, error)).alias("_new"), F.avg(F.when(~recent_half, error)).alias("_old")
    )
    slope = F.when(F.col("n") < minimum, 0).otherwise(F.signum(F.col("_new") - F.col("_old")).cast("int"))
    return rates.select("competition_id", "n", slope.alias("error_rate_slope"))


def fold1_cache(attempts: DataFrame, n_folds: int = 5, newest: int | None = None) -> DataFrame:
    """Newest vector per distinct first-fold value among the attempts with that many folds, or the ``newest`` of them."""
    rows = attempts.filter(F.size("fold_scores") == n_folds).select("competition_id", "attempt_id", "run_ts", "fold_scores")
    if newest is not None:
        rows = prefix.newest_per_key(rows, ["competition_id"], newest_first(), newest)
    first = F.get("fold_scores", F.lit(0)).alias("fold1")
    out = rows.groupBy("competition_id", first).agg(F.max_by(F.struct("attempt_id", "fold_scores"), F.struct("run_ts", "attempt_id")).alias("r"))
    return out.select("competition_id", "fold1", "r.*")


def over_mean(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Mean of a category next to every row; aggregated first, so a hot category is not sorted in one task."""
    return df.join(df.groupBy(key).agg(F.avg(value).alias(name)), key, "left")
