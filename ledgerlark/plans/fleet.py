"""Decisions over the whole fleet: actions to try, submissions, queue refill, tuning, health and attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions import draws, rules
from ..operators import listings, summaries, views


# --- actions ---------------------------------------------------------------------------------------------------------


def _draw(seed: int, number: int) -> Column:
    """The numbered posterior draw of a competition's action, repeatable on any engine."""
    return draws.beta_draw(F.col("alpha"), F.col("beta"), F.lit(seed), F.col("scope_key"), F.col("action_type"), F.lit(number))


def _beliefs(bandit: DataFrame, competitions: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """One row per competition and action; competitions and actions never tried have the flat prior."""
    actions = [a for a in K.ACTION_TYPES if a not in excluded]
    bandit = bandit.filter("scope = 'local'")
    grid = competitions.select(F.col("competition_id").alias("scope_key")).distinct().withColumn("action_type", F.explode(F.array(*[F.lit(a) for a in actions])))
    return grid.join(bandit.select("scope_key", "action_type", "alpha", "beta"), ["scope_key", "action_type"], "left").fillna({"alpha": 1.0, "beta": 1.0})


def action_prior(bandit: DataFrame, competitions: DataFrame, seed: int) -> DataFrame:
    """One posterior draw per action, four places."""
    return _beliefs(bandit, competitions).select("scope_key", "action_type", F.round(_draw(seed, 0), 4).alias("prior"))


def assign_actions(bandit: DataFrame, attempts: DataFrame, competitions: DataFrame, n: int, seed: int, excluded: tuple[str, ...] = ()) -> DataFrame:
    """n actions per competition by posterior draws; dead actions only while their window for a retry is open.

    Missing places are filled by a fresh draw among the living; with none alive the full ranking is cycled.
    """
    total = attempts.groupBy(F.col("competition_id").alias("scope_key")).agg(F.count(F.lit(1)).alias("_total"))
    rows = _beliefs(bandit, competitions, excluded).join(total, "scope_key", "left").fillna({"_total": 0})
    dead = rules.is_dead_action(F.col("alpha"), F.col("beta")) & (F.col("_total") % K.REEXPLORE_EVERY >= n)
    rows = rows.withColumns({"_draw": F.array(*[_draw(seed, i) for i in range(n + 1)]), "_dead": dead})
    entry = F.struct((-F.get("_draw", F.lit(0))).alias("d"), F.col("action_type").alias("a"), F.col("_dead").alias("x"), F.col("_draw").alias("draw"))
    per = rows.groupBy("scope_key").agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    per = per.withColumn("_alive", F.filter("_all", lambda e: ~e["x"]))
    slots = per.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    alive = F.size("_alive")
    fresh = F.sort_array(F.transform("_alive", lambda e: F.struct((-F.get(e["draw"], F.col("slot") + 1)).alias("d"), e["a"].alias("a"))))
    action = (
        F.when(alive == 0, F.get("_all", F.col("slot") % F.size("_all"))["a"])
        .when(F.col("slot") < alive, F.get("_alive", F.col("slot"))["a"])
        .otherwise(F.get(fresh, F.lit(0))["a"])
    )
    return slots.select("scope_key", "slot", action.alias("action_type"))


# --- submissions -------------------------------------------------------------------------------------------------------


def plan_submissions(
    competitions: DataFrame, pipelines: DataFrame, attempts: DataFrame, subs: DataFrame, now: Column
) -> DataFrame:
    """Per active competition the attempts to send today, or why none is sent."""
    comp = competitions.filter("is_active").select("competition_id", "metric_sign", "auto_submit_paused_reason")
    used = summaries.submissions_today(subs, now)
    state = comp.join(used, "competition_id", "left").withColumn("budget", F.lit(K.SUBMISSIONS_PER_DAY) - F.coalesce("n_today", F.lit(0)))
    backlog = listings.unsubmitted_confirmed(pipelines, attempts, competitions, subs).select("competition_id", F.col("attempt_id").alias("_next"), "place")
    best = listings.best_submittable(pipelines, attempts, competitions, subs).select("competition_id", F.col("attempt_id").alias("_best"))
    last = listings.last_submitted(subs, now).select("competition_id", F.col("attempt_id").alias("_last"))
    scores = attempts.select("attempt_id", "cv_score", "cv_fold_var", "fold_scores")
    cand = scores.select(F.col("attempt_id").alias("_best"), F.col("cv_score").alias("_c"), F.col("cv_fold_var").alias("_cv"), F.col("fold_scores").alias("_cf"))
    base = scores.select(F.col("attempt_id").alias("_last"), F.col("cv_score").alias("_b"), F.col("fold_scores").alias("_bf"))
    duel = best.join(last, "competition_id", "left").join(cand, "_best", "left").join(base, "_last", "left")
    rows = state.join(backlog, "competition_id", "left").join(duel, "competition_id", "left")
    gain = F.col("metric_sign") * (F.col("_c") - F.col("_b"))
    significant = F.col("_c").isNull() | F.col("_b").isNull() | rules.is_significant(F.col("_cf"), F.col("_bf"), gain, F.col("_cv"), F.col("metric_sign"))
    paused = F.col("auto_submit_paused_reason")
    reason = (
        F.when(paused != "", F.concat(F.lit("auto-submit paused: "), paused))
        .when(F.col("budget") <= 0, "daily budget spent")
        .when(F.col("_next").isNotNull(), "submit")
        .when(F.col("_best").isNull(), "no confirmed pipeline")
        .when(F.col("_last") == F.col("_best"), "best unchanged")
        .when(F.col("_last").isNotNull() & ~significant, "gain not significant")
        .otherwise("submit")
    )
    rows = rows.withColumn("decision", reason).filter(F.coalesce(F.col("place"), F.lit(1)) <= F.greatest(F.col("budget"), F.lit(1)))
    attempt = F.when(F.col("decision") == "submit", F.coalesce("_next", "_best"))
    return rows.select("competition_id", "decision", attempt.alias("attempt_id")).distinct()


def backfill_percentiles(subs: DataFrame, board: DataFrame, competitions: DataFrame) -> DataFrame:
    """Percentiles of complete submissions wherever their competition has a leaderboard."""
    new = views.lb_percentile(subs, board, competitions).select("submission_id", F.col("lb_percentile").alias("_p"))
    return subs.join(new, "submission_id", "left").withColumn("lb_percentile", F.coalesce("_p", "lb_percentile")).drop("_p")


# --- queue and tuning ----------------------------------------------------------------------------------------------------


def slug(name: Column) -> Column:
    return F.split_part(name, F.lit("-"), F.lit(3))


def plan_refill(queue: DataFrame, attempts: DataFrame, competitions: DataFrame, now: Column) -> DataFrame:
    """Idle active competitions to enqueue again, but only while nothing is pending or running."""
    busy = queue.agg(F.bool_or(F.col("status").isin("pending", "running"))).scalar()
    active = competitions.filter("is_active").select("competition_id", slug(F.col("name")).alias("competition"))
    rows = active.join(summaries.last_run(attempts), "competition_id", "left")
    rows = rows.join(summaries.last_queue(queue).select("competition", "queue_status"), "competition", "left")
    hours = F.when(F.col("queue_status") == "done", 0).otherwise(6)
    idle = F.col("last_run_ts").isNull() | (rules.seconds_between(F.col("last_run_ts"), now) > hours * 3600)
    out = rows.filter(~F.coalesce(busy, F.lit(False)) & idle)
    return out.select("competition_id", "competition", F.lit("reflexion").alias("stage"), F.lit(20).alias("n_cycles"), F.lit("pending").alias("status"))


def plan_tuning(competitions: DataFrame, pipelines: DataFrame, tunes: DataFrame, now: Column) -> DataFrame:
    """Active competitions with a valid pipeline whose last tuning is more than 48 hours ago, and how tuning went lately.

    ``after_promotion`` tells whether a new promotion would start a tuning run: not after five runs without gain.
    """
    active = competitions.filter("is_active").select("competition_id")
    valid = pipelines.filter("invalid_reason IS NULL").select("competition_id")
    rows = active.join(valid, "competition_id", "left_semi")
    lane = tunes.groupBy("competition_id").agg(F.max("created_at").alias("last_tune_at"))
    rows = rows.join(lane, "competition_id", "left").join(summaries.recent_tunes_failed(tunes), "competition_id", "left")
    due = F.col("last_tune_at").isNull() | (rules.seconds_between(F.col("last_tune_at"), now) > 48 * 3600)
    return rows.select("competition_id", "last_tune_at", due.alias("due"), (~F.coalesce("all_failed", F.lit(False))).alias("after_promotion"))


# --- health and attention --------------------------------------------------------------------------------------------------


def reflexion_health(
    competitions: DataFrame, attempts: DataFrame, lessons: DataFrame, bandit: DataFrame
) -> DataFrame:
    """Four traffic lights per competition: lessons taking effect, belief, repeated errors, breadth of actions.

    ``attempts`` carries error signatures.
    """
    from ..operators import prefix

    reflexion = attempts.filter("stage = 'reflexion'").select("competition_id", "label", "run_ts", "attempt_id")
    last10 = prefix.newest_per_key(reflexion, ["competition_id"], summaries.newest_first(), 10)
    jumps = last10.groupBy("competition_id").agg(F.count_if(F.col("label") == "jump").alias("jumps_last10"))
    funnel = views.lesson_funnel(lessons, attempts).select("competition_id", "cite_rate", "retrieved_precise")
    belief = views.bandit_health(views.bandit_calibration(bandit, attempts)).withColumnRenamed("scope_key", "competition_id")
    pits = views.error_recurrence(attempts, lessons).filter("pitfall_active").groupBy("competition_id").agg(
        F.try_divide(F.sum("occurrences_after_active"), F.sum("total")).alias("repeat_rate")
    )
    stuck = summaries.stagnation(attempts).select("competition_id", "is_stagnant", (F.lit(len(K.ACTION_TYPES)) - F.size("underused_actions")).alias("_cover"))
    rows = competitions.select("competition_id")
    for part in (funnel, jumps, belief, pits, summaries.error_slope(attempts).drop("n"), stuck):
        rows = rows.join(part, "competition_id", "left")
    rows = rows.fillna({
        "cite_rate": 0.0, "retrieved_precise": False, "jumps_last10": 0, "posterior_spread": 0.0, "calibration_gap": 0.0, "repeat_rate": 0.0,
        "error_rate_slope": 0, "is_stagnant": False,
    }).withColumn("action_coverage", F.coalesce("_cover", F.lit(len(K.ACTION_TYPES))))
    c = F.col
    return rows.select(
        "competition_id", "cite_rate", "jumps_last10", "posterior_spread", "calibration_gap", "error_rate_slope", "repeat_rate", "action_coverage", "is_stagnant",
        rules.traffic_light((c("cite_rate") >= K.CITE_RATE_GOOD) & (c("jumps_last10") >= 1), (c("cite_rate") < K.CITE_RATE_BAD) | ((c("jumps_last10") == 0) & c("is_stagnant"))).alias("accumulation"),
        rules.traffic_light((c("posterior_spread") >= K.SPREAD_GOOD) & (c("calibration_gap") <= K.CALIBRATION_GOOD), (c("posterior_spread") < K.SPREAD_BAD) | (c("calibration_gap") > K.CALIBRATION_BAD)).alias("bandit"),
        rules.traffic_light((c("error_rate_slope") < 0) & (c("repeat_rate") <= K.REPEAT_RATE_GOOD), c("repeat_rate") > K.REPEAT_RATE_BAD).alias("antipattern"),
        rules.traffic_light(c("action_coverage") >= K.COVERAGE_GOOD, c("is_stagnant") & (c("action_coverage") <= K.COVERAGE_BAD)).alias("exploration"),
    )


def fleet_overview(
    competitions: DataFrame, queue: DataFrame, pipelines: DataFrame, attempts: DataFrame, subs: DataFrame, board: DataFrame, now: Column, subs_now: Column
) -> DataFrame:
    """One row per competition with its queue, pipelines, recent activity, pause and leaderboard state."""
    lb = subs.filter("status = 'complete' AND lb_score IS NOT NULL").groupBy("competition_id").agg(F.max("submitted_at").alias("_lb_at"))
    rows = competitions.select("competition_id", "name", "is_active", "auto_submit_paused_reason").withColumn("competition", slug(F.col("name")))
    rows = rows.join(summaries.last_queue(queue).drop("created_at"), "competition", "left").drop("competition")
    gap = views.lb_gap_to_p90(board, subs, competitions).select("competition_id", "gap_to_p90")
    for part in (summaries.confirmed_counts(pipelines), summaries.recent_activity(attempts, now), lb, gap):
        rows = rows.join(part, "competition_id", "left")
    return rows.withColumn("days_since_lb", rules.seconds_between(F.col("_lb_at"), subs_now) / 86400.0).drop("_lb_at")


def attention(fleet: DataFrame) -> DataFrame:
    """Red, amber or green per competition and its sort position."""
    def n(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    stale = F.col("days_since_lb").isNull() | (F.col("days_since_lb") > K.STALE_DAYS)
    light = (
        F.when(F.col("auto_submit_paused_reason") != "", "red")
        .when((n("attempts_14d") > 0) & (F.try_divide(n("errors_14d"), n("attempts_14d")) > K.ERROR_SHARE_RED), "red")
        .when((n("confirmed") == 0) & (n("quarantined") > 0), "red")
        .when(n("confirmed") == 0, "amber")
        .when(F.col("is_active") & stale, "amber")
        .when(F.col("queue_status") == "pending", "amber")
        .when(n("jumps_14d") == 0, "amber")
        .otherwise("green")
    )
    order = F.create_map(*[F.lit(x) for kv in K.ATTENTION_ORDER.items() for x in kv])
    return fleet.withColumn("attention", light).withColumn("attention_rank", order[F.col("attention")])
