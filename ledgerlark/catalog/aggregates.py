"""Queries over the monitoring aggregates and the window rules."""

from pyspark.sql import functions as F

from ..operators import summaries as S, training, views
from . import query
from .roles import numeric
from .shared import EVENTS_NOW, ORDERS_NOW, TUNES_NOW, at, r
from .views import COLD, LB_CALIBRATION, PROGRESS

CONFIRMED = "cv_score IS NOT NULL AND invalid_reason IS NULL AND NOT starts_with(coalesce(materialized_origin, ''), 'unverifiable:')"
NEWEST = "(PARTITION BY competition_id ORDER BY run_ts DESC, attempt_id DESC)"


@query("agg_signed_best", f"""SELECT competition_id, round(max(metric_sign * cv_score) * max(metric_sign), 6) AS best_cv FROM pipelines
 JOIN competitions USING (competition_id) WHERE {CONFIRMED} GROUP BY 1""")
def _(t):
    return r(S.best_confirmed(t.pipelines, t.competitions))


@query("agg_best_row", f"""WITH b AS (SELECT p.competition_id, p.pipeline_id, p.attempt_id, p.cv_score, a.model_type, coalesce(a.hypothesis, '') AS hypothesis,
 list_sum(coalesce(p.fold_scores, a.fold_scores)) AS fold_total, row_number() OVER (PARTITION BY p.competition_id
 ORDER BY metric_sign * p.cv_score DESC, p.pipeline_id) AS rn FROM (SELECT * FROM pipelines WHERE {CONFIRMED}) p
 JOIN competitions USING (competition_id) JOIN attempts a USING (attempt_id))
 SELECT * EXCLUDE (rn) REPLACE (round(fold_total, 6) AS fold_total) FROM b WHERE rn = 1""")
def _(t):
    from ..functions import arrays

    out = S.best_row(t.pipelines, t.attempts, t.competitions)
    return r(out.fillna({"hypothesis": ""}).withColumn("fold_total", arrays.total(F.col("fold_scores"))).drop("fold_scores"))


@query("agg_gain_stats", """SELECT round(coalesce(avg(avg_gain), 0), 6) AS gain_mean, round(coalesce(stddev_pop(avg_gain), 0), 6) AS gain_std FROM impact""")
def _(t):
    return r(S.gain_stats(t.impact))


@query("agg_confirmed_counts", """SELECT competition_id, count(*) FILTER (WHERE invalid_reason IS NULL) AS confirmed,
 count(*) FILTER (WHERE invalid_reason IS NOT NULL) AS quarantined FROM pipelines GROUP BY 1""")
def _(t):
    return S.confirmed_counts(t.pipelines)


@query("agg_activity_14d", f"""SELECT competition_id, count(*) AS attempts_14d, count(*) FILTER (WHERE label = 'jump') AS jumps_14d,
 count(*) FILTER (WHERE label = 'error') AS errors_14d, count(*) FILTER (WHERE error_trace LIKE '%rc=-9%') AS oom_14d,
 max(run_ts) AS last_attempt FROM attempts WHERE run_ts > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 14 DAY GROUP BY 1""")
def _(t):
    return S.recent_activity(t.attempts, at(EVENTS_NOW))


@query("agg_tuning_lane", f"""SELECT competition_id, max(created_at) AS last_tune_at, count(*) AS n_results,
 count(*) FILTER (WHERE improved) AS n_improved, count(DISTINCT tuning_run_id) AS n_runs,
 round(epoch(TIMESTAMP '{TUNES_NOW}' - max(created_at)) / 36e2, 6) AS hours_since_last_tune FROM tunes GROUP BY 1""")
def _(t):
    return r(S.tuning_summary(t.tunes, at(TUNES_NOW)))


@query("agg_recent_distribution", f"""SELECT competition_id, action_type, count(*) AS cnt FROM (SELECT *, row_number() OVER {NEWEST} AS rn
 FROM attempts WHERE cv_score IS NOT NULL) WHERE rn <= 10 GROUP BY 1, 2""")
def _(t):
    return S.recent_actions(t.attempts)


@query("agg_recent_failures", f"""SELECT competition_id, action_type, count(*) AS cnt, max(hypothesis) AS sample_hypothesis FROM
 (SELECT *, row_number() OVER {NEWEST} AS rn FROM attempts WHERE label = 'regression' OR error_trace IS NOT NULL) WHERE rn <= 10 GROUP BY 1, 2""")
def _(t):
    return S.recent_failures(t.attempts)


FAILURES = f"""SELECT competition_id, string_agg(action_type || ': ' || coalesce(hypothesis, ''), '; ' ORDER BY rn) AS summary
 FROM (SELECT *, row_number() OVER {NEWEST} AS rn FROM attempts WHERE label = 'regression' OR error_trace IS NOT NULL) WHERE rn <= 5 GROUP BY 1"""


@query("agg_failure_summary", FAILURES)
def _(t):
    return S.failure_summary(t.attempts)


@query("top_last_hypothesis", f"""WITH h AS (SELECT competition_id, arg_max(hypothesis, (run_ts, attempt_id)) AS hypothesis FROM attempts
 WHERE hypothesis IS NOT NULL GROUP BY 1), f AS ({FAILURES}),
 q AS (SELECT competition_id, concat('card ', name) AS card, concat_ws('; ', nullif(hypothesis, ''),
 CASE WHEN summary <> '' THEN 'avoid: ' || summary END) AS q FROM competitions LEFT JOIN h USING (competition_id) LEFT JOIN f USING (competition_id))
 SELECT competition_id, coalesce(nullif(q, ''), card) AS query_text FROM q""")
def _(t):
    cards = t.competitions.select("competition_id", F.concat(F.lit("card "), "name").alias("card"))
    return S.retrieval_text(t.attempts, cards)


SINCE = """SELECT a.* FROM attempts a JOIN (SELECT b.competition_id, max(b.run_ts) AS since FROM pipelines p JOIN attempts b USING (attempt_id)
 WHERE p.cv_score IS NOT NULL AND p.invalid_reason IS NULL GROUP BY 1) s ON a.competition_id = s.competition_id AND a.run_ts > s.since"""


@query("flt_after_scalar", f"SELECT attempt_id, competition_id, run_ts FROM ({SINCE}) AS x")
def _(t):
    return S.since_last_confirmed(t.attempts.select("attempt_id", "competition_id", "run_ts"), t.pipelines)


@query("agg_tried_on_base", f"""WITH g AS (SELECT competition_id, action_type, round(gain_vs_best, 7) AS gain, count(*) AS cnt,
 arg_max(coalesce(hypothesis, ''), (run_ts, attempt_id)) AS hypothesis, max(run_ts) AS last FROM ({SINCE}) AS x
 WHERE error_trace IS NULL AND gain_vs_best IS NOT NULL GROUP BY 1, 2, 3),
 p AS (SELECT *, row_number() OVER (PARTITION BY competition_id ORDER BY cnt DESC, last DESC, action_type, gain) AS place FROM g)
 SELECT competition_id, action_type, gain, cnt, trim(regexp_replace(hypothesis, '\\s+', ' ', 'g')) AS hypothesis, place FROM p""")
def _(t):
    return S.tried_on_base(t.attempts, t.pipelines).withColumn("place", F.col("place").cast("long"))


@query("agg_recent_runs_failed", """WITH q AS (SELECT competition_id, tuning_run_id, bool_or(improved) AS good, max(created_at) AS t FROM tunes GROUP BY 1, 2),
 n AS (SELECT *, row_number() OVER (PARTITION BY competition_id ORDER BY t DESC, tuning_run_id DESC) AS rn FROM q)
 SELECT competition_id, count(*) AS runs, count(*) = 5 AND NOT bool_or(good) AS all_failed FROM n WHERE rn <= 5 GROUP BY 1""")
def _(t):
    return S.recent_tunes_failed(t.tunes)


@query("agg_last_run", """SELECT competition_id, max(run_ts) AS last_run_ts FROM attempts GROUP BY 1""")
def _(t):
    return S.last_run(t.attempts)


@query("agg_last_queue", """SELECT competition, arg_max(status, (created_at, queue_id)) AS queue_status, arg_max(n_cycles, (created_at, queue_id)) AS n_cycles,
 arg_max(cycles_done, (created_at, queue_id)) AS cycles_done, max(created_at) AS created_at FROM queue GROUP BY 1""")
def _(t):
    return S.last_queue(t.queue)


@query("agg_gate_counts", f"""SELECT super_cycle_id, count(*) FILTER (WHERE cv_score IS NOT NULL AND NOT coalesce(futility_early_exit, false)) AS n_success,
 count(*) FILTER (WHERE cv_score IS NOT NULL OR error_trace IS NOT NULL) AS n_done,
 round(epoch(TIMESTAMP '{EVENTS_NOW}' - min(run_ts) FILTER (WHERE NOT coalesce(futility_early_exit, false))), 6) AS span_sec FROM attempts GROUP BY 1""")
def _(t):
    return r(S.gate_counts(t.attempts, at(EVENTS_NOW)))


@query("agg_window_counts", f"""SELECT count(*) FILTER (WHERE run_ts >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 5 HOUR) AS session_count,
 count(*) FILTER (WHERE run_ts >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 7 DAY) AS week_count FROM attempts""")
def _(t):
    return S.pacing_counts(t.attempts, at(EVENTS_NOW))


@query("agg_submissions_today", """SELECT competition_id, count(*) AS n_today FROM subs
 WHERE submitted_at >= TIMESTAMP '2001-08-01 00:00:00' AND status <> 'error' GROUP BY 1""")
def _(t):
    return S.submissions_today(t.subs, at("2001-08-01 15:00:00"))


@query("agg_value_counts", """SELECT 'action_type' AS field, action_type AS item, count(*) AS cnt FROM attempts GROUP BY 2
 UNION ALL SELECT 'label', label, count(*) FROM attempts GROUP BY 2""")
def _(t):
    parts = [S.value_counts(t.attempts, c).select(F.lit(c).alias("field"), F.col(c).alias("item"), "cnt") for c in ("action_type", "label")]
    return parts[0].unionByName(parts[1])


@query("agg_pivot_progress", f"""WITH p AS (SELECT attempt_no, stage, best_so_far FROM ({COLD}) AS c)
 SELECT attempt_no, {", ".join(f"round(avg(best_so_far) FILTER (WHERE stage = '{s}'), 6) AS {s}" for s in ("bootstrap", "reflexion", "exploitation"))}
 FROM p GROUP BY 1""")
def _(t):
    from ..constants import STAGES

    progress = views.cold_start_progression(t.attempts, t.competitions).select("attempt_no", F.col("stage").alias("competition_id"), "best_so_far")
    return r(S.progress_pivot(progress, list(STAGES)))


@query("agg_pivot_transfer", """WITH m AS (SELECT l.competition_id AS s, a.competition_id % 10 AS g, count(*) AS n
 FROM (SELECT competition_id, unnest(reflection_ids) AS rid FROM attempts) a JOIN lessons l ON l.reflection_id = a.rid GROUP BY 1, 2)
 SELECT s AS source_comp, """ + ", ".join(f'CAST(coalesce(sum(n) FILTER (WHERE g = {i}), 0) AS BIGINT) AS "{i}"' for i in range(10)) + " FROM m GROUP BY 1")
def _(t):
    matrix = views.transfer_matrix(t.attempts, t.lessons).withColumn("target_comp", F.col("target_comp") % 10)
    return S.transfer_pivot(matrix, list(range(10)))


@query("agg_warm_start", f"""WITH s AS (SELECT competition_id, name, round(max(CASE WHEN stage = 'bootstrap' THEN best_so_far END), 5) AS bootstrap_best,
 round(max(best_so_far), 5) AS overall_best FROM ({COLD}) AS c JOIN competitions USING (competition_id) GROUP BY 1, 2)
 SELECT *, CASE WHEN overall_best <> 0 THEN {numeric('bootstrap_best / overall_best', 4)} END AS warm_start_ratio FROM s""")
def _(t):
    return S.warm_start(views.cold_start_progression(t.attempts, t.competitions), t.competitions)


@query("agg_holdout_summary", """SELECT competition_id, count(*) AS n, round(avg(cv_score - holdout_score), 6) AS avg_gap FROM attempts
 WHERE holdout_score IS NOT NULL AND cv_score IS NOT NULL GROUP BY 1""")
def _(t):
    return r(S.holdout_summary(t.attempts))


@query("agg_dup_compute", """WITH n AS (SELECT competition_id, peak_cpu_sec, row_number() OVER (PARTITION BY competition_id, fold_scores ORDER BY run_ts, attempt_id) AS nth
 FROM attempts WHERE fold_scores IS NOT NULL)
 SELECT competition_id, count(*) AS repeats, round(sum(peak_cpu_sec) / 36e2, 6) AS cpu_hours FROM n WHERE nth > 1 GROUP BY 1""")
def _(t):
    return r(S.duplicate_compute(t.attempts))


@query("agg_dup_gain", """WITH n AS (SELECT competition_id, row_number() OVER (PARTITION BY competition_id, round(gain_vs_best, 7) ORDER BY run_ts, attempt_id) AS nth
 FROM attempts WHERE stage = 'reflexion' AND error_trace IS NULL AND gain_vs_best IS NOT NULL)
 SELECT competition_id, count(*) AS n, count(*) FILTER (WHERE nth > 1) AS repeats FROM n GROUP BY 1""")
def _(t):
    return S.duplicate_gain(t.attempts)


@query("agg_kill_stage", f"""SELECT nullif(regexp_extract(error_trace, '\\[last_progress\\] stage=(\\S+)( fold=\\d+/\\d+)?', 1), '') AS stage,
 nullif(regexp_extract(error_trace, '\\[last_progress\\] stage=\\S+ (fold=\\d+/\\d+)', 1), '') AS fold, count(*) AS n,
 {numeric('sum(peak_cpu_sec) / 36e2', 1)} AS cpu_h FROM attempts WHERE error_trace LIKE 'cpu budget exceeded%'
 AND error_trace LIKE '%[last_progress]%' GROUP BY 1, 2""")
def _(t):
    return S.kill_stages(t.attempts)


@query("agg_tie_rates", """SELECT action_type, count(*) FILTER (WHERE gain_vs_best = 0) AS exact_tie, count(*) FILTER (WHERE gain_vs_best <> 0
 AND abs(gain_vs_best) <= greatest(1e-6, 1e-6 * abs(cv_score))) AS near_tie, count(*) AS n FROM attempts
 WHERE stage = 'reflexion' AND error_trace IS NULL AND gain_vs_best IS NOT NULL GROUP BY 1""")
def _(t):
    return S.tie_rates(t.attempts)


@query("agg_futility_rate", """SELECT action_type, count(*) AS n, count(*) FILTER (WHERE coalesce(futility_early_exit, false)) AS futile FROM attempts GROUP BY 1""")
def _(t):
    return S.futility_rate(t.attempts)


@query("agg_futility_audit", """WITH base AS (SELECT a.competition_id, a.run_ts, a.attempt_id, coalesce(p.fold_scores, a.fold_scores) AS f FROM pipelines p
 JOIN attempts a USING (attempt_id) WHERE p.cv_score IS NOT NULL AND p.invalid_reason IS NULL),
 d AS (SELECT a.competition_id, a.attempt_id, any_value(a.label) AS label, any_value(a.gain_vs_best) AS g, any_value(a.fold_scores) AS f,
 arg_max({'f': b.f}, (b.run_ts, b.attempt_id)).f AS bf FROM attempts a JOIN base b ON b.competition_id = a.competition_id AND b.run_ts < a.run_ts
 WHERE a.fold_scores IS NOT NULL AND NOT coalesce(a.futility_early_exit, false) GROUP BY 1, 2)
 SELECT competition_id, count(*) AS audited, count(*) FILTER (WHERE g > 1e-4 OR label = 'jump') AS false_stops FROM d JOIN competitions USING (competition_id)
 WHERE metric_sign * (f[1] - bf[1]) < -75e-2 * list_stddev_pop(bf) GROUP BY 1""")
def _(t):
    return S.futility_audit(t.attempts, t.pipelines, t.competitions)


@query("agg_fold_stats", """SELECT attempt_id, round(list_avg(fold_scores), 6) AS fold_mean, round(list_var_pop(fold_scores), 6) AS fold_var,
 round(list_stddev_pop(fold_scores), 6) AS fold_std FROM attempts""")
def _(t):
    return r(S.fold_stats(t.attempts))


@query("agg_fold_se", """SELECT attempt_id, round(coalesce(CASE WHEN len(fold_scores) > 1 THEN list_stddev_samp(fold_scores) / sqrt(len(fold_scores)) END, 0), 6) AS fold_se FROM attempts""")
def _(t):
    return r(S.fold_se(t.attempts))


@query("win_stagnation", f"""WITH u AS (SELECT competition_id, list(DISTINCT action_type) AS used FROM (SELECT *, row_number() OVER {NEWEST} AS rn FROM attempts)
 WHERE rn <= 15 GROUP BY 1), w AS (SELECT competition_id, count(*) AS n, count(*) FILTER (WHERE label = 'jump') AS j, min(rn) FILTER (WHERE label = 'jump') AS f
 FROM (SELECT *, row_number() OVER {NEWEST} AS rn FROM attempts WHERE was_promoted) WHERE rn <= 5 GROUP BY 1)
 SELECT competition_id, coalesce(j, 0) AS jumps_in_window, coalesce(f - 1, n, 0) AS stagnant_for, coalesce(f - 1, n, 0) >= 3 AS is_stagnant,
 array_to_string(list_filter(['feature_engineering', 'preprocessing', 'model_swap', 'hyperparam_search', 'ensemble'], lambda a: NOT list_contains(used, a)), ',') AS underused_actions
 FROM u LEFT JOIN w USING (competition_id)""")
def _(t):
    return S.stagnation(t.attempts).withColumn("underused_actions", F.array_join("underused_actions", ","))


@query("set_difference", f"""SELECT competition_id, array_to_string(list_filter(['feature_engineering', 'preprocessing', 'model_swap', 'hyperparam_search', 'ensemble'],
 lambda a: NOT list_contains(used, a)), ',') AS unused FROM (SELECT competition_id, list(DISTINCT action_type) AS used FROM
 (SELECT *, row_number() OVER {NEWEST} AS rn FROM attempts) WHERE rn <= 15 GROUP BY 1)""")
def _(t):
    return S.stagnation(t.attempts).select("competition_id", F.array_join("underused_actions", ",").alias("unused"))


@query("win_error_slope", f"""WITH x AS (SELECT competition_id, (label = 'error')::INT AS e, rn, count(*) OVER (PARTITION BY competition_id) AS n FROM
 (SELECT *, row_number() OVER {NEWEST} AS rn FROM attempts WHERE stage = 'reflexion') WHERE rn <= 200)
 SELECT competition_id, n, CASE WHEN n < 20 THEN 0 ELSE sign(avg(e) FILTER (WHERE rn <= n // 2) - avg(e) FILTER (WHERE rn > n // 2))::INT END AS error_rate_slope
 FROM x GROUP BY 1, 2""")
def _(t):
    return S.error_slope(t.attempts)


@query("win_fold1_dedup", f"""SELECT competition_id, fold_scores[1] AS fold1, arg_min(attempt_id, rn) AS attempt_id, round(arg_min(list_sum(fold_scores), rn), 6) AS fold_total
 FROM (SELECT *, row_number() OVER {NEWEST} AS rn FROM attempts WHERE len(fold_scores) = 5) GROUP BY 1, 2""")
def _(t):
    from ..functions import arrays

    out = S.fold1_cache(t.attempts)
    return out.withColumn("fold_total", F.round(arrays.total(F.col("fold_scores")), 6)).drop("fold_scores")


@query("win_over_mean", """SELECT attempt_id, action_type, cv_score, round(avg(cv_score) OVER (PARTITION BY action_type), 6) AS action_mean FROM attempts""")
def _(t):
    out = S.over_mean(t.attempts.select("attempt_id", "action_type", "cv_score"), "action_type", "cv_score", "action_mean")
    return out.withColumn("action_mean", F.round("action_mean", 6))


@query("dc_tune_status", f"""WITH q AS (SELECT competition_id, epoch(TIMESTAMP '{TUNES_NOW}' - max(created_at)) / 36e2 AS h FROM tunes GROUP BY 1)
 SELECT competition_id, CASE WHEN h IS NULL THEN 'never' WHEN h > 48 THEN 'stale' ELSE 'ok' END AS tune_status FROM competitions LEFT JOIN q USING (competition_id)""")
def _(t):
    lane = S.tuning_summary(t.tunes, at(TUNES_NOW))
    out = t.competitions.select("competition_id").join(lane, "competition_id", "left")
    return out.select("competition_id", S.tune_status(F.col("hours_since_last_tune")).alias("tune_status"))


# --- column profiles of a training frame -------------------------------------------------------------------------------


@query("agg_null_profile", """SELECT 'checked_at' AS field, count(*) FILTER (WHERE checked_at IS NULL) AS nulls, round(count(*) FILTER (WHERE checked_at IS NULL) / count(*), 6) AS share FROM subs
 UNION ALL SELECT 'attempt_id', count(*) FILTER (WHERE attempt_id IS NULL), round(count(*) FILTER (WHERE attempt_id IS NULL) / count(*), 6) FROM subs
 UNION ALL SELECT 'lb_score', count(*) FILTER (WHERE lb_score IS NULL), round(count(*) FILTER (WHERE lb_score IS NULL) / count(*), 6) FROM subs
 UNION ALL SELECT 'message', count(*) FILTER (WHERE message IS NULL), round(count(*) FILTER (WHERE message IS NULL) / count(*), 6) FROM subs""")
def _(t):
    return r(training.null_profile(t.subs.select("checked_at", "attempt_id", "lb_score", "message")))


@query("agg_cardinality", """SELECT greatest(a, b, c) AS cardinality_max, round((a + b + c) / 3, 6) AS cardinality_mean FROM (SELECT
 count(DISTINCT o_orderstatus) + max(CASE WHEN o_orderstatus IS NULL THEN 1 ELSE 0 END) AS a,
 count(DISTINCT o_orderpriority) + max(CASE WHEN o_orderpriority IS NULL THEN 1 ELSE 0 END) AS b,
 count(DISTINCT note) + max(CASE WHEN note IS NULL THEN 1 ELSE 0 END) AS c
 FROM (SELECT *, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_custkey AS VARCHAR) END AS note FROM orders))""")
def _(t):
    orders = t.raw("orders").withColumn("note", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey").cast("string")))
    return r(training.cardinality(orders))


@query("agg_textish", """SELECT CAST((avg(length(text)) > 20)::INT + (avg(length(lang)) > 20)::INT + (avg(length(source)) > 20)::INT AS BIGINT) AS n_text_ish FROM documents""")
def _(t):
    return training.n_text_ish(t.raw("documents"))


@query("agg_target_stat", """WITH m AS (SELECT avg(o_totalprice) AS mu, stddev_pop(o_totalprice) AS sd FROM orders)
 SELECT round((SELECT min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)) / (SELECT count(*) FROM orders), 6) AS minority,
 round((SELECT avg(pow((o_totalprice - mu) / sd, 3)) FROM orders, m), 6) AS skew""")
def _(t):
    orders = t.raw("orders")
    minority = training.target_stat(orders, "o_orderstatus", "multiclass").select(F.round("target_stat", 6).alias("minority"))
    skew = training.target_stat(orders, "o_totalprice", "regression").select(F.round("target_stat", 6).alias("skew"))
    return orders.sparkSession.range(1).select(minority.scalar().alias("minority"), skew.scalar().alias("skew"))


@query("agg_fingerprint", """WITH m AS (SELECT avg(l_extendedprice) AS mu, stddev_pop(l_extendedprice) AS sd, count(*) AS n FROM lineitem)
 SELECT n AS n_rows, 10 AS n_cols, 'regression' AS task_type, 'rmse' AS metric, -1 AS metric_sign, 7 AS n_numeric, 2 AS n_categorical, 1 AS n_datetime,
 0 AS n_text_ish, round((SELECT count(*) FILTER (WHERE l_orderkey IS NULL OR l_tax IS NULL) FROM lineitem) / n, 6) AS missing_ratio_overall,
 greatest((SELECT count(DISTINCT l_returnflag) FROM lineitem), (SELECT count(DISTINCT l_linestatus) FROM lineitem)) AS cardinality_max,
 round(((SELECT count(DISTINCT l_returnflag) FROM lineitem) + (SELECT count(DISTINCT l_linestatus) FROM lineitem)) / 2, 2) AS cardinality_mean,
 round((SELECT avg(pow((l_extendedprice - mu) / sd, 3)) FROM lineitem), 6) AS target_stat,
 CASE WHEN n < 10000 THEN 'tiny' WHEN n < 100000 THEN 'small' WHEN n < 1000000 THEN 'mid' ELSE 'large' END AS size_class FROM m""")
def _(t):
    return training.fingerprint(t.raw("lineitem"), "l_extendedprice", "regression", "rmse", -1)
