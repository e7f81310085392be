"""Queries over filters, listings and rankings."""

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import listings as L, prefix, summaries as S, training as T, views
from . import query
from .aggregates import CONFIRMED
from .shared import EVENTS_NOW, ORDERS_NOW, at, r
from .views import PROGRESS

GENERAL = "(competition_id = 3 OR generality IN ('L2_class', 'L3_general'))"


@query("flt_dynamic", f"""SELECT p.attempt_id, p.competition_id, p.attempt_no, p.run_ts, p.best_so_far, a.super_cycle_id, a.error_trace IS NOT NULL AS has_error
 FROM ({PROGRESS}) AS p JOIN attempts a USING (attempt_id) WHERE p.competition_id = 7 AND p.stage = 'reflexion' AND a.error_trace IS NULL
 ORDER BY p.run_ts DESC, attempt_id DESC LIMIT 500""")
def _(t):
    progress = views.score_progression(t.attempts, t.competitions)
    out = L.attempts_query(progress, t.attempts, competition=7, stage="reflexion", has_error=False, limit=900)
    return out.select("attempt_id", "competition_id", "attempt_no", "run_ts", "best_so_far", "super_cycle_id", "has_error")


@query("flt_lessons", f"""SELECT reflection_id, competition_id, generality, lesson_type, coalesce(times_applied, 0) AS times_applied, coalesce(avg_gain, 0) AS avg_gain
 FROM lessons LEFT JOIN impact USING (reflection_id) WHERE NOT archived AND {GENERAL} AND lesson_type = 'avoid' ORDER BY coalesce(avg_gain, 0) DESC, reflection_id LIMIT 50""")
def _(t):
    rows = views.with_impact(t.lessons, t.impact)
    out = L.lessons_query(rows, competition=3, lesson_type="avoid", sort="avg_gain")
    return out.select("reflection_id", "competition_id", "generality", "lesson_type", "times_applied", "avg_gain")


@query("flt_confirmed", f"SELECT pipeline_id, competition_id, cv_score FROM pipelines WHERE {CONFIRMED}")
def _(t):
    return S.confirmed(t.pipelines).select("pipeline_id", "competition_id", "cv_score")


SUBMITTABLE = """SELECT p.pipeline_id, p.attempt_id, a.competition_id, a.run_ts, a.cv_score, a.error_trace, p.invalid_reason,
 p.materialized_code IS NOT NULL OR p.materialized_origin IS NULL AS usable, p.materialized_code IS NOT NULL AS snap,
 lag(p.materialized_code IS NOT NULL OR p.materialized_origin IS NULL) OVER w AS prev_usable, lag(p.materialized_code IS NOT NULL) OVER w AS prev_snap
 FROM pipelines p JOIN attempts a USING (attempt_id) WINDOW w AS (PARTITION BY a.competition_id ORDER BY a.run_ts, p.pipeline_id)"""


@query("flt_submittable", f"""SELECT pipeline_id, competition_id, coalesce(prev_snap, true) AS prior_snapshot FROM ({SUBMITTABLE}) AS s
 WHERE usable AND coalesce(prev_usable, true)""")
def _(t):
    return L.submittable(t.pipelines, t.attempts).select("pipeline_id", "competition_id", "prior_snapshot")


@query("flt_tristate", "SELECT attempt_id, CAST(was_promoted AS VARCHAR) AS was_promoted FROM attempts WHERE was_promoted IS NOT FALSE")
def _(t):
    return t.attempts.filter(rules.is_not_false(F.col("was_promoted"))).select("attempt_id", F.col("was_promoted").cast("string").alias("was_promoted"))


@query("flt_like", """SELECT attempt_id, error_trace LIKE '%rc=-9%' AS oom, starts_with(error_trace, 'cpu budget exceeded') AS cpu FROM attempts
 WHERE error_trace LIKE '%rc=-9%' OR error_trace LIKE 'cpu budget exceeded%'""")
def _(t):
    both = L.error_like(t.attempts, "%rc=-9%").unionByName(L.error_like(t.attempts, "cpu budget exceeded%"))
    trace = F.col("error_trace")
    return both.select("attempt_id", trace.contains("rc=-9").alias("oom"), trace.startswith("cpu budget exceeded").alias("cpu"))


@query("flt_keys", """SELECT attempt_id, competition_id FROM attempts WHERE competition_id IN (SELECT competition_id FROM competitions WHERE is_active)""")
def _(t):
    return L.in_keys(t.attempts.select("attempt_id", "competition_id"), t.competitions.filter("is_active").select("competition_id"))


@query("flt_lists", """SELECT 'queue' AS page, queue_id AS id, row_number() OVER (ORDER BY priority DESC, created_at, queue_id) AS place FROM queue
 QUALIFY place <= 50 UNION ALL SELECT 'subs', submission_id, row_number() OVER (ORDER BY submitted_at DESC, submission_id DESC) AS place FROM subs QUALIFY place <= 50
 UNION ALL SELECT 'recent', attempt_id, row_number() OVER (ORDER BY run_ts DESC, attempt_id DESC) AS place FROM attempts QUALIFY place <= 20""")
def _(t):
    from pyspark.sql import Window as W

    def numbered(df, name, key, order, n):
        top = df.orderBy(*order).limit(n)
        place = F.row_number().over(W.orderBy(*order)).cast("long").alias("place")
        return top.select(F.lit(name).alias("page"), F.col(key).alias("id"), place)

    queue = numbered(t.queue, "queue", "queue_id", [F.col("priority").desc(), "created_at", "queue_id"], 50)
    subs = numbered(L.list_submissions(t.subs), "subs", "submission_id", [F.col("submitted_at").desc(), F.col("submission_id").desc()], 50)
    recent = numbered(t.attempts, "recent", "attempt_id", [F.col("run_ts").desc(), F.col("attempt_id").desc()], 20)
    return queue.unionByName(subs).unionByName(recent)


@query("top_latest_per_key", """SELECT competition_id, arg_max(submission_id, (submitted_at, submission_id)) AS submission_id, max(submitted_at) AS submitted_at,
 arg_max(status, (submitted_at, submission_id)) AS status FROM subs GROUP BY 1""")
def _(t):
    return L.latest_per_key(t.subs.select("competition_id", "submission_id", "submitted_at", "status"), "competition_id", ["submitted_at", "submission_id"])


@query("top_best_attempts", """SELECT competition_id, attempt_id, cv_score, code_path, place FROM (SELECT *, row_number() OVER (PARTITION BY competition_id
 ORDER BY metric_sign * cv_score DESC, attempt_id) AS place FROM attempts JOIN competitions USING (competition_id)
 WHERE cv_score IS NOT NULL AND error_trace IS NULL AND code_path IS NOT NULL) WHERE place <= 3""")
def _(t):
    out = L.top_attempts(t.attempts, t.competitions, 3).withColumn("place", F.col("place").cast("long"))
    return out.select("competition_id", "attempt_id", "cv_score", "code_path", "place")


CANDIDATES = f"""SELECT s.*, metric_sign * cv_score AS score FROM ({SUBMITTABLE}) AS s JOIN competitions USING (competition_id)
 WHERE usable AND coalesce(prev_usable, true) AND cv_score IS NOT NULL AND error_trace IS NULL AND invalid_reason IS NULL"""
BEST = f"""SELECT competition_id, attempt_id, cv_score FROM (SELECT *, row_number() OVER (PARTITION BY competition_id ORDER BY score DESC, run_ts, attempt_id) AS place
 FROM ({CANDIDATES}) AS c WHERE attempt_id NOT IN (SELECT attempt_id FROM subs WHERE status = 'complete' AND attempt_id IS NOT NULL)) WHERE place = 1"""
UNSUBMITTED = f"""SELECT competition_id, attempt_id, cv_score, prior_snapshot, place FROM (SELECT *, coalesce(prev_snap, true) AS prior_snapshot, row_number() OVER
 (PARTITION BY competition_id ORDER BY coalesce(prev_snap, true) DESC, score DESC, run_ts, attempt_id) AS place
 FROM ({CANDIDATES}) AS c WHERE attempt_id NOT IN (SELECT attempt_id FROM subs WHERE attempt_id IS NOT NULL)) WHERE place <= 5"""
LAST_SUBMITTED = f"""SELECT competition_id, arg_max(attempt_id, (submitted_at, submission_id)) AS attempt_id FROM subs WHERE attempt_id IS NOT NULL
 AND status NOT IN ('error', 'invalid', 'timeout') AND NOT coalesce(status = 'submitted' AND checked_at < TIMESTAMP '{ORDERS_NOW}' - INTERVAL 1 HOUR, false) GROUP BY 1"""


@query("top_best_submittable", BEST)
def _(t):
    return L.best_submittable(t.pipelines, t.attempts, t.competitions, t.subs)


@query("top_unsubmitted", UNSUBMITTED)
def _(t):
    out = L.unsubmitted_confirmed(t.pipelines, t.attempts, t.competitions, t.subs)
    return out.withColumn("place", F.col("place").cast("long"))


@query("top_last_submitted", LAST_SUBMITTED)
def _(t):
    return L.last_submitted(t.subs, at(ORDERS_NOW))


WINNER = """SELECT super_cycle_id, attempt_id FROM (SELECT *, row_number() OVER (PARTITION BY super_cycle_id
 ORDER BY gain_vs_best IS NULL, gain_vs_best DESC, run_ts, attempt_id) AS place FROM attempts WHERE gain_vs_best IS NOT NULL OR cv_score IS NOT NULL) WHERE place = 1"""


@query("top_winner", WINNER)
def _(t):
    return L.pick_winner(t.attempts)


@query("top_queue_order", """SELECT queue_id, competition, priority, row_number() OVER (PARTITION BY priority ORDER BY coalesce(last_leased_at, created_at), queue_id) AS place
 FROM queue WHERE status = 'pending'""")
def _(t):
    pending = L.next_pending(t.queue).withColumn("turn", F.coalesce("last_leased_at", "created_at"))
    sliced = prefix.with_slice(pending, ["priority"], prefix.time_position("turn"))
    out = prefix.running(sliced, ["priority"], [F.col("turn"), F.col("queue_id")], {"place": ("count", F.lit(1))})
    return out.select("queue_id", "competition", "priority", "place")


@query("top_latest_tuned", """WITH l AS (SELECT competition_id, arg_max(tuning_run_id, (created_at, tuning_run_id)) AS tuning_run_id FROM tunes GROUP BY 1),
 x AS (SELECT t.*, bool_or(improved) OVER (PARTITION BY competition_id) AS good FROM tunes t JOIN l USING (competition_id, tuning_run_id))
 SELECT competition_id, tuning_run_id, model_type, coalesce(member_index, 0) AS member_index, cv_score, improved FROM x WHERE good""")
def _(t):
    out = L.latest_tuned(t.tunes).fillna({"member_index": 0})
    return out.select("competition_id", "tuning_run_id", "model_type", "member_index", "cv_score", "improved")


@query("top_impact", f"""SELECT reflection_id, competition_id, generality, times_applied, avg_gain, jumps, best_jump FROM impact JOIN lessons USING (reflection_id)
 WHERE {GENERAL} ORDER BY avg_gain DESC, reflection_id LIMIT 10""")
def _(t):
    return L.top_lessons(t.impact, t.lessons, 3)


@query("top_seeds", """SELECT pipeline_id, competition_id, code, cv_score, gain_vs_best FROM pipelines WHERE gain_vs_best > 0
 AND competition_id IN (SELECT competition_id FROM competitions WHERE size_class = 'large') ORDER BY gain_vs_best DESC, pipeline_id LIMIT 2""")
def _(t):
    return L.bootstrap_seeds(t.pipelines, t.competitions.filter("size_class = 'large'"))


@query("top_cold_lessons", """SELECT reflection_id, competition_id, generality, coalesce(avg_gain, 0) AS avg_gain FROM lessons LEFT JOIN impact USING (reflection_id)
 WHERE NOT archived AND ((generality = 'L2_class' AND competition_id IN (SELECT competition_id FROM competitions WHERE size_class = 'large')) OR generality = 'L3_general')
 ORDER BY coalesce(avg_gain, 0) DESC, reflection_id LIMIT 10""")
def _(t):
    return L.cold_start_lessons(t.lessons, t.impact, t.competitions.filter("size_class = 'large'"))


@query("top_failures", f"""SELECT reflection_id, competition_id, created_at, coalesce(avg_gain, 0) AS avg_gain FROM lessons LEFT JOIN impact USING (reflection_id)
 WHERE NOT archived AND lesson_type = 'failure' AND {GENERAL} ORDER BY created_at DESC, reflection_id LIMIT 3""")
def _(t):
    return L.failure_lessons(t.lessons, t.impact, 3)


@query("top_archive", """SELECT reflection_id, generality, competition_id, times_applied, avg_gain FROM impact JOIN lessons USING (reflection_id)
 WHERE avg_gain <= 0 AND times_applied >= 3 AND NOT archived""")
def _(t):
    return L.archive_candidates(t.lessons, t.impact)


# --- projections of a training frame -------------------------------------------------------------------------------------


@query("prj_drop", "SELECT * EXCLUDE (o_orderpriority) FROM orders")
def _(t):
    return T.drop_cols(t.raw("orders"), ["o_orderpriority", "not_there"])


@query("prj_common", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    orders = t.raw("orders")
    extra = orders.select("o_orderkey", "o_totalprice", F.length("o_orderpriority").alias("extra_only"))
    return T.project_common(extra, orders)


@query("prj_flag", "SELECT o_orderkey, o_orderstatus = 'F' AS is_original FROM orders")
def _(t):
    orders = t.raw("orders").select("o_orderkey", "o_orderstatus")
    both = T.with_origin(orders.filter("o_orderstatus = 'F'"), True).unionByName(T.with_origin(orders.filter("o_orderstatus <> 'F'"), False))
    return both.drop("o_orderstatus")


@query("flt_target_present", "SELECT attempt_id, cv_score FROM attempts WHERE cv_score IS NOT NULL AND label <> 'jump'")
def _(t):
    nan = F.when(F.col("label") == "jump", F.lit(float("nan"))).otherwise(F.col("cv_score")).alias("cv_score")
    return T.target_present(t.attempts.select("attempt_id", nan), "cv_score")


@query("prj_strip_target", "SELECT * EXCLUDE (o_totalprice) FROM orders")
def _(t):
    return T.strip_target(t.raw("orders"), "o_totalprice")


@query("prj_mask_target", "SELECT o_orderkey, o_orderstatus, CAST(NULL AS DOUBLE) AS o_totalprice FROM orders")
def _(t):
    return T.mask_target(t.raw("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_totalprice")


@query("prj_dummy_target", """SELECT o_orderkey, (SELECT arg_min(o_orderstatus, o_orderkey) FROM orders WHERE o_orderpriority <> '5-LOW') AS o_orderstatus FROM orders WHERE o_orderpriority = '5-LOW'""")
def _(t):
    orders = t.raw("orders")
    test = orders.filter("o_orderpriority = '5-LOW'").select("o_orderkey")
    return T.dummy_target(test, orders.filter("o_orderpriority <> '5-LOW'"), "o_orderstatus", "o_orderkey")


@query("prj_by_dtype", """SELECT 'numeric' AS kind, 8 AS n_cols, count(l_orderkey) + count(l_partkey) + count(l_suppkey) + count(l_linenumber) + count(l_quantity) + count(l_extendedprice)
 + count(l_discount) + count(l_tax) AS filled FROM lineitem UNION ALL SELECT 'string', 2, count(l_returnflag) + count(l_linestatus) FROM lineitem UNION ALL SELECT 'temporal', 1, count(l_shipdate) FROM lineitem""")
def _(t):
    from functools import reduce

    lines = t.raw("lineitem")
    kinds = {k: T.columns_of(lines, k) for k in ("numeric", "string", "temporal")}
    parts = [
        lines.select(*cols).agg(reduce(lambda a, b: a + b, [F.count(c) for c in cols]).alias("filled")).select(F.lit(k).alias("kind"), F.lit(len(cols)).alias("n_cols"), "filled")
        for k, cols in kinds.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("prj_encode_strings", """WITH c AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus = 'F'
 AND o_orderpriority <> '3-MEDIUM')) SELECT o_orderkey, CAST(coalesce(code, -1) AS INT) AS o_orderpriority FROM orders LEFT JOIN c USING (o_orderpriority)""")
def _(t):
    orders = t.raw("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    train = orders.filter("o_orderstatus = 'F' AND o_orderpriority <> '3-MEDIUM'").drop("o_orderstatus")
    return T.encode_strings(train, orders.drop("o_orderstatus"))


@query("prj_value_map", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS status_code FROM orders""")
def _(t):
    return t.raw("orders").select("o_orderkey", T.map_values(F.col("o_orderstatus"), {"F": 2, "O": 1}, 0).alias("status_code"))
