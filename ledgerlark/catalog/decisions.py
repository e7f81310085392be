"""Queries over promotion, guards, fleet decisions and health."""

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import arrays, draws, rules
from ..operators import listings as L, summaries as S, views
from ..plans import fleet, promotion as P
from . import query
from .aggregates import CONFIRMED, NEWEST
from .listings import BEST, LAST_SUBMITTED, UNSUBMITTED, WINNER
from .roles import signature_sql
from .shared import EVENTS_NOW, ORDERS_NOW, TUNES_NOW, at, r
from .views import CALIBRATION, FUNNEL, RECURRENCE

TIE = "coalesce(abs(gain_vs_best) <= greatest(1e-6, 1e-6 * abs(cv_score)), false)"


@query("dc_bandit_deltas", f"""SELECT attempt_id, CASE WHEN error_trace IS NOT NULL OR label = 'regression' THEN 0e0 WHEN {TIE} THEN 0e0 WHEN label = 'jump' THEN 1e0
 WHEN gain_vs_best > 0 THEN 5e-1 ELSE 1e-1 END AS alpha, CASE WHEN error_trace IS NOT NULL OR label = 'regression' THEN 1e0 WHEN {TIE} THEN 1e0 WHEN label = 'jump' THEN 0e0 ELSE 1e-1 END AS beta FROM attempts""")
def _(t):
    d = rules.bandit_deltas(F.col("label"), F.col("gain_vs_best"), F.col("error_trace"), views.noop_tie(F.col("gain_vs_best"), F.col("cv_score")))
    return t.attempts.select("attempt_id", d.alias("d")).select("attempt_id", "d.*")


@query("dc_dead_actions", """SELECT scope_key, action_type, alpha + beta - 2 >= 5 AND alpha / (alpha + beta) < 1e-1 AS dead FROM bandit""")
def _(t):
    return t.bandit.select("scope_key", "action_type", rules.is_dead_action(F.col("alpha"), F.col("beta")).alias("dead"))


# Posterior draws as rows: every try of both gamma variables, of which the first accepted one counts.
_DRAWS = f"""beliefs AS (SELECT scope_key, action_type, coalesce(alpha, 1) AS alpha, coalesce(beta, 1) AS beta
  FROM (SELECT DISTINCT competition_id AS scope_key, unnest({list(K.ACTION_TYPES)}) AS action_type FROM competitions)
  LEFT JOIN (SELECT scope_key, action_type, alpha, beta FROM bandit WHERE scope = 'local') USING (scope_key, action_type)),
 tries AS (SELECT scope_key, action_type, no, side, try, CASE side WHEN 'a' THEN alpha ELSE beta END - 1 / 3e0 AS d,
   sha256(concat_ws(':', '42', scope_key, action_type, no, side, try)) AS h
  FROM beliefs, range(4) n(no), (VALUES ('a'), ('b')) s(side), range({draws.TRIES}) r(try)),
 unit AS (SELECT *, (CAST('0x' || substr(h, 1, 13) AS BIGINT) + 0.5e0) / pow(2e0, 52) AS u0, (CAST('0x' || substr(h, 14, 13) AS BIGINT) + 0.5e0) / pow(2e0, 52) AS u1,
   (CAST('0x' || substr(h, 27, 13) AS BIGINT) + 0.5e0) / pow(2e0, 52) AS u2 FROM tries),
 norm AS (SELECT *, sqrt(-2 * ln(u0)) * cos(2 * pi() * u1) AS x FROM unit),
 cube AS (SELECT *, pow(1 + x / sqrt(9 * d), 3) AS v FROM norm),
 gam AS (SELECT scope_key, action_type, no, side, arg_min(d * v, try) AS g FROM cube
  WHERE v > 0 AND ln(u2) < x * x / 2 + d - d * v + d * ln(CASE WHEN v > 0 THEN v ELSE 1 END) GROUP BY ALL),
 drawn AS (SELECT scope_key, action_type, no, max(g) FILTER (side = 'a') / sum(g) AS p FROM gam GROUP BY ALL)"""


@query("dc_assign_actions", f"""WITH {_DRAWS},
 known AS (SELECT b.*, (alpha + beta - 2 >= {K.DEAD_MIN_OBSERVED} AND alpha / (alpha + beta) < {K.DEAD_MEAN}) AND coalesce(total, 0) % {K.REEXPLORE_EVERY} >= 3 AS dead
  FROM beliefs b LEFT JOIN (SELECT competition_id AS scope_key, count(*) AS total FROM attempts GROUP BY 1) USING (scope_key)),
 listed AS (SELECT scope_key, action_type, no, p, dead, count(*) FILTER (NOT dead) OVER (PARTITION BY scope_key, no) AS alive, count(*) OVER (PARTITION BY scope_key, no) AS everyone,
   row_number() OVER (PARTITION BY scope_key, no ORDER BY p DESC, action_type) - 1 AS place,
   row_number() OVER (PARTITION BY scope_key, no, dead ORDER BY p DESC, action_type) - 1 AS place_alive FROM known JOIN drawn USING (scope_key, action_type))
 SELECT scope_key, CAST(slot AS INT) AS slot, action_type FROM listed, range(3) s(slot)
 WHERE CASE WHEN alive = 0 THEN no = 0 AND place = slot % everyone WHEN slot < alive THEN no = 0 AND NOT dead AND place_alive = slot ELSE no = slot + 1 AND NOT dead AND place_alive = 0 END""")
def _(t):
    return fleet.assign_actions(t.bandit, t.attempts, t.competitions, 3, seed=42)


@query("dc_action_prior", f"WITH {_DRAWS} SELECT scope_key, action_type, round(p, 4) AS prior FROM drawn WHERE no = 0")
def _(t):
    return fleet.action_prior(t.bandit, t.competitions, seed=42)


# Winning attempts as candidates; scores on the confirm seeds and the holdout shifted by the attempt's k.
_SHIFT = "((k % 9) - 3) / 1e1"
_CAND = """SELECT event_id AS candidate_id, CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS metric_sign, value, k, seed FROM {src}"""


def _confirm_inputs(t):
    ev = t.raw("events").filter("event_type = 'purchase'").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    sign = F.expr("CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END")
    seeds = ev.withColumn("seed", F.explode(F.array(F.lit(7), F.lit(101))))
    base = F.expr("CASE WHEN k % 29 <> 0 THEN value END")
    evals = seeds.select(
        F.col("event_id").alias("candidate_id"), sign.alias("metric_sign"), "seed", F.expr(f"value + {_SHIFT} * (CASE WHEN seed = 7 THEN 1 ELSE 2 END)").alias("candidate_cv"),
        base.alias("baseline_cv"), F.expr("CASE WHEN k % 23 = 0 AND seed = 101 THEN 'crash' END").alias("error"),
    )
    hold = ev.select(F.col("event_id").alias("candidate_id"), F.expr("CASE WHEN k % 31 <> 0 THEN value - 1e0 + (k % 2) * 2e0 END").alias("candidate_holdout"), F.expr("CASE WHEN k % 5 <> 0 THEN value END").alias("baseline_holdout"))
    return evals, hold


CONFIRM = f"""WITH e AS (SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS sg, CAST(props->>'$.k' AS INT) AS k, value FROM events WHERE event_type = 'purchase'),
 s AS (SELECT *, CASE WHEN k % 29 <> 0 THEN value END AS b, k % 23 = 0 OR k % 29 = 0 AS errored, CASE WHEN k % 31 <> 0 THEN value - 1 + (k % 2) * 2 END AS ch, CASE WHEN k % 5 <> 0 THEN value END AS bh FROM e),
 v AS (SELECT *, NOT errored AND coalesce(sg * (value + {_SHIFT} - b) > 0 AND sg * (value + {_SHIFT} * 2 - b) > 0, false) AS won, NOT errored AND coalesce(sg * (ch - bh) < 0, false) AS regressed,
 NOT errored AND ch IS NULL AS failed FROM s)
 SELECT id AS candidate_id, errored, CASE WHEN NOT errored THEN ch END AS holdout_score, regressed AS holdout_regressed, won AND NOT regressed AND NOT failed AS confirmed,
 NOT (won AND NOT regressed AND NOT failed) AND NOT errored AND NOT failed AS memo FROM v"""


@query("dc_confirm", CONFIRM)
def _(t):
    return P.confirm(*_confirm_inputs(t))


@query("dc_effective_label", f"""SELECT attempt_id, CASE WHEN label = 'jump' AND NOT confirmed THEN 'regression' ELSE label END AS effective_label FROM attempts LEFT JOIN ({CONFIRM}) AS c ON candidate_id = attempt_id""")
def _(t):
    verdict = P.confirm(*_confirm_inputs(t)).select(F.col("candidate_id").alias("attempt_id"), "confirmed")
    rows = t.attempts.select("attempt_id", "label").join(verdict, "attempt_id", "left")
    return rows.select("attempt_id", P.effective_label(F.col("label"), F.col("confirmed")).alias("effective_label"))


@query("dc_ceiling", """WITH b AS (SELECT competition_id, metric_sign, max(metric_sign * score) * metric_sign AS wb FROM (SELECT competition_id, score / 1e1 AS score FROM board) JOIN competitions USING (competition_id) GROUP BY 1, 2)
 SELECT attempt_id, competition_id, round(cv_score, 6) AS cv_score, round(wb, 6) AS world_best, round(coalesce(3 * list_stddev_samp(fold_scores) / sqrt(len(fold_scores)), 0), 6) AS margin FROM attempts JOIN b USING (competition_id)
 WHERE metric_sign * (cv_score - wb) > coalesce(3 * list_stddev_samp(fold_scores) / sqrt(len(fold_scores)), 0)""")
def _(t):
    return r(P.ceiling_violations(t.attempts, t.board.withColumn("score", F.col("score") / 10.0), t.competitions))


_BEHAVIOUR = "concat_ws('|', printf('%,.9f', cv_score), array_to_string(list_transform(coalesce(fold_scores, []), lambda x: printf('%,.9f', x)), ','))"


@query("dc_memo", f"""WITH a AS (SELECT attempt_id, run_ts, label, competition_id, sha256({_BEHAVIOUR}) AS bk FROM attempts WHERE cv_score IS NOT NULL),
 m AS (SELECT competition_id, bk, max(run_ts) AS rejected_at FROM a WHERE label = 'regression' AND run_ts > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 30 DAY GROUP BY 1, 2)
 SELECT a.attempt_id, m.rejected_at FROM a JOIN m USING (competition_id, bk)""")
def _(t):
    key = P.memo_key(P.context_key([F.col("competition_id")]), F.col("cv_score"), F.col("fold_scores"))
    rows = t.attempts.filter("cv_score IS NOT NULL").select("attempt_id", "label", "run_ts", key.alias("memo_key"))
    memo = rows.filter("label = 'regression'").select("memo_key", F.col("run_ts").alias("created_at"))
    return P.memo_lookup(rows, memo, at(EVENTS_NOW)).select("attempt_id", "rejected_at")


@query("dc_data_fingerprint", """SELECT sha256('o_custkey:bigint|o_orderdate:timestamp_ntz|o_orderkey:bigint|o_orderpriority:string|o_orderstatus:string|o_totalprice:double|h=' || CAST(count(*) AS VARCHAR)) AS fingerprint FROM orders""")
def _(t):
    return P.data_fingerprint(t.raw("orders"))


@query("dc_fingerprint_guard", """WITH g AS (SELECT competition_id, train_fingerprint AS st, auto_submit_paused_reason AS pz, concat('fp', CAST(n_numeric % 4 AS VARCHAR)) AS nw FROM competitions)
 SELECT competition_id, coalesce(st, nw) AS train_fingerprint, CASE WHEN st <> nw THEN coalesce(pz, concat('train_fp: stored ', left(st, 12), ' != current ', left(nw, 12)))
 WHEN st = nw AND starts_with(pz, 'train_fp') THEN NULL ELSE pz END AS auto_submit_paused_reason, CASE WHEN st IS NULL THEN 'stamp' WHEN st = nw THEN 'pass' ELSE 'mismatch' END AS outcome FROM g""")
def _(t):
    current = t.competitions.select("competition_id", F.concat(F.lit("fp"), (F.col("n_numeric") % 4).cast("string")).alias("fingerprint"))
    return P.fingerprint_guard(t.competitions, current, "train_fingerprint", "train_fp")


@query("dc_source_guard", """WITH n AS (SELECT a.competition_id, arg_max({'h': coalesce(p.materialized_sha256, p.pipeline_sha256)}, (a.run_ts, p.pipeline_id)).h AS trusted FROM pipelines p JOIN attempts a USING (attempt_id)
 WHERE p.invalid_reason IS NULL GROUP BY 1), x AS (SELECT competition_id, concat('base ', CAST(cardinality_max // 10 AS VARCHAR)) AS txt FROM competitions)
 SELECT competition_id, CASE WHEN trusted IS NULL OR txt IS NULL THEN 'skip' WHEN sha256(txt) = trusted THEN 'match' ELSE 'mismatch' END AS state FROM n LEFT JOIN x USING (competition_id)""")
def _(t):
    texts = t.competitions.select("competition_id", F.concat(F.lit("base "), F.floor(F.col("cardinality_max") / 10).cast("string")).alias("text"))
    return P.source_guard(t.pipelines, t.attempts, texts)


@query("dc_snapshot_integrity", """SELECT pipeline_id, competition_id, coalesce(materialized_sha256, pipeline_sha256) AS trusted, sha256(materialized_code) AS actual FROM pipelines
 WHERE materialized_code IS NOT NULL AND coalesce(materialized_sha256, pipeline_sha256) <> sha256(materialized_code)""")
def _(t):
    return P.snapshot_corruption(t.pipelines)


@query("dc_merge_verify", f"""SELECT a.attempt_id, coalesce(abs(holdout_score / 98e-2 + (CASE WHEN label = 'jump' THEN 1e-3 ELSE 0e0 END) - cv_score) <= greatest(1e-6, 1e-6 * abs(cv_score)), false) AS verified
 FROM attempts a JOIN ({WINNER}) AS w ON a.attempt_id = w.attempt_id""")
def _(t):
    winners = t.attempts.join(L.pick_winner(t.attempts).select("attempt_id"), "attempt_id").select("attempt_id", "cv_score")
    new = F.col("holdout_score") / 0.98 + F.when(F.col("label") == "jump", 1e-3).otherwise(0.0)
    rescored = t.attempts.select("attempt_id", new.alias("rescored_cv"))
    return P.merge_verify(winners, rescored).select("attempt_id", "verified")


@query("dc_quarantine_window", """SELECT 'pipelines' AS kind, count(*) AS n FROM pipelines p JOIN attempts a USING (attempt_id) WHERE p.competition_id = 3 AND invalid_reason IS NULL AND run_ts >= TIMESTAMP '2024-01-10'
 UNION ALL SELECT 'lessons', count(*) FROM lessons WHERE competition_id = 3 AND NOT archived AND created_at >= TIMESTAMP '2024-01-10'
 UNION ALL SELECT 'marked', count(*) FROM pipelines p JOIN attempts a USING (attempt_id) WHERE invalid_reason IS NOT NULL OR (p.competition_id = 3 AND run_ts >= TIMESTAMP '2024-01-10')""")
def _(t):
    marked, _, counts = P.quarantine_since(t.pipelines, t.lessons, t.attempts, 3, at("2024-01-10 00:00:00"), "contaminated")
    total = marked.filter("invalid_reason IS NOT NULL").agg(F.count(F.lit(1)).alias("n")).select(F.lit("marked").alias("kind"), "n")
    return counts.unionByName(total)


_NEW = "CASE WHEN k % 8 = 0 THEN NULL ELSE value + 1e0 END"


def _rescored(t):
    ev = t.raw("events").filter("event_type = 'purchase'").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return ev.select(F.col("event_id").alias("pipeline_id"), F.expr(_NEW).alias("new_cv"), F.expr("array(value, value + 2e0)").alias("new_folds"), F.expr("k % 12 = 0").alias("failed"))


@query("dc_remeasure", f"""WITH n AS (SELECT event_id AS pipeline_id, {_NEW} AS new_cv, k % 12 = 0 AS failed FROM (SELECT *, CAST(props->>'$.k' AS INT) AS k FROM events) WHERE event_type = 'purchase'),
 u AS (SELECT p.*, new_cv, failed, invalid_reason IS NULL AND cv_score IS NOT NULL AND NOT starts_with(coalesce(materialized_origin, ''), 'unverifiable:') AS usable FROM pipelines p JOIN n USING (pipeline_id))
 SELECT pipeline_id, CASE WHEN usable AND NOT failed AND new_cv IS NOT NULL THEN new_cv ELSE cv_score END AS cv_score, CASE WHEN usable AND (failed OR new_cv IS NULL) THEN 'remeasure_failed:train_fingerprint' ELSE invalid_reason END AS invalid_reason FROM u""")
def _(t):
    return P.apply_remeasure(t.pipelines, _rescored(t)).select("pipeline_id", "cv_score", "invalid_reason")


_REPRO = """SELECT event_id AS pipeline_id, CASE WHEN k % 9 <> 0 THEN concat('base ', CAST(k + (CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END) AS {text})) END AS text, k % 6 <> 1 AS comparable,
 CASE WHEN k % 8 <> 0 THEN value + (CASE WHEN k % 4 = 0 THEN 0e0 ELSE 5e-1 END) END AS new_cv, {arr}(value, value + 2e0, value + 1e0) AS new_folds, 4e0 AS new_var FROM {src}"""


@query("ml_behaviour_drift", f"""WITH n AS ({_REPRO.format(text='VARCHAR', arr='list_value', src="(SELECT *, CAST(props->>'$.k' AS INT) AS k FROM events) WHERE event_type = 'purchase'")}),
 j AS (SELECT p.*, a.run_ts, c.metric_sign, n.* EXCLUDE (pipeline_id), last_value(CASE WHEN new_cv IS NOT NULL THEN {{'cv': new_cv, 'f': new_folds}} END IGNORE NULLS) OVER
 (PARTITION BY p.competition_id ORDER BY a.run_ts, p.pipeline_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM pipelines p JOIN attempts a USING (attempt_id) JOIN competitions c ON c.competition_id = p.competition_id JOIN n ON n.pipeline_id = p.pipeline_id),
 d AS (SELECT *, list_transform(list_zip(pv.f, new_folds), lambda z: metric_sign * (z[1] - z[2])) AS dl FROM j)
 SELECT pipeline_id, competition_id, CASE WHEN materialized_code IS NOT NULL AND coalesce(materialized_sha256, pipeline_sha256) <> sha256(materialized_code) THEN 'unverifiable:snapshot_corrupt'
 WHEN materialized_code IS NOT NULL THEN coalesce(materialized_origin, 'promote') WHEN text IS NULL THEN 'unverifiable:eval_error' WHEN coalesce(sha256(text) = pipeline_sha256, false) THEN 'backfill:sha'
 WHEN new_cv IS NULL THEN 'unverifiable:eval_error' WHEN comparable AND cv_score IS NOT NULL AND abs(new_cv - cv_score) <= greatest(1e-6, 1e-6 * abs(cv_score)) THEN 'backfill:cv'
 WHEN comparable AND cv_score IS NOT NULL THEN 'unverifiable:cv_mismatch'
 WHEN pv IS NULL OR NOT (CASE WHEN list_stddev_samp(dl) < 1e-12 THEN list_avg(dl) > 0 ELSE list_avg(dl) / (list_stddev_samp(dl) / sqrt(3)) > 2 END) THEN 'backfill:chain' ELSE 'unverifiable:chain_regression' END AS verdict FROM d""")
def _(t):
    ev = t.raw("events").filter("event_type = 'purchase'").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    ev.createOrReplaceTempView("ledgerlark_rescored")
    rescored = t.spark.sql(_REPRO.format(text="STRING", arr="array", src="ledgerlark_rescored"))
    # Quarter steps keep the fold differences exact, so equal differences have no deviation in either engine.
    exact = rescored.withColumn("new_folds", F.transform("new_folds", lambda x: x))
    return P.reproduction_verdict(t.pipelines, t.attempts, exact, t.competitions)


# --- fleet -----------------------------------------------------------------------------------------------------------------------

SIGNIFICANT = """CASE WHEN len(cf) = len(bf) AND len(bf) >= 2 THEN CASE WHEN list_stddev_samp(dl) = 0 THEN list_avg(dl) > 0 ELSE list_avg(dl) / (list_stddev_samp(dl) / sqrt(len(dl))) > 2 END
 ELSE coalesce(sg * (cc - bc) > 2 * sqrt(cvv), false) END"""


@query("dc_auto_submit", f"""WITH best AS ({BEST}), un AS ({UNSUBMITTED}), la AS ({LAST_SUBMITTED}),
 td AS (SELECT competition_id, count(*) AS n FROM subs WHERE submitted_at >= date_trunc('day', TIMESTAMP '{ORDERS_NOW}') AND status <> 'error' GROUP BY 1),
 s AS (SELECT c.competition_id, c.metric_sign AS sg, c.auto_submit_paused_reason AS pz, 5 - coalesce(td.n, 0) AS budget, un.attempt_id AS nx, un.place, best.attempt_id AS bs, la.attempt_id AS ls,
 x.cv_score AS cc, x.cv_fold_var AS cvv, x.fold_scores AS cf, y.cv_score AS bc, y.fold_scores AS bf FROM (SELECT * FROM competitions WHERE is_active) c LEFT JOIN td USING (competition_id) LEFT JOIN un USING (competition_id)
 LEFT JOIN best USING (competition_id) LEFT JOIN la USING (competition_id) LEFT JOIN attempts x ON x.attempt_id = best.attempt_id LEFT JOIN attempts y ON y.attempt_id = la.attempt_id),
 z AS (SELECT *, list_transform(list_zip(cf, bf), lambda q: sg * (q[1] - q[2])) AS dl FROM s),
 d AS (SELECT *, CASE WHEN pz <> '' THEN 'auto-submit paused: ' || pz WHEN budget <= 0 THEN 'daily budget spent' WHEN nx IS NOT NULL THEN 'submit' WHEN bs IS NULL THEN 'no confirmed pipeline' WHEN ls = bs THEN 'best unchanged'
 WHEN ls IS NOT NULL AND NOT (cc IS NULL OR bc IS NULL OR {SIGNIFICANT}) THEN 'gain not significant' ELSE 'submit' END AS decision FROM z)
 SELECT DISTINCT competition_id, decision, coalesce(CASE WHEN decision = 'submit' THEN coalesce(nx, bs) END, -1) AS attempt_id FROM d WHERE coalesce(place, 1) <= greatest(budget, 1)""")
def _(t):
    return fleet.plan_submissions(t.competitions, t.pipelines, t.attempts, t.subs, at(ORDERS_NOW)).fillna({"attempt_id": -1})


REFILL = """WITH lr AS (SELECT competition_id, max(run_ts) AS l FROM attempts GROUP BY 1), lq AS (SELECT competition, arg_max(status, (created_at, queue_id)) AS st FROM q GROUP BY 1)
 SELECT competition_id, split_part(name, '-', 3) AS competition, 'reflexion' AS stage, 20 AS n_cycles, 'pending' AS status FROM competitions LEFT JOIN lr USING (competition_id)
 LEFT JOIN lq ON lq.competition = split_part(name, '-', 3) WHERE is_active AND NOT (SELECT bool_or(status IN ('pending', 'running')) FROM q) AND (l IS NULL OR
 epoch(TIMESTAMP '{now}' - l) > CASE WHEN st = 'done' THEN 0 ELSE 6 * 3600 END)"""


_FINISHED = "SELECT * REPLACE (CASE WHEN status IN ('pending', 'running') THEN 'done' ELSE status END AS status) FROM queue"


@query("dc_queue_refill", "SELECT 'as it is' AS queue_state, * FROM (WITH q AS (SELECT * FROM queue), " + REFILL[5:].format(now="2024-01-30 20:00:00")
       + f") AS x UNION ALL SELECT 'finished', * FROM (WITH q AS ({_FINISHED}), " + REFILL[5:].format(now="2024-01-30 20:00:00") + ") AS y")
def _(t):
    """What is enqueued now, and once everything that is pending or running is done."""
    now = at("2024-01-30 20:00:00")
    done = t.queue.withColumn("status", F.when(F.col("status").isin("pending", "running"), "done").otherwise(F.col("status")))
    plans = [fleet.plan_refill(q, t.attempts, t.competitions, now).withColumn("queue_state", F.lit(s)) for s, q in (("as it is", t.queue), ("finished", done))]
    return plans[0].unionByName(plans[1])


@query("dc_tune_plan", f"""WITH l AS (SELECT competition_id, max(created_at) AS last_tune_at FROM tunes GROUP BY 1), g AS (SELECT competition_id, tuning_run_id, bool_or(improved) AS good, max(created_at) AS ts FROM tunes GROUP BY 1, 2),
 n AS (SELECT *, row_number() OVER (PARTITION BY competition_id ORDER BY ts DESC, tuning_run_id DESC) AS rn FROM g), f AS (SELECT competition_id, count(*) = 5 AND NOT bool_or(good) AS bad FROM n WHERE rn <= 5 GROUP BY 1)
 SELECT competition_id, last_tune_at, last_tune_at IS NULL OR epoch(TIMESTAMP '{TUNES_NOW}' - last_tune_at) > 48 * 3600 AS due, NOT coalesce(bad, false) AS after_promotion FROM competitions LEFT JOIN l USING (competition_id)
 LEFT JOIN f USING (competition_id) WHERE is_active AND competition_id IN (SELECT competition_id FROM pipelines WHERE invalid_reason IS NULL)""")
def _(t):
    return fleet.plan_tuning(t.competitions, t.pipelines, t.tunes, at(TUNES_NOW))


@query("dc_backfill_percentile", """WITH p AS (SELECT s.submission_id, 1e2 * count(*) FILTER (WHERE c.metric_sign * (s.lb_score - b.score) > 0) / count(*) AS v FROM subs s JOIN competitions c USING (competition_id)
 JOIN board b ON b.competition_id = s.competition_id WHERE s.status = 'complete' AND s.lb_score IS NOT NULL GROUP BY 1)
 SELECT submission_id, round(coalesce(v, lb_percentile), 6) AS lb_percentile FROM subs LEFT JOIN p USING (submission_id)""")
def _(t):
    return r(fleet.backfill_percentiles(t.subs, t.board, t.competitions).select("submission_id", "lb_percentile"))


@query("dc_health", f"""WITH fu AS ({FUNNEL}), jp AS (SELECT competition_id, count(*) FILTER (WHERE label = 'jump') AS j FROM (SELECT *, row_number() OVER {NEWEST} AS rn FROM attempts WHERE stage = 'reflexion') WHERE rn <= 10 GROUP BY 1),
 be AS (SELECT scope_key AS competition_id, max(posterior_mean) - min(posterior_mean) AS ps, coalesce(max(calibration_gap), 0) AS cg FROM ({CALIBRATION}) AS c GROUP BY 1),
 pi AS (SELECT competition_id, sum(occurrences_after_active) / sum(total) AS rr FROM ({RECURRENCE}) AS x WHERE pitfall_active GROUP BY 1),
 sx AS (SELECT competition_id, (label = 'error')::INT AS e, rn, count(*) OVER (PARTITION BY competition_id) AS n FROM (SELECT *, row_number() OVER {NEWEST} AS rn FROM attempts WHERE stage = 'reflexion') WHERE rn <= 200),
 sl AS (SELECT competition_id, CASE WHEN n < 20 THEN 0 ELSE sign(avg(e) FILTER (WHERE rn <= n // 2) - avg(e) FILTER (WHERE rn > n // 2))::INT END AS sl FROM sx GROUP BY competition_id, n),
 us AS (SELECT competition_id, count(DISTINCT action_type) AS cov FROM (SELECT *, row_number() OVER {NEWEST} AS rn FROM attempts) WHERE rn <= 15 GROUP BY 1),
 wi AS (SELECT competition_id, count(*) AS n, min(rn) FILTER (WHERE label = 'jump') AS f FROM (SELECT *, row_number() OVER {NEWEST} AS rn FROM attempts WHERE was_promoted) WHERE rn <= 5 GROUP BY 1),
 al AS (SELECT competition_id, coalesce(cite_rate, 0) AS cr, coalesce(j, 0) AS j, coalesce(ps, 0) AS ps, coalesce(cg, 0) AS cg, coalesce(rr, 0) AS rr, coalesce(sl, 0) AS sl, coalesce(cov, 5) AS cov, coalesce(f - 1, wi.n, 0) >= 3 AS stuck
 FROM competitions LEFT JOIN fu USING (competition_id) LEFT JOIN jp USING (competition_id) LEFT JOIN be USING (competition_id) LEFT JOIN pi USING (competition_id) LEFT JOIN sl USING (competition_id)
 LEFT JOIN us USING (competition_id) LEFT JOIN wi USING (competition_id))
 SELECT competition_id, CASE WHEN cr < 1e-1 OR (j = 0 AND stuck) THEN 'red' WHEN cr >= 3e-1 AND j >= 1 THEN 'green' ELSE 'amber' END AS accumulation,
 CASE WHEN ps < 5e-2 OR cg > 3e-1 THEN 'red' WHEN ps >= 15e-2 AND cg <= 15e-2 THEN 'green' ELSE 'amber' END AS bandit, CASE WHEN rr > 5e-1 THEN 'red' WHEN sl < 0 AND rr <= 2e-1 THEN 'green' ELSE 'amber' END AS antipattern,
 CASE WHEN stuck AND cov <= 1 THEN 'red' WHEN cov >= 3 THEN 'green' ELSE 'amber' END AS exploration, cov AS action_coverage, stuck AS is_stagnant, round(rr, 4) AS repeat_rate FROM al""")
def _(t):
    out = fleet.reflexion_health(t.competitions, t.signed_attempts, t.lessons, t.bandit)
    cols = ["competition_id", "accumulation", "bandit", "antipattern", "exploration", "is_stagnant"]
    return out.select(*cols, F.col("action_coverage").cast("long").alias("action_coverage"), F.round("repeat_rate", 4).alias("repeat_rate"))


FLEET = f"""WITH lq AS (SELECT competition, arg_max(status, (created_at, queue_id)) AS queue_status FROM queue GROUP BY 1), pc AS (SELECT competition_id, count(*) FILTER (WHERE invalid_reason IS NULL) AS confirmed,
 count(*) FILTER (WHERE invalid_reason IS NOT NULL) AS quarantined FROM pipelines GROUP BY 1), ra AS (SELECT competition_id, count(*) AS attempts_14d, count(*) FILTER (WHERE label = 'jump') AS jumps_14d,
 count(*) FILTER (WHERE label = 'error') AS errors_14d FROM attempts WHERE run_ts > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 14 DAY GROUP BY 1),
 lb AS (SELECT competition_id, epoch(TIMESTAMP '{ORDERS_NOW}' - max(submitted_at)) / 864e2 AS days_since_lb FROM subs WHERE status = 'complete' AND lb_score IS NOT NULL GROUP BY 1)
 SELECT competition_id, name, is_active, queue_status, coalesce(confirmed, 0) AS confirmed, coalesce(quarantined, 0) AS quarantined, coalesce(attempts_14d, 0) AS attempts_14d, coalesce(jumps_14d, 0) AS jumps_14d,
 coalesce(errors_14d, 0) AS errors_14d, round(days_since_lb, 6) AS days_since_lb, auto_submit_paused_reason FROM competitions LEFT JOIN lq ON lq.competition = split_part(name, '-', 3)
 LEFT JOIN pc USING (competition_id) LEFT JOIN ra USING (competition_id) LEFT JOIN lb USING (competition_id)"""
FLEET_COLS = ["competition_id", "name", "is_active", "queue_status", "confirmed", "quarantined", "attempts_14d", "jumps_14d", "errors_14d", "days_since_lb", "auto_submit_paused_reason"]


def _fleet(t):
    out = fleet.fleet_overview(t.competitions, t.queue, t.pipelines, t.attempts, t.subs, t.board, at(EVENTS_NOW), at(ORDERS_NOW))
    return out.fillna({c: 0 for c in ("confirmed", "quarantined", "attempts_14d", "jumps_14d", "errors_14d")})


@query("join_fleet", FLEET)
def _(t):
    return r(_fleet(t).select(*FLEET_COLS))


@query("dc_fleet_attention", f"""SELECT competition_id, attention, CASE attention WHEN 'red' THEN 0 WHEN 'amber' THEN 1 ELSE 2 END AS attention_rank FROM (SELECT competition_id, CASE WHEN auto_submit_paused_reason <> '' THEN 'red'
 WHEN attempts_14d > 0 AND errors_14d / attempts_14d > 7e-1 THEN 'red' WHEN confirmed = 0 AND quarantined > 0 THEN 'red' WHEN confirmed = 0 THEN 'amber' WHEN is_active AND (days_since_lb IS NULL OR days_since_lb > 7) THEN 'amber'
 WHEN queue_status = 'pending' THEN 'amber' WHEN jumps_14d = 0 THEN 'amber' ELSE 'green' END AS attention FROM ({FLEET}) AS f)""")
def _(t):
    return fleet.attention(_fleet(t)).select("competition_id", "attention", "attention_rank")
