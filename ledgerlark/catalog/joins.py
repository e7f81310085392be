"""Queries over joins, set operations and table maintenance."""

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import listings as L, summaries as S, training as T, views
from ..sources import tables
from . import query
from .shared import EVENTS_NOW, ORDERS_NOW, at, r

PROMO = """SELECT p.*, a.run_ts, a.competition_id AS comp, a.cv_score AS att_cv, a.error_trace FROM pipelines p JOIN attempts a USING (attempt_id)"""


@query("join_left_impact", """SELECT reflection_id, lesson_type, coalesce(times_applied, 0) AS times_applied, coalesce(avg_gain, 0) AS avg_gain
 FROM lessons LEFT JOIN impact USING (reflection_id)""")
def _(t):
    return views.with_impact(t.lessons.select("reflection_id", "lesson_type"), t.impact).select("reflection_id", "lesson_type", "times_applied", "avg_gain")


@query("join_full_funnel", """WITH w AS (SELECT competition_id, count(*) AS written FROM lessons WHERE NOT archived GROUP BY 1),
 s AS (SELECT competition_id, count(*) AS total_attempts FROM attempts WHERE stage = 'reflexion' GROUP BY 1)
 SELECT competition_id, coalesce(written, 0) AS written, coalesce(total_attempts, 0) AS total_attempts FROM w FULL OUTER JOIN s USING (competition_id)""")
def _(t):
    return views.lesson_funnel(t.lessons, t.attempts).select("competition_id", "written", "total_attempts")


TWIN_COLS = ["l_quantity", "l_discount", "l_tax", "l_partkey", "l_returnflag"]
TWIN_SQL = ", ".join(TWIN_COLS)


def _twin_sides(t):
    """Base rows with status O; rows with status F as a further source whose quantity reads as text."""
    lines = t.raw("lineitem")
    base = lines.filter("l_linestatus = 'O'").select(*TWIN_COLS, "l_orderkey")
    extra = lines.filter("l_linestatus = 'F'").select(
        F.concat(F.lit(" "), F.col("l_quantity").cast("string")).alias("l_quantity"), *TWIN_COLS[1:], F.col("l_suppkey").alias("supplier")
    )
    return base, extra


@query("join_anti_twins", f"""SELECT {TWIN_SQL} FROM lineitem e WHERE l_linestatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_linestatus = 'O'
 AND {" AND ".join(f"b.{c} = e.{c}" for c in TWIN_COLS)})""")
def _(t):
    base, extra = _twin_sides(t)
    out = T.remove_twins(T.project_common(extra, base), base, TWIN_COLS)
    return out.withColumn("l_quantity", F.trim("l_quantity").cast("double"))


@query("join_not_exists", """SELECT competition_id, 'no baseline' AS kind FROM competitions c WHERE NOT EXISTS (SELECT 1 FROM pipelines p
 WHERE p.competition_id = c.competition_id AND p.invalid_reason IS NULL AND NOT starts_with(coalesce(p.materialized_origin, ''), 'unverifiable:'))
 UNION ALL SELECT attempt_id, 'never submitted' FROM attempts a WHERE NOT EXISTS (SELECT 1 FROM subs s WHERE s.attempt_id = a.attempt_id)""")
def _(t):
    a = L.without_baseline(t.competitions, t.pipelines).select("competition_id", F.lit("no baseline").alias("kind"))
    b = L.never_submitted(t.attempts, t.subs).select(F.col("attempt_id").alias("competition_id"), F.lit("never submitted").alias("kind"))
    return a.unionByName(b)


@query("join_asof_prev", """SELECT a.attempt_id, a.competition_id, a.run_ts, coalesce(p.pipeline_id, -1) AS prev_pipeline_id FROM attempts a ASOF LEFT JOIN
 (SELECT p.pipeline_id, b.competition_id, b.run_ts FROM pipelines p JOIN attempts b USING (attempt_id)) p
 ON a.competition_id = p.competition_id AND a.run_ts > p.run_ts""")
def _(t):
    return L.asof_promotion(t.attempts, t.pipelines).fillna({"prev_pipeline_id": -1})


@query("join_lateral_unnest", """SELECT attempt_id, unnest(reflection_ids) AS reflection_id FROM attempts""")
def _(t):
    return t.attempts.select("attempt_id", F.explode("reflection_ids").alias("reflection_id"))


@query("join_array_member", """SELECT reflection_id, coalesce(n, 0) AS times_retrieved FROM lessons LEFT JOIN (SELECT rid, count(*) AS n FROM
 (SELECT DISTINCT attempt_id, unnest(retrieved_ids) AS rid FROM attempts) GROUP BY 1) ON rid = reflection_id""")
def _(t):
    return views.times_retrieved(t.lessons.select("reflection_id"), t.attempts)


@query("join_agg_back", """WITH s AS (SELECT o_orderpriority, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
 SELECT o_orderkey, o_orderpriority, o_totalprice, round(m, 4) AS o_totalprice_mean, round(sd, 4) AS o_totalprice_std, n AS o_orderpriority_count
 FROM orders LEFT JOIN s USING (o_orderpriority) WHERE o_orderstatus = 'P'""")
def _(t):
    cols = ["o_orderkey", "o_orderpriority", "o_totalprice"]
    train, valid = (t.raw("orders").filter(f"o_orderstatus {op} 'P'").select(*cols) for op in ("<>", "="))
    return r(T.group_stats(train, valid, "o_orderpriority", "o_totalprice"), 4)


@query("join_columns_union", """SELECT o_orderkey, o_custkey, o_totalprice * 2e0 AS o_totalprice, length(o_orderpriority) AS prio_len FROM orders""")
def _(t):
    orders = t.raw("orders")
    base = orders.select("o_orderkey", "o_custkey", "o_totalprice")
    patch = orders.select("o_orderkey", (F.col("o_totalprice") * 2.0).alias("o_totalprice"), F.length("o_orderpriority").cast("long").alias("prio_len"))
    return T.union_features(base, patch, "o_orderkey")


@query("join_promotion_chain", """SELECT a.competition_id, p.pipeline_id, p.attempt_id, a.run_ts, p.invalid_reason, row_number() OVER
 (PARTITION BY a.competition_id ORDER BY a.run_ts, p.pipeline_id) AS position FROM pipelines p JOIN attempts a USING (attempt_id)""")
def _(t):
    return L.promotion_chain(t.pipelines, t.attempts)


@query("join_merge_lessons", """WITH a AS (SELECT reflection_id, row_number() OVER (ORDER BY avg_gain DESC, reflection_id) AS place FROM impact),
 b AS (SELECT reflection_id, row_number() OVER (ORDER BY times_applied DESC, reflection_id) AS place FROM impact),
 u AS (SELECT *, 0 AS source_list FROM a WHERE place <= 50 UNION ALL SELECT *, 1 FROM b WHERE place <= 50),
 n AS (SELECT *, row_number() OVER (PARTITION BY reflection_id ORDER BY source_list, place) AS rn FROM u)
 SELECT reflection_id, source_list, place FROM n WHERE rn = 1""")
def _(t):
    from pyspark.sql import Window as W

    def ranked(col):
        top = t.impact.orderBy(F.col(col).desc(), "reflection_id").limit(50)
        return top.withColumn("place", F.row_number().over(W.orderBy(F.col(col).desc(), "reflection_id")).cast("long"))

    return L.merge_ranked(ranked("avg_gain"), ranked("times_applied"), "reflection_id", "place")


@query("set_diagonal_union", """SELECT CAST(o_orderkey AS DOUBLE) AS row_key, o_orderstatus, NULL AS l_tax FROM orders
 UNION ALL SELECT l_quantity, NULL, l_tax FROM lineitem""")
def _(t):
    a = t.raw("orders").select(F.col("o_orderkey").alias("row_key"), "o_orderstatus")
    b = t.raw("lineitem").select(F.col("l_quantity").alias("row_key"), "l_tax")
    return T.diagonal_union(a, b)


@query("set_union_distinct", """WITH a AS (SELECT DISTINCT concat('{"q":', CAST(l_quantity AS INT), '}') AS cand, CAST(l_quantity AS INT) AS pos FROM lineitem WHERE l_returnflag = 'A'),
 b AS (SELECT DISTINCT concat('{"q":', CAST(l_quantity AS INT) + 10, '}') AS cand, CAST(l_quantity AS INT) AS pos FROM lineitem WHERE l_returnflag <> 'A'),
 u AS (SELECT *, 0 AS source_list FROM a UNION ALL SELECT *, 1 FROM b),
 n AS (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY source_list, pos) AS rn FROM u) SELECT cand, source_list, pos FROM n WHERE rn = 1""")
def _(t):
    def side(first, shift):
        q = F.col("l_quantity").cast("int")
        rows = t.raw("lineitem").filter((F.col("l_returnflag") == "A") == F.lit(first))
        return rows.select(F.to_json(F.struct((q + shift).alias("q"))).alias("cand"), q.alias("pos")).distinct()

    return T.union_candidates(side(True, 0), side(False, 10), "cand", "pos")


# --- table maintenance -------------------------------------------------------------------------------------------------


def _newer(t):
    """Later submissions of the customers as updates of one state row per customer."""
    rows = t.subs.select("competition_id", "submission_id", "submitted_at", "status", "lb_score")
    return rows.filter("submitted_at < TIMESTAMP_NTZ'1998-01-01 00:00:00'"), rows.filter("submitted_at >= TIMESTAMP_NTZ'1998-01-01 00:00:00'")


_STATE = """st AS (SELECT competition_id, arg_max(submission_id, (submitted_at, submission_id)) AS submission_id, max(submitted_at) AS submitted_at,
 arg_max(status, (submitted_at, submission_id)) AS status, arg_max({'v': lb_score}, (submitted_at, submission_id)).v AS lb_score FROM subs WHERE submitted_at < TIMESTAMP '1998-01-01' GROUP BY 1),
 up AS (SELECT competition_id, arg_max(submission_id, (submitted_at, submission_id)) AS submission_id, max(submitted_at) AS submitted_at,
 arg_max(status, (submitted_at, submission_id)) AS status, arg_max({'v': lb_score}, (submitted_at, submission_id)).v AS lb_score FROM subs WHERE submitted_at >= TIMESTAMP '1998-01-01' GROUP BY 1)"""


@query("snk_append", """SELECT submission_id, competition_id, status, lb_score FROM subs WHERE submitted_at < TIMESTAMP '1998-01-01'
 UNION ALL SELECT submission_id, competition_id, status, NULL FROM subs WHERE submitted_at >= TIMESTAMP '1998-01-01'""")
def _(t):
    old, new = _newer(t)
    return tables.append_rows(old.drop("submitted_at"), new.select("status", "submission_id", "competition_id"))


@query("snk_insert_if_absent", f"""WITH {_STATE}, fi AS (SELECT competition_id, min(submission_id) AS submission_id FROM
 (SELECT *, row_number() OVER (PARTITION BY competition_id ORDER BY submitted_at, submission_id) AS rn FROM subs WHERE submitted_at >= TIMESTAMP '1998-01-01') WHERE rn = 1 GROUP BY 1)
 SELECT competition_id, submission_id FROM st UNION ALL SELECT competition_id, submission_id FROM fi WHERE competition_id NOT IN (SELECT competition_id FROM st)""")
def _(t):
    old, new = _newer(t)
    state = tables.newest_by_key(old, ["competition_id"], ["submitted_at", "submission_id"])
    return tables.insert_if_absent(state, new, ["competition_id"], ["submitted_at", "submission_id"]).select("competition_id", "submission_id")


@query("snk_upsert", f"""WITH {_STATE} SELECT competition_id, CASE WHEN up.competition_id IS NOT NULL THEN up.submission_id ELSE st.submission_id END AS submission_id,
 coalesce(up.submitted_at, st.submitted_at) AS submitted_at, coalesce(up.status, st.status) AS status,
 CASE WHEN up.competition_id IS NOT NULL THEN up.lb_score ELSE st.lb_score END AS lb_score FROM st FULL OUTER JOIN up USING (competition_id)""")
def _(t):
    old, new = _newer(t)
    state = tables.newest_by_key(old, ["competition_id"], ["submitted_at", "submission_id"])
    return tables.upsert(state, new, ["competition_id"], ["submitted_at", "submission_id"])


@query("snk_upsert_keep", f"""WITH {_STATE} SELECT competition_id, coalesce(up.submission_id, st.submission_id) AS submission_id,
 coalesce(st.lb_score, up.lb_score) AS lb_score FROM st FULL OUTER JOIN up USING (competition_id)""")
def _(t):
    old, new = _newer(t)
    state = tables.newest_by_key(old, ["competition_id"], ["submitted_at", "submission_id"])
    return tables.upsert(state, new, ["competition_id"], ["submitted_at", "submission_id"], keep=["lb_score"]).select("competition_id", "submission_id", "lb_score")


@query("snk_update_where", """SELECT submission_id, CASE WHEN status = 'submitted' AND checked_at IS NULL THEN 'unknown' ELSE status END AS status,
 coalesce(status = 'submitted' AND checked_at IS NULL, false) AS changed FROM subs""")
def _(t):
    rows = t.subs.select("submission_id", "status", "checked_at")
    updated, changed = tables.update_where(rows, (F.col("status") == "submitted") & F.col("checked_at").isNull(), {"status": F.lit("unknown")})
    mark = changed.select("submission_id", F.lit(True).alias("changed"))
    return updated.drop("checked_at").join(mark, "submission_id", "left").fillna({"changed": False})


@query("snk_backfill_prefix", """SELECT submission_id, message, CASE WHEN lb_score IS NULL AND starts_with(message, 'auto 1') THEN 0e0 ELSE lb_score END AS lb_score FROM subs""")
def _(t):
    return tables.fill_by_prefix(t.subs.select("submission_id", "message", "lb_score"), "message", "auto 1", "lb_score", F.lit(0.0))


@query("snk_ttl", f"""SELECT attempt_id, run_ts FROM attempts WHERE run_ts > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 7 DAY""")
def _(t):
    return tables.ttl(t.attempts.select("attempt_id", "run_ts"), "run_ts", "'7' DAY", at(EVENTS_NOW))


@query("snk_cascade_delete", """SELECT 'attempts' AS tab, competition_id, count(*) AS n FROM attempts WHERE competition_id NOT IN
 (SELECT competition_id FROM competitions WHERE auto_submit_paused_reason IS NOT NULL) GROUP BY 2 UNION ALL
 SELECT 'subs', competition_id, count(*) FROM subs WHERE competition_id NOT IN (SELECT competition_id FROM competitions WHERE auto_submit_paused_reason IS NOT NULL) GROUP BY 2""")
def _(t):
    gone = t.competitions.filter("auto_submit_paused_reason IS NOT NULL").select("competition_id")
    left = tables.delete_keys({"attempts": t.attempts, "subs": t.subs}, gone)
    parts = [df.groupBy(F.lit(n).alias("tab"), "competition_id").agg(F.count(F.lit(1)).alias("n")) for n, df in left.items()]
    return parts[0].unionByName(parts[1])
