"""Streaming jobs over the given tables, read as file streams and processed to the end."""

from pyspark.sql import functions as F

from ..functions import text
from ..session import work_dir
from ..sources.changelog import ChangeLog
from ..streaming import jobs as J, keyed
from . import query, roles
from .aggregates import NEWEST
from .shared import at, r
from .views import PROGRESS, TRIPWIRE

DELAY = "1 hour"
MARK = "(SELECT max(run_ts) - INTERVAL 1 HOUR FROM attempts)"


BATCHES = 4
FILE_ROWS = 1_000_000
_split: dict[tuple, tuple[str, int]] = {}


def _stream(t, table: str, ts: str):
    """The whole table as a stream of four micro-batches in order of time, from files written once per session.

    Every range of time is written by as many tasks as it has millions of rows, one file each, and a micro-batch takes that many.
    """
    source = t.raw(table)
    key = (t.spark.sparkContext.applicationId, t.dir, table)
    if key not in _split:
        micros = F.unix_micros(F.col(ts).cast("timestamp"))
        cuts, rows = source.agg(F.percentile_approx(micros, [i / BATCHES for i in range(1, BATCHES)], 10_000), F.count("*")).first()
        place = sum(((micros > c).cast("int") for c in sorted(set(cuts or []))), F.lit(0))
        files = 1 + rows // (BATCHES * FILE_ROWS)
        path = work_dir(t.spark)
        for i in range(BATCHES):  # one append after the other, so the files are in order of time
            source.filter(F.coalesce(place, F.lit(0)) == i).repartition(files).write.mode("append").parquet(path)
        _split[key] = path, files
    path, files = _split[key]
    return t.spark.readStream.schema(source.schema).option("maxFilesPerTrigger", files).parquet(path)


def _attempts(t):
    """Attempts as a stream; event time as TIMESTAMP, which watermarks need."""
    return roles.project(_stream(t, "events", "ts"), "attempts").withColumn("run_ts", F.col("run_ts").cast("timestamp"))


def _plain(df):
    """Timestamps back without zone, as in the tables."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if k == "timestamp" else F.col(c) for c, k in df.dtypes])


@query("st_activity", f"""WITH w AS (SELECT unnest(generate_series(date_trunc('day', run_ts) - INTERVAL 13 DAY, date_trunc('day', run_ts), INTERVAL 1 DAY)) AS s, competition_id, label FROM attempts)
 SELECT CAST(s AS TIMESTAMP) AS window_start, CAST(s + INTERVAL 14 DAY AS TIMESTAMP) AS window_end, competition_id, count(*) AS attempts, count(*) FILTER (WHERE label = 'jump') AS jumps, count(*) FILTER (WHERE label = 'error') AS errors
 FROM w WHERE s + INTERVAL 14 DAY <= {MARK} GROUP BY 1, 2, 3""")
def _(t):
    return _plain(J.run_append(J.stream_activity(_attempts(t), DELAY), work_dir(t.spark)))


@query("st_pacing", f"""WITH w AS (SELECT '5 hours' AS length, time_bucket(INTERVAL 5 HOUR, run_ts, TIMESTAMP '1970-01-01') AS s, INTERVAL 5 HOUR AS l FROM attempts
 UNION ALL SELECT '7 days', time_bucket(INTERVAL 7 DAY, run_ts, TIMESTAMP '1970-01-01'), INTERVAL 7 DAY FROM attempts)
 SELECT length, s AS window_start, count(*) AS attempts, count(*) >= CASE WHEN length = '5 hours' THEN 60 ELSE 2000 END AS over FROM w WHERE s + l <= {MARK} GROUP BY 1, 2""")
def _(t):
    return _plain(J.run_append(J.stream_pacing(_attempts(t), {"5 hours": 60, "7 days": 2000}, DELAY), work_dir(t.spark)))


@query("st_sessions", f"""WITH g AS (SELECT competition_id, run_ts, CASE WHEN run_ts - lag(run_ts) OVER (PARTITION BY competition_id ORDER BY run_ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM attempts),
 s AS (SELECT *, sum(b) OVER (PARTITION BY competition_id ORDER BY run_ts) AS n FROM g)
 SELECT competition_id, min(run_ts) AS session_start, max(run_ts) + INTERVAL 6 HOUR AS idle_since, count(*) AS attempts FROM s GROUP BY competition_id, n HAVING max(run_ts) + INTERVAL 6 HOUR <= {MARK}""")
def _(t):
    return _plain(J.run_append(J.stream_idle(_attempts(t), "6 hours", DELAY), work_dir(t.spark)))


@query("st_dedup", """SELECT competition_id, sha256(concat_ws('|', printf('%,.9f', cv_score), array_to_string(list_transform(coalesce(fold_scores, []), lambda x: printf('%,.9f', x)), ','))) AS behaviour
 FROM attempts WHERE cv_score IS NOT NULL GROUP BY 1, 2""")
def _(t):
    fresh = J.stream_dedup(_attempts(t).filter("cv_score IS NOT NULL"), DELAY)
    log = ChangeLog(t.spark, work_dir(t.spark), fresh.schema, ["competition_id", "behaviour"], ["behaviour"], buckets=8)
    return J.first_of_keys(fresh, log, work_dir(t.spark))


@query("st_progress", PROGRESS)
def _(t):
    return _plain(keyed.run_keyed(keyed.progress(_attempts(t), t.competitions), work_dir(t.spark)))


@query("st_error_recurrence", """SELECT attempt_id, run_ts, competition_id, action_type, error_signature, row_number() OVER w AS occurrence_no, row_number() OVER w >= 3 AS alert FROM signed_attempts
 WHERE label = 'error' AND error_signature IS NOT NULL WINDOW w AS (PARTITION BY competition_id, action_type, error_signature ORDER BY run_ts, attempt_id)""")
def _(t):
    signed = _attempts(t).withColumn("error_signature", text.error_signature(F.col("error_trace")))
    return _plain(keyed.run_keyed(keyed.error_recurrence(signed), work_dir(t.spark)))


@query("st_bandit", "SELECT scope, scope_key, action_type, round(alpha, 6) AS alpha, round(beta, 6) AS beta, updates FROM bandit")
def _(t):
    return r(keyed.newest(keyed.run_keyed(keyed.beliefs(_attempts(t)), work_dir(t.spark)).withColumn("v", F.col("updates")), ["scope", "scope_key", "action_type"], "v"))


@query("st_stagnation", f"""SELECT competition_id, count(*) FILTER (WHERE label = 'jump') AS jumps_in_window, coalesce(min(rn) FILTER (WHERE label = 'jump') - 1, count(*)) AS stagnant_for,
 coalesce(min(rn) FILTER (WHERE label = 'jump') - 1, count(*)) >= 3 AS is_stagnant FROM (SELECT *, row_number() OVER {NEWEST} AS rn FROM attempts WHERE was_promoted) WHERE rn <= 5 GROUP BY 1""")
def _(t):
    return keyed.newest(keyed.run_keyed(keyed.stagnation(_attempts(t)), work_dir(t.spark), expiring=True), ["competition_id"], "seen")


@query("st_tripwire", TRIPWIRE)
def _(t):
    subs = roles.project(_stream(t, "orders", "o_orderdate"), "subs")
    found = keyed.tripwire(subs, _attempts(t), t.competitions)
    return keyed.newest(keyed.run_keyed(found, work_dir(t.spark), expiring=True), ["competition_id"], "seen")


@query("st_ledger_upsert", """SELECT competition_id, arg_max(submission_id, (submitted_at, submission_id)) AS submission_id, max(submitted_at) AS submitted_at, arg_max(status, (submitted_at, submission_id)) AS status FROM subs GROUP BY 1""")
def _(t):
    subs = roles.project(_stream(t, "orders", "o_orderdate"), "subs").select("competition_id", "submission_id", "submitted_at", "status")
    log = ChangeLog(t.spark, work_dir(t.spark), subs.schema, ["competition_id"], ["submitted_at", "submission_id"], buckets=8)
    return J.upsert_stream(subs, log, work_dir(t.spark), compact_every=2)


@query("st_gate", f"""WITH d AS (SELECT super_cycle_id, run_ts AS t, attempt_id, cv_score IS NOT NULL AND NOT coalesce(futility_early_exit, false) AS ok,
 row_number() OVER (PARTITION BY super_cycle_id ORDER BY run_ts, attempt_id) AS rn FROM attempts WHERE cv_score IS NOT NULL OR error_trace IS NOT NULL),
 q AS (SELECT *, CASE WHEN ok THEN count(*) FILTER (WHERE ok) OVER (PARTITION BY super_cycle_id ORDER BY rn) END AS s FROM d),
 x AS (SELECT super_cycle_id, min(t) FILTER (WHERE s = 2) AS tq, min(t) FILTER (WHERE rn = 3) AS ta, min(t) AS d1 FROM q GROUP BY 1),
 a AS (SELECT super_cycle_id, min(run_ts) AS st, max(run_ts) AS ls, min(run_ts) FILTER (WHERE NOT coalesce(futility_early_exit, false)) AS f FROM attempts GROUP BY 1),
 e AS (SELECT *, greatest(CASE WHEN f IS NOT NULL THEN d1 END, CASE WHEN d1 IS NOT NULL THEN f + INTERVAL 900 SECOND END) AS tg, st + INTERVAL 3000 SECOND AS tm FROM a LEFT JOIN x USING (super_cycle_id)),
 v AS (SELECT *, least(tq, ta, tg, tm) AS fired_at FROM e)
 SELECT super_cycle_id, CASE WHEN fired_at = tq THEN 'quorum' WHEN fired_at = ta THEN 'all_done' WHEN fired_at = tg THEN 'grace' ELSE 'maxwait' END AS reason,
 count(*) FILTER (WHERE q.ok AND q.t <= fired_at) AS n_success, count(*) FILTER (WHERE q.t <= fired_at) AS n_done, fired_at FROM v LEFT JOIN q USING (super_cycle_id)
 WHERE fired_at <= {MARK} OR fired_at <= ls GROUP BY super_cycle_id, fired_at, tq, ta, tg""")
def _(t):
    return _plain(keyed.run_keyed(keyed.gate(_attempts(t), DELAY, keep_sec=86_400), work_dir(t.spark)))


@query("st_gate_batch", """WITH g AS (SELECT super_cycle_id, count(*) FILTER (WHERE cv_score IS NOT NULL AND NOT coalesce(futility_early_exit, false)) AS s, count(*) FILTER (WHERE cv_score IS NOT NULL OR error_trace IS NOT NULL) AS d,
 epoch(TIMESTAMP '2024-01-31' - min(run_ts) FILTER (WHERE NOT coalesce(futility_early_exit, false))) AS sp, epoch(TIMESTAMP '2024-01-31' - min(run_ts)) AS w FROM attempts GROUP BY 1)
 SELECT super_cycle_id, CASE WHEN s >= 2 THEN 'quorum' WHEN d >= 3 THEN 'all_done' WHEN d >= 1 AND sp >= 900 THEN 'grace' WHEN w >= 3000 THEN 'maxwait' END AS reason FROM g""")
def _(t):
    from ..functions import rules
    from ..operators import summaries

    now = at("2024-01-31 00:00:00")
    waited = t.attempts.groupBy("super_cycle_id").agg(rules.seconds_between(F.min("run_ts"), now).alias("waited"))
    counts = summaries.gate_counts(t.attempts, now).join(waited, "super_cycle_id")
    reason = J.gate_reason(F.col("n_success"), F.col("n_done"), F.col("span_sec"), F.col("waited"))
    return counts.select("super_cycle_id", reason.alias("reason"))
