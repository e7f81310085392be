"""Queries over column functions: text, rules, arrays, hashes, dates."""

from pyspark.sql import functions as F

from ..functions import arrays, rules, text
from . import query
from .roles import signature_sql
from .shared import EVENTS_NOW, ORDERS_NOW, at, r

WORDS = "model = LGBMClassifier(class_weight=1); x.alias('n_{0}'); y.alias( \"m\" ); RandomForestRegressor(); LogisticRegression(sample_weight); "


@query("fn_error_signature", f"""SELECT 'attempt' AS origin, attempt_id AS id, {signature_sql('error_trace')} AS signature FROM attempts WHERE error_trace IS NOT NULL
 UNION ALL SELECT 'document', doc_id, {signature_sql('text')} FROM documents""")
def _(t):
    a = t.attempts.filter("error_trace IS NOT NULL").select(F.lit("attempt").alias("origin"), F.col("attempt_id").alias("id"), text.error_signature(F.col("error_trace")).alias("signature"))
    d = t.raw("documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), text.error_signature(F.col("text")).alias("signature"))
    return a.unionByName(d)


@query("fn_kill_progress", """SELECT attempt_id, nullif(regexp_extract(error_trace, '\\[last_progress\\] stage=(\\S+)( fold=\\d+/\\d+)?', 1), '') AS stage,
 nullif(regexp_extract(error_trace, '\\[last_progress\\] stage=\\S+ (fold=\\d+/\\d+)', 1), '') AS fold FROM attempts WHERE error_trace IS NOT NULL""")
def _(t):
    rows = t.attempts.filter("error_trace IS NOT NULL").select("attempt_id", text.kill_stage(F.col("error_trace")).alias("k"))
    return rows.select("attempt_id", "k.stage", "k.fold")


@query("fn_code_facts", f"""WITH s AS (SELECT page_id, concat('{WORDS.replace("{0}", "")}', html) AS src FROM pages)
 SELECT page_id, array_to_string(list_distinct_ordered, ',') AS models, array_to_string(cols, ',') AS columns, array_to_string(wts, ',') AS weighting FROM (SELECT page_id,
 list_filter(m, lambda x, i: list_position(m, x) = i) AS list_distinct_ordered, list_filter(c, lambda x, i: list_position(c, x) = i) AS cols,
 list_filter(w, lambda x, i: list_position(w, x) = i) AS wts FROM (SELECT page_id, regexp_extract_all(src, '{text.MODEL_CLASS}') AS m,
 regexp_extract_all(src, '{text.ALIAS_CALL.replace("'", "''")}', 1) AS c, regexp_extract_all(src, '{text.WEIGHTING_WORD}', 1) AS w FROM s))""".replace("x.alias('n_')", "x.alias(''n_'')"))
def _(t):
    src = F.concat(F.lit(WORDS.replace("{0}", "")), F.col("html"))
    facts = t.raw("pages").select("page_id", text.code_facts(src).alias("f"))
    return facts.select("page_id", *[F.array_join(f"f.{c}", ",").alias(c) for c in ("models", "columns", "weighting")])


@query("fn_failure_class", """SELECT attempt_id, CASE WHEN starts_with(error_trace, 'cpu budget exceeded') AND action_type = 'ensemble' THEN 'cpu_ensemble'
 WHEN starts_with(error_trace, 'cpu budget exceeded') AND action_type IN ('feature_engineering', 'preprocessing') THEN 'cpu_features'
 WHEN contains(error_trace, 'during preselect') THEN 'cpu_preselect' WHEN starts_with(error_trace, 'cpu budget exceeded') THEN 'cpu'
 WHEN starts_with(error_trace, 'memory watchdog') THEN 'memory' WHEN contains(error_trace, 'could not convert string to float') THEN 'dtype'
 WHEN error_trace IS NOT NULL THEN 'other' END AS failure FROM attempts""")
def _(t):
    return t.attempts.select("attempt_id", text.failure_class(F.col("error_trace"), F.col("action_type")).alias("failure"))


@query("fn_lesson_type", """SELECT attempt_id, CASE WHEN error_trace <> '' THEN 'failure' WHEN label = 'jump' THEN 'recommend' WHEN label = 'regression' THEN 'avoid' ELSE 'no_op' END AS lesson_type FROM attempts""")
def _(t):
    return t.attempts.select("attempt_id", rules.lesson_type(F.col("label"), F.col("error_trace")).alias("lesson_type"))


@query("fn_noise_tolerance", "SELECT attempt_id, round(greatest(1e-6, 1e-6 * abs(cv_score)), 9) AS tolerance FROM attempts WHERE cv_score IS NOT NULL")
def _(t):
    rows = t.attempts.filter("cv_score IS NOT NULL")
    return rows.select("attempt_id", F.round(rules.noise_tolerance(F.col("cv_score")), 9).alias("tolerance"))


@query("fn_signature9", """SELECT sha256(concat_ws('|', printf('%,.9f', cv_score), array_to_string(list_transform(fold_scores, lambda x: printf('%,.9f', x)), ','))) AS behaviour, count(*) AS n
 FROM (SELECT cv_score, coalesce(fold_scores, []) AS fold_scores FROM attempts) GROUP BY 1""")
def _(t):
    key = rules.behaviour_key(F.col("cv_score"), F.col("fold_scores"))
    return t.attempts.groupBy(key.alias("behaviour")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_traffic_light", """SELECT competition_id, CASE WHEN e / n > 0.3 THEN 'red' WHEN j / n > 0.25 THEN 'green' ELSE 'amber' END AS light FROM
 (SELECT competition_id, count(*) AS n, count(*) FILTER (WHERE label = 'error') AS e, count(*) FILTER (WHERE label = 'jump') AS j FROM attempts GROUP BY 1)""")
def _(t):
    n = F.count(F.lit(1))
    shares = t.attempts.groupBy("competition_id").agg((F.count_if(F.col("label") == "error") / n).alias("e"), (F.count_if(F.col("label") == "jump") / n).alias("j"))
    return shares.select("competition_id", rules.traffic_light(F.col("j") > 0.25, F.col("e") > 0.3).alias("light"))


@query("fn_refresh_due", f"""SELECT submission_id, checked_at IS NULL OR epoch(TIMESTAMP '{ORDERS_NOW}' - checked_at) >= CASE WHEN a < 600 THEN 120 WHEN a < 3600 THEN 600 WHEN a < 21600 THEN 1800 ELSE 7200 END AS due
 FROM (SELECT *, epoch(TIMESTAMP '{ORDERS_NOW}' - submitted_at) AS a FROM subs)""")
def _(t):
    return t.subs.select("submission_id", rules.refresh_due(F.col("submitted_at"), F.col("checked_at"), at(ORDERS_NOW)).alias("due"))


_SEEN = "CASE WHEN o_orderkey % 4 = 0 THEN 'not_found' WHEN o_orderkey % 4 = 1 THEN 'pending' WHEN o_orderkey % 4 = 2 THEN 'complete' ELSE 'invalid' END"


@query("fn_submission_state", f"""SELECT submission_id, CASE WHEN status IN ('complete', 'error', 'invalid') THEN status
 WHEN seen = 'not_found' AND epoch(TIMESTAMP '{ORDERS_NOW}' - submitted_at) >= 86400 THEN 'unknown' WHEN seen IN ('not_found', 'pending') THEN status ELSE seen END AS state
 FROM (SELECT *, {_SEEN.replace('o_orderkey', 'submission_id')} AS seen FROM subs)""")
def _(t):
    seen = F.expr(_SEEN.replace("o_orderkey", "submission_id"))
    return t.subs.select("submission_id", rules.submission_state(F.col("status"), seen, F.col("submitted_at"), at(ORDERS_NOW)).alias("state"))


# Progress lines of one attempt per super cycle, built from the ledger: start, one line per finished fold, now.
PROGRESS_LINES = """SELECT super_cycle_id, line_no, line FROM (SELECT super_cycle_id, 0 AS line_no, 'stage=preselect_done cpu=10' AS line FROM attempts GROUP BY 1
 UNION ALL SELECT super_cycle_id, row_number() OVER (PARTITION BY super_cycle_id ORDER BY run_ts, attempt_id) AS line_no,
 concat('stage=fold_done fold=', CAST(row_number() OVER (PARTITION BY super_cycle_id ORDER BY run_ts, attempt_id) AS {text}), '/9 cpu=',
 CAST(10 + 30 * row_number() OVER (PARTITION BY super_cycle_id ORDER BY run_ts, attempt_id) AS {text})) AS line FROM attempts)"""


@query("fn_cpu_projection", f"""WITH l AS ({PROGRESS_LINES.format(text='VARCHAR')}), p AS (SELECT super_cycle_id, max(line_no) AS done, max(CAST(regexp_extract(line, 'cpu=(\\d+)', 1) AS DOUBLE)) AS last FROM l GROUP BY 1)
 SELECT super_cycle_id, CAST(done + 1 AS BIGINT) AS fold, round(last + (9 - done) * greatest(25e0, CASE WHEN done > 0 THEN (last - 10) / done ELSE 0 END), 6) AS projected FROM p WHERE done < 9""")
def _(t):
    from ..operators import progress

    t.attempts.createOrReplaceTempView("ledgerlark_progress_source")
    lines = t.spark.sql(PROGRESS_LINES.format(text="STRING").replace("FROM attempts", "FROM ledgerlark_progress_source"))
    now = lines.groupBy("super_cycle_id").agg((F.max(F.regexp_extract("line", r"cpu=(\d+)", 1).cast("double")) + 25.0).alias("cpu_now"))
    return r(progress.project_cpu(lines, now, "super_cycle_id", "line_no", "line", 9).select("super_cycle_id", "fold", "projected"))


# --- the scalar groups -----------------------------------------------------------------------------------------------------


@query("sc_math", """SELECT attempt_id, round(abs(gain_vs_best), 6) AS a, round(sqrt(cv_fold_var), 6) AS s, greatest(cv_score, holdout_score) AS g,
 round(cv_score / nullif(cv_fold_var, 0), 6) AS q, round(ln(cv_score + 1), 6) AS l, least(greatest(cv_score, 10), 60) AS c FROM attempts""")
def _(t):
    cv = F.col("cv_score")
    return r(t.attempts.select(
        "attempt_id", F.abs("gain_vs_best").alias("a"), F.sqrt("cv_fold_var").alias("s"), F.greatest(cv, "holdout_score").alias("g"),
        F.try_divide(cv, F.col("cv_fold_var")).alias("q"), F.log(cv + 1).alias("l"), F.least(F.greatest(cv, F.lit(10.0)), F.lit(60.0)).alias("c"),
    ))


@query("sc_nulls", """SELECT attempt_id, coalesce(hypothesis, 'none') AS h, was_promoted IS NOT FALSE AS keep FROM attempts""")
def _(t):
    return t.attempts.select("attempt_id", F.coalesce("hypothesis", F.lit("none")).alias("h"), rules.is_not_false(F.col("was_promoted")).alias("keep"))


@query("sc_strings", """SELECT doc_id, length(trim(text)) AS n, left(regexp_replace(text, '[ \\n\\r\\t]+', ' ', 'g'), 40) AS head, split_part(source, 'c', 2) AS part, concat_ws('|', lang, source) AS both FROM documents""")
def _(t):
    return t.raw("documents").select(
        "doc_id", F.length(F.trim("text")).cast("long").alias("n"), F.left(F.regexp_replace("text", r"[ \n\r\t]+", " "), F.lit(40)).alias("head"),
        F.split_part("source", F.lit("c"), F.lit(2)).alias("part"), F.concat_ws("|", "lang", "source").alias("both"),
    )


@query("sc_dates", f"""SELECT attempt_id, date_trunc('day', run_ts)::TIMESTAMP AS day, round(epoch(TIMESTAMP '{EVENTS_NOW}' - run_ts) / 864e2, 6) AS days_ago, run_ts - INTERVAL 14 DAY AS earlier FROM attempts""")
def _(t):
    ts = F.col("run_ts")
    return r(t.attempts.select("attempt_id", F.date_trunc("DAY", ts).cast("timestamp_ntz").alias("day"), (rules.seconds_between(ts, at(EVENTS_NOW)) / 86400.0).alias("days_ago"), (ts - F.expr("INTERVAL '14' DAY")).alias("earlier")))


@query("sc_arrays", """SELECT attempt_id, coalesce(len(reflection_ids), 0) AS n, fold_scores[1] AS first_fold, round(list_sum(list_transform(fold_scores, lambda x: x - cv_score)), 6) AS delta_sum FROM attempts""")
def _(t):
    f = F.col("fold_scores")
    delta = arrays.total(F.transform(f, lambda x: x - F.col("cv_score")))
    size = F.when(F.col("reflection_ids").isNull(), 0).otherwise(F.size("reflection_ids")).cast("long")
    return t.attempts.select("attempt_id", size.alias("n"), F.get(f, F.lit(0)).alias("first_fold"), F.round(delta, 6).alias("delta_sum"))


@query("sc_hashes", """SELECT doc_id, sha256(text) AS text_sha, sha256(concat(lang, chr(0), source, chr(0))) AS parts_sha FROM documents""")
def _(t):
    parts = F.concat("lang", F.lit("\0"), "source", F.lit("\0"))
    return t.raw("documents").select("doc_id", F.sha2("text", 256).alias("text_sha"), F.sha2(parts, 256).alias("parts_sha"))
