"""The driver's tables in the role of ledger tables.

The ledger itself is not part of the test data, so each of its tables is a projection of a given table. Both
engines get the same projection: expressions for Spark, a common table expression for the SQL side.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..operators import views

# The instants the queries take as "now" (inputs, so results repeat).
NOW_EVENTS = "2024-01-31 00:00:00"
NOW_ORDERS = "2001-08-02 12:00:00"
NOW_TUNES = "2001-11-05 00:00:00"

_ACTION = """CASE {k} % 5 WHEN 0 THEN 'feature_engineering' WHEN 1 THEN 'preprocessing' WHEN 2 THEN 'model_swap'
 WHEN 3 THEN 'hyperparam_search' ELSE 'ensemble' END"""
_LABEL = """CASE event_type WHEN 'purchase' THEN 'jump' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'regression'
 ELSE 'neutral' END"""

# Expressions both engines read alike; {arr} is the array constructor, {json} the id inside props.
_ATTEMPTS = {
    "attempt_id": "event_id",
    "competition_id": "user_id",
    "run_ts": "ts",
    "stage": "CASE WHEN k < 10 THEN 'bootstrap' WHEN k < 90 THEN 'reflexion' ELSE 'exploitation' END",
    "action_type": _ACTION.format(k="k"),
    "model_type": "CASE k % 3 WHEN 0 THEN 'lgbm' WHEN 1 THEN 'ridge' ELSE 'random_forest' END",
    "hypothesis": "CASE WHEN k % 11 = 0 THEN NULL ELSE concat('try variant ', CAST(k AS {text}), '  of  ', event_type) END",
    "cv_score": "CASE WHEN event_type <> 'error' THEN value END",
    "cv_fold_var": "CASE WHEN event_type <> 'error' AND k % 13 <> 0 THEN k * 1e-2 END",
    "fold_scores": "CASE WHEN event_type <> 'error' AND k % 17 <> 0 THEN "
    "{arr}(value - 5e-1, value - 25e-2, value, value + 25e-2, value + 5e-1 + k * 1e-2) END",
    "lb_score": "CASE WHEN event_type = 'purchase' THEN value + k * 1e-2 END",
    "label": _LABEL,
    "gain_vs_best": "CASE WHEN event_type <> 'error' THEN (value - 5e1) / 1e2 END",
    "gain_vs_best_relative": "CASE WHEN event_type NOT IN ('error', 'click') THEN (value - 5e1) / 2e2 END",
    "error_trace": """CASE WHEN event_type = 'error' THEN CASE k % 4
 WHEN 0 THEN concat('Traceback (most recent call last):{nl}  File "/srv/app/run.py", line ', CAST(k AS {text}),
   '{nl}lib.core.ValueError: could not convert string to float: "v', CAST(k AS {text}), '"')
 WHEN 1 THEN concat('cpu budget exceeded: ', CAST(3600 + k AS {text}), 's CPU used (limit 3600s){nl}[last_progress] stage=fold_done fold=',
   CAST(1 + k % 5 AS {text}), '/5 cpu=', CAST(k * 36 AS {text}))
 WHEN 2 THEN concat('runner exited without output.json (rc=-', CAST(9 + k % 3 AS {text}), ')')
 ELSE concat('memory watchdog: rss ', CAST(k AS {text}), '.5 GB{nl}KeyError: "col_', CAST(k AS {text}), '" at 0x1f', CAST(k AS {text}), ' in /tmp/x')
 END END""",
    "reflection_ids": "CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN {arr}(CAST(k AS BIGINT)) "
    "WHEN 2 THEN {arr}(CAST(k AS BIGINT), CAST(k + 100 AS BIGINT)) "
    "ELSE {arr}(CAST(k AS BIGINT), CAST(k + 100 AS BIGINT), CAST(k + 200 AS BIGINT)) END",
    "retrieved_ids": "CASE WHEN k % 4 = 0 THEN NULL ELSE {arr}(CAST(k AS BIGINT), CAST(k + 100 AS BIGINT), "
    "CAST(k + 200 AS BIGINT), CAST(k + 300 AS BIGINT)) END",
    "duration_sec": "value * 1e1",
    "peak_cpu_sec": "value * 3e1",
    "super_cycle_id": "concat(CAST(user_id AS {text}), '-', CAST(CAST(ts AS DATE) AS {text}))",
    "was_promoted": "CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END",
    "holdout_score": "CASE WHEN event_type <> 'error' AND k % 2 = 0 THEN value * 98e-2 END",
    "futility_early_exit": "CASE k % 7 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END",
    "code_path": "CASE WHEN k % 6 <> 0 THEN concat('runs/', CAST(event_id AS {text}), '.py') END",
}
_COMPETITIONS = {
    "competition_id": "c_custkey",
    "name": "concat('playground-series-s', CAST(c_custkey AS {text}))",
    "metric_sign": "CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END",
    "task_type": "CASE c_mktsegment WHEN 'BUILDING' THEN 'binary' WHEN 'MACHINERY' THEN 'multiclass' ELSE 'regression' END",
    "metric": "CASE c_mktsegment WHEN 'BUILDING' THEN 'auc' WHEN 'MACHINERY' THEN 'accuracy' WHEN 'HOUSEHOLD' THEN 'mae' ELSE 'rmse' END",
    "size_class": "CASE WHEN c_acctbal < 0 THEN 'tiny' WHEN c_acctbal < 3e3 THEN 'small' WHEN c_acctbal < 7e3 THEN 'mid' ELSE 'large' END",
    "n_numeric": "c_nationkey",
    "n_categorical": "25 - c_nationkey",
    "missing_ratio_overall": "abs(c_acctbal) / 1e4",
    "cardinality_max": "CAST(c_nationkey * 40 AS BIGINT)",
    "target_stat": "c_nationkey * 2e-2",
    "auto_submit_paused_reason": "CASE WHEN c_acctbal < -2e2 THEN 'train_fp changed' WHEN c_acctbal < 0 THEN 'cv_lb_divergence' END",
    "train_fingerprint": "CASE WHEN c_nationkey > 3 THEN concat('fp', CAST(c_nationkey % 5 AS {text})) END",
    "is_active": "c_acctbal >= 1e3",
}
_LESSONS = {
    "reflection_id": "vec_id",
    "competition_id": "CAST(label AS BIGINT)",
    "attempt_id": "vec_id",
    "created_at": "TIMESTAMP{ntz} '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * vec_id",
    "embedding": "embedding",
    "embedded_text": "concat('lesson ', CAST(vec_id AS {text}))",
    "full_lesson": "concat('full lesson ', CAST(vec_id AS {text}))",
    "generality": "CASE vec_id % 3 WHEN 0 THEN 'L1_local' WHEN 1 THEN 'L2_class' ELSE 'L3_general' END",
    "lesson_type": "CASE vec_id % 4 WHEN 0 THEN 'failure' WHEN 1 THEN 'recommend' WHEN 2 THEN 'avoid' ELSE 'no_op' END",
    "lesson_label": "CASE vec_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'jump' WHEN 2 THEN 'regression' ELSE 'neutral' END",
    "gain_vs_best": "(vec_id % 97) / 1e3 - 5e-2",
    "archived": "vec_id % 10 = 9",
}
_PIPELINES = {
    "pipeline_id": "event_id",
    "attempt_id": "event_id",
    "competition_id": "user_id",
    "cv_score": "CASE WHEN k % 19 <> 0 THEN value END",
    "gain_vs_best": "(value - 4e1) / 1e2",
    "code": "concat('base ', CAST(k AS {text}))",
    "invalid_reason": "CASE WHEN k % 10 = 3 THEN 'leak' END",
    "materialized_origin": "CASE k % 5 WHEN 0 THEN 'unverifiable:cv_mismatch' WHEN 1 THEN NULL ELSE 'promote' END",
    "materialized_code": "CASE WHEN k % 3 <> 0 THEN concat('base ', CAST(k AS {text})) END",
    "materialized_sha256": "CASE WHEN k % 4 = 1 THEN sha{two}(concat('base ', CAST(k + k % 2 AS {text})){bits}) END",
    "pipeline_sha256": "CASE WHEN k % 7 <> 0 THEN sha{two}(concat('base ', CAST(k AS {text})){bits}) END",
    "fold_scores": "CASE WHEN k % 2 = 0 THEN {arr}(value - 4e-1, value - 2e-1, value, value + 2e-1, value + 4e-1) END",
}
_SUBMISSIONS = {
    "submission_id": "o_orderkey",
    "competition_id": "o_custkey",
    "attempt_id": "CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey END",
    "submitted_at": "o_orderdate",
    "message": "concat('auto ', o_orderpriority)",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'error' ELSE 'submitted' END",
    "lb_score": "CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 1e3 END",
    "checked_at": "CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate + INTERVAL '2' HOUR END",
    "lb_percentile": "CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN 5e1 END",
}
_BOARD = {"competition_id": "CAST(c_nationkey AS BIGINT)", "team_id": "c_custkey", "score": "c_acctbal / 2e1"}
_QUEUE = {
    "queue_id": "o_orderkey",
    "competition": "concat('s', CAST(o_custkey AS {text}))",
    "stage": "'reflexion'",
    "n_cycles": "20",
    "priority": "CAST(substr(o_orderpriority, 1, 1) AS INT)",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'failed' END",
    "created_at": "o_orderdate",
    "cycles_done": "CAST(o_orderkey % 20 AS INT)",
    "last_leased_at": "CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL '5' HOUR END",
}
_TUNES = {
    "tuning_run_id": "l_orderkey",
    "competition_id": "l_suppkey",
    "model_type": "CASE l_returnflag WHEN 'A' THEN 'lgbm' WHEN 'N' THEN 'xgboost' ELSE 'ridge' END",
    "member_index": "CASE WHEN l_linenumber > 1 THEN l_linenumber END",
    "cv_score": "l_extendedprice",
    "improved": "l_discount > 5e-2",
    "created_at": "l_shipdate",
}

# role -> (source table, filter, expressions, needs k from props)
_BOUND = {
    "attempts": ("events", None, _ATTEMPTS, True),
    "pipelines": ("events", "event_type = 'purchase'", _PIPELINES, True),
    "competitions": ("customer", None, _COMPETITIONS, False),
    "lessons": ("embeddings", None, _LESSONS, False),
    "subs": ("orders", None, _SUBMISSIONS, False),
    "board": ("customer", None, _BOARD, False),
    "queue": ("orders", None, _QUEUE, False),
    "tunes": ("lineitem", None, _TUNES, False),
}


def _spark(expr: str) -> str:
    return expr.format(arr="array", text="STRING", nl="\\n", ntz="_NTZ", two="2", bits=", 256")


def _duck(expr: str) -> str:
    return expr.format(arr="list_value", text="VARCHAR", nl="\n", ntz="", two="256", bits="")


class Roles:
    """Lazy role tables over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._frames: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in _BOUND:
            raise AttributeError(name)
        key = f"role {name}"
        if key not in self._frames:
            self._frames[key] = project(self.raw(_BOUND[name][0]), name)
        return self._frames[key]

    @cached_property
    def signed_attempts(self) -> DataFrame:
        """Attempts with the normalised signature of their error."""
        return self.attempts.withColumn("error_signature", text.error_signature(F.col("error_trace")))

    @cached_property
    def impact(self) -> DataFrame:
        return views.reflection_impact(self.attempts)

    @cached_property
    def bandit(self) -> DataFrame:
        return views.bandit_replay(self.attempts)


def project(source: DataFrame, role: str) -> DataFrame:
    """A given table in the role of a ledger table (also used on streams)."""
    _, where, exprs, has_k = _BOUND[role]
    if where:
        source = source.filter(where)
    if has_k:
        source = source.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return source.select(*[F.expr(_spark(e)).alias(c) for c, e in exprs.items()])


def _cte(name: str) -> str:
    source, where, exprs, has_k = _BOUND[name]
    origin = f"(SELECT *, CAST(props->>'$.k' AS INT) AS k FROM {source})" if has_k else source
    cols = ", ".join(f"{_duck(e)} AS {c}" for c, e in exprs.items())
    return f"SELECT {cols} FROM {origin} AS src" + (f" WHERE {where}" if where else "")


def signature_sql(col: str) -> str:
    """The SQL twin of the error signature over a text column."""
    def q(s: str) -> str:
        return s.replace("'", "''")

    def scrub(x: str) -> str:
        for p in text.VOLATILE:
            x = f"regexp_replace({x}, '{q(p)}', '<val>', 'g')"
        return f"regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"

    kept = (
        f"list_filter(list_transform(string_split_regex({col}, '\\r\\n|[\\n\\r\\x0B\\x0C]'), "
        "lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), "
        "lambda x: x <> '' AND NOT starts_with(x, '[last_progress] '))"
    )
    line = q(text.EXCEPTION_LINE)
    exc = f"list_filter({kept}, lambda x: regexp_matches(x, '{line}'))[-1]"
    last = f"{kept}[-1]"
    cls = f"string_split(regexp_extract({exc}, '{line}', 1), '.')[-1]"
    msg = scrub(f"regexp_extract({exc}, '{line}', 2)")
    syntax = ", ".join(f"'{s}'" for s in text.SYNTAX_ERRORS)
    return (
        f"CASE WHEN {exc} IS NOT NULL THEN CASE WHEN {cls} NOT IN ({syntax}) THEN {cls} || ': ' || {msg} END "
        f"WHEN regexp_matches({last}, '{q(text.RUNNER_EXIT)}') THEN {last} ELSE nullif({scrub(last)}, '') END"
    )


def numeric(expr: str, digits: int) -> str:
    """Decimal rounding, half away from zero, of a double: the rounding the views define."""
    return f"CAST(round(CAST({expr} AS DECIMAL(30, 12)), {digits}) AS DOUBLE)"


_DERIVED = {
    "signed_attempts": f"SELECT *, {signature_sql('error_trace')} AS error_signature FROM attempts",
    "impact": f"""SELECT c.reflection_id, count(*) AS times_applied, {numeric('sum(share) / count(*)', 5)} AS avg_gain,
 sum(CASE WHEN share > 0 THEN 1 ELSE 0 END)::BIGINT AS jumps, {numeric('max(share)', 5)} AS best_jump
 FROM (SELECT attempt_id, unnest(reflection_ids) AS reflection_id FROM attempts) c
 JOIN (SELECT attempt_id, gain_vs_best_relative / len(reflection_ids) AS share FROM attempts WHERE coalesce(was_promoted, true) AND stage = 'reflexion') USING (attempt_id)
 WHERE share IS NOT NULL GROUP BY 1""",
    "bandit": """SELECT 'local' AS scope, competition_id AS scope_key, action_type,
 1e0 + sum(da * pow(95e-2, later)) AS alpha, 1e0 + sum(db * pow(95e-2, later)) AS beta, count(*) AS updates FROM (
 SELECT competition_id, action_type,
 CASE WHEN error_trace IS NOT NULL OR label = 'regression' THEN 0e0 WHEN coalesce(abs(gain_vs_best) <= greatest(1e-6, 1e-6 * abs(cv_score)), false) THEN 0e0
  WHEN label = 'jump' THEN 1e0 WHEN gain_vs_best > 0 THEN 5e-1 ELSE 1e-1 END AS da,
 CASE WHEN error_trace IS NOT NULL OR label = 'regression' THEN 1e0 WHEN coalesce(abs(gain_vs_best) <= greatest(1e-6, 1e-6 * abs(cv_score)), false) THEN 1e0
  WHEN label = 'jump' THEN 0e0 ELSE 1e-1 END AS db,
 row_number() OVER (PARTITION BY competition_id, action_type ORDER BY run_ts DESC, attempt_id DESC) - 1 AS later
 FROM attempts) GROUP BY ALL""",
}
_ORDER = [*_BOUND, *_DERIVED]


def with_roles(sql: str) -> str:
    """Prefix a statement with the definitions of the roles it names, directly or through other roles."""
    needed: set[str] = set()

    def visit(body: str) -> None:
        for name in _ORDER:
            if name not in needed and re.search(rf"\b{name}\b", body):
                needed.add(name)
                visit(_DERIVED.get(name, ""))

    visit(sql)
    ctes = [f"{n} AS ({_DERIVED[n] if n in _DERIVED else _cte(n)})" for n in _ORDER if n in needed]
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        ctes.append(body[5:])
        return "WITH " + ", ".join(ctes)
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body
