"""Queries over metrics, ensembles and evaluation rules."""

from pyspark.sql import functions as F

from ..functions import arrays, rules
from ..operators import ensembles as E, metrics as M, prefix
from . import query
from .shared import r

# Predictions the tables imply: scores from keys, labels from line numbers and status, prices from quantities.
_PREDS = """SELECT l_linestatus AS part, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, ((l_partkey * 7919 + l_suppkey * 613 + l_linenumber * 31) % 1000) / 1e3 AS p,
 l_linenumber AS y_class, CAST(1 + (l_partkey * 7919 + l_suppkey) % 7 AS INT) AS p_class, CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS p_label,
 l_extendedprice AS y_num, l_quantity * 15e2 - 1e3 AS p_num FROM lineitem"""


def _preds(t):
    t.raw("lineitem").createOrReplaceTempView("ledgerlark_lines")
    return t.spark.sql(_PREDS.replace("FROM lineitem", "FROM ledgerlark_lines"))


def _metric(name, sql, y, p, digits=6):
    @query(f"ml_{name}", f"WITH v AS ({_PREDS}) {sql}".replace(") , ", "), "))
    def _(t):
        return r(M.get_metric(name)(_preds(t), y, p, ["part"]), digits)


_metric("auc", """, c AS (SELECT part, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM v GROUP BY 1, 2),
 d AS (SELECT *, sum(neg) OVER (PARTITION BY part ORDER BY p) - neg / 2 AS below FROM c) SELECT part, round(sum(pos * below) / (sum(pos) * sum(neg)), 6) AS score FROM d GROUP BY 1""", "y", "p")
_metric("logloss", """SELECT part, round(-avg(CASE WHEN y = 1 THEN ln(least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16))
 ELSE ln(1 - least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) END), 6) AS score FROM v GROUP BY 1""", "y", "p")
_metric("accuracy", "SELECT part, round(avg((y_class = p_class)::INT), 6) AS score FROM v GROUP BY 1", "y_class", "p_class")
_metric("f1", """SELECT part, round(2 * count(*) FILTER (WHERE y = 1 AND p_label = 1) / (2 * count(*) FILTER (WHERE y = 1 AND p_label = 1) + count(*) FILTER (WHERE y <> p_label)), 6) AS score FROM v GROUP BY 1""", "y", "p_label")
_metric("qwk", """, n AS (SELECT part, count(*) AS n FROM v GROUP BY 1), o AS (SELECT part, sum(pow(y_class - p_class, 2)) AS o FROM v GROUP BY 1),
 a AS (SELECT part, y_class AS i, count(*) AS c FROM v GROUP BY 1, 2), b AS (SELECT part, p_class AS j, count(*) AS c FROM v GROUP BY 1, 2),
 e AS (SELECT part, sum(a.c * b.c * pow(i - j, 2)) AS e FROM a JOIN b USING (part) GROUP BY 1)
 SELECT part, round(1 - o / (e / n), 6) AS score FROM o JOIN e USING (part) JOIN n USING (part)""", "y_class", "p_class")
_metric("balanced_accuracy", "SELECT part, round(avg(rec), 6) AS score FROM (SELECT part, y_class, avg((y_class = p_class)::INT) AS rec FROM v GROUP BY 1, 2) GROUP BY 1", "y_class", "p_class")
_metric("rmse", "SELECT part, round(sqrt(avg(pow(y_num - p_num, 2))), 4) AS score FROM v GROUP BY 1", "y_num", "p_num", 4)
_metric("mae", "SELECT part, round(avg(abs(y_num - p_num)), 4) AS score FROM v GROUP BY 1", "y_num", "p_num", 4)
_metric("rmsle", "SELECT part, round(sqrt(avg(pow(ln(1 + greatest(p_num, 0)) - ln(1 + y_num), 2))), 6) AS score FROM v GROUP BY 1", "y_num", "p_num")


@query("ml_metric_registry", f"""WITH v AS ({_PREDS}) SELECT 'mae' AS metric, -1 AS sign, round(avg(abs(y_num - p_num)), 4) AS score FROM v
 UNION ALL SELECT 'accuracy', 1, round(avg((y_class = p_class)::INT), 4) FROM v""")
def _(t):
    parts = []
    for name, y, p in (("MAE", "y_num", "p_num"), ("accuracy", "y_class", "p_class")):
        m = M.get_metric(name)
        parts.append(m(_preds(t), y, p).select(F.lit(m.name).alias("metric"), F.lit(m.sign).alias("sign"), "score"))
    return r(parts[0].unionByName(parts[1]), 4)


@query("udf_metric", f"WITH v AS ({_PREDS}) SELECT part, round(max(abs(y_num - p_num)), 4) AS score FROM v GROUP BY 1")
def _(t):
    worst = M.register_metric("max_error", lambda y, p: F.max(F.abs(y - p)), -1, "regression_error")
    return r(worst(_preds(t), "y_num", "p_num", ["part"]), 4)


# --- ensembles and bags ------------------------------------------------------------------------------------------------------

_MEMBERS = """SELECT o_orderkey AS row_id, m AS member, CASE m WHEN 0 THEN 5e-1 WHEN 1 THEN 3e-1 ELSE 2e-1 END AS weight,
 o_totalprice * (1 + m * 1e-1) AS num, CASE (o_custkey + m * o_orderkey) % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS lab FROM orders"""


def _members(t, pred, weight=None):
    orders = t.raw("orders").withColumn("m", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    orders.createOrReplaceTempView("ledgerlark_members")
    rows = t.spark.sql(_MEMBERS.replace("FROM orders", "FROM ledgerlark_members"))
    return rows.select("row_id", "member", (F.lit(weight) if weight else F.col("weight")).alias("weight"), F.col(pred).alias("pred"))


_MEM = _MEMBERS + ", range(3) AS g(m)"


@query("ml_ensemble_average", f"WITH m AS ({_MEM}) SELECT row_id, round(sum(weight * num) / sum(weight), 4) AS pred FROM m GROUP BY 1")
def _(t):
    return r(E.ensemble_average(_members(t, "num"), 3), 4)


@query("ml_ensemble_vote", f"""WITH m AS ({_MEM}), v AS (SELECT row_id, lab, count(*) AS w, min(member) AS f FROM m GROUP BY 1, 2)
 SELECT row_id, arg_min(lab, (-w, f)) AS pred FROM v GROUP BY 1""")
def _(t):
    return E.ensemble_average(_members(t, "lab", 1.0), 3)


@query("ml_bag_vote", f"WITH m AS ({_MEM}), v AS (SELECT row_id, lab, count(*) AS n FROM m GROUP BY 1, 2) SELECT row_id, arg_min(lab, (-n, lab)) AS pred FROM v GROUP BY 1")
def _(t):
    return E.bag_vote(_members(t, "lab"))


@query("ml_bag_mean", f"WITH m AS ({_MEM}) SELECT row_id, round(avg(num), 4) AS pred FROM m GROUP BY 1")
def _(t):
    return r(E.bag_mean(_members(t, "num")), 4)


@query("ml_bag_spread", f"WITH m AS ({_MEM}) SELECT round(avg(s), 4) AS spread FROM (SELECT row_id, stddev_pop(num) AS s FROM m GROUP BY 1)")
def _(t):
    return r(E.bag_spread(_members(t, "num")), 4)


@query("ml_class_multipliers")
def _(t):
    """Class probabilities of the order status from its price; the search result is one row per class."""
    price = F.col("o_totalprice") / 5e5
    share = {"F": F.lit(0.5) - price / 4, "O": F.lit(0.3) + price / 4, "P": F.lit(0.2) + (F.col("o_custkey") % 10) / 40.0}
    pairs = [x for c, e in share.items() for x in (F.lit(c), e.cast("double"))]
    proba = t.raw("orders").select(F.col("o_orderstatus").alias("y"), F.create_map(*pairs).alias("p"))
    weight, score = E.class_multipliers(proba, ["F", "O", "P"])
    rows = t.raw("orders").groupBy(F.col("o_orderstatus").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    mult = F.create_map(*[x for c, w in weight.items() for x in (F.lit(c), F.lit(w))])
    return rows.select("label", "n", mult.getItem(F.col("label")).alias("multiplier"), F.lit(score).alias("balanced_accuracy"))


# --- rules over scored attempts -------------------------------------------------------------------------------------------------

_BASE = """SELECT a.attempt_id, a.competition_id, a.cv_score, a.cv_fold_var, a.fold_scores, a.action_type, c.metric_sign, c.metric, a.gain_vs_best AS gain, b.best, b.bf,
 CASE WHEN c.metric IN ('rmse', 'mae') THEN 'regression_error' WHEN c.metric = 'accuracy' THEN 'classification' ELSE 'binary_proba' END AS metric_class
 FROM attempts a JOIN competitions c USING (competition_id) JOIN (SELECT competition_id, arg_max(p.cv_score, (metric_sign * p.cv_score, -p.pipeline_id)) AS best,
 arg_max({'f': coalesce(p.fold_scores, a.fold_scores)}, (metric_sign * p.cv_score, -p.pipeline_id)).f AS bf FROM pipelines p JOIN competitions USING (competition_id) JOIN attempts a USING (attempt_id)
 WHERE p.cv_score IS NOT NULL AND p.invalid_reason IS NULL AND NOT starts_with(coalesce(p.materialized_origin, ''), 'unverifiable:') GROUP BY 1) b ON b.competition_id = a.competition_id WHERE a.cv_score IS NOT NULL"""


def _base(t):
    from ..operators import summaries

    best = summaries.best_row(t.pipelines, t.attempts, t.competitions).select("competition_id", F.col("cv_score").alias("best"), F.col("fold_scores").alias("bf"))
    metric = F.col("metric")
    cls = F.when(metric.isin("rmse", "mae"), "regression_error").when(metric == "accuracy", "classification").otherwise("binary_proba")
    comp = t.competitions.select("competition_id", "metric_sign", "metric", cls.alias("metric_class"))
    return t.attempts.filter("cv_score IS NOT NULL").withColumnRenamed("gain_vs_best", "gain").join(comp, "competition_id").join(best, "competition_id")


@query("ml_significant", f"""WITH b AS ({_BASE}), d AS (SELECT *, CASE WHEN len(fold_scores) = len(bf) AND len(bf) >= 2 THEN list_transform(list_zip(fold_scores, bf), lambda z: metric_sign * (z[1] - z[2])) END AS dl FROM b)
 SELECT attempt_id, CASE WHEN dl IS NOT NULL THEN CASE WHEN list_stddev_samp(dl) = 0 THEN list_avg(dl) > 0 ELSE list_avg(dl) / (list_stddev_samp(dl) / sqrt(len(dl))) > 2 END
 ELSE coalesce(gain > 2 * sqrt(cv_fold_var), false) END AS significant FROM d""")
def _(t):
    c = F.col
    return _base(t).select("attempt_id", rules.is_significant(c("fold_scores"), c("bf"), c("gain"), c("cv_fold_var"), c("metric_sign")).alias("significant"))


@query("ml_label_gain", f"""WITH b AS ({_BASE}), x AS (SELECT *, sqrt(cv_fold_var) AS sd, metric_sign * (cv_score - best) AS delta, CASE WHEN metric_class = 'regression_error' THEN 8e0 END AS bc FROM b)
 SELECT attempt_id, CASE WHEN delta > 2 * sd THEN 'jump' WHEN delta < -2 * sd THEN 'regression' ELSE 'neutral' END AS label,
 round(CASE WHEN bc > 0 THEN greatest(delta, metric_sign * (bc * 10 - best)) ELSE delta END, 6) + 0e0 AS gain,
 round(CASE WHEN bc > 0 THEN greatest(delta, metric_sign * (bc * 10 - best)) / bc ELSE delta END, 6) + 0e0 AS relative, abs(cv_score - best) <= greatest(1e-6, 1e-6 * abs(best)) AS noop_tie FROM x""")
def _(t):
    c = F.col
    base_cv = F.when(c("metric_class") == "regression_error", 8.0)
    g = rules.label_gain(c("cv_score"), F.sqrt("cv_fold_var"), c("metric_sign"), c("metric_class"), c("best"), base_cv)
    return r(_base(t).select("attempt_id", g.alias("g")).select("attempt_id", "g.*"))


@query("ml_check_leakage", f"""WITH b AS ({_BASE}) SELECT attempt_id, CASE WHEN CASE WHEN metric_sign > 0 THEN cv_score / 490 >= 0.9999 ELSE cv_score / 490 <= 1e-9 END THEN 'perfect'
 WHEN metric_class = 'regression_error' AND metric_sign < 0 AND cv_score > 0 AND 8e0 / (cv_score / 490) > 100 THEN 'scale' END AS verdict FROM b""")
def _(t):
    c = F.col
    return _base(t).select("attempt_id", rules.leak_verdict(c("cv_score") / 490, c("metric_sign"), c("metric_class"), F.lit(8.0)).alias("verdict"))


@query("ml_noop_exit", f"WITH b AS ({_BASE}) SELECT attempt_id, coalesce(fold_scores[1] = bf[1], false) AS known FROM b")
def _(t):
    known = F.get("fold_scores", F.lit(0)) == F.get("bf", F.lit(0))
    return _base(t).select("attempt_id", F.coalesce(known, F.lit(False)).alias("known"))


@query("ml_futility", f"""WITH b AS ({_BASE}) SELECT attempt_id, CASE WHEN NOT coalesce(metric_sign * (fold_scores[1] - bf[1]) < -75e-2 * list_stddev_pop(bf) AND metric_class <> 'regression_error', false) THEN 'run'
 WHEN ('0x' || substr(md5(CAST(attempt_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296e0 < 1e-1 THEN 'audit' ELSE 'stop' END AS decision FROM b""")
def _(t):
    c = F.col
    return _base(t).select("attempt_id", rules.futility(F.get("fold_scores", F.lit(0)), c("bf"), c("metric_sign"), c("metric_class"), c("attempt_id")).alias("decision"))
