"""Promotion, fleet and table decisions on small frames."""

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import rules
from ledgerlark.operators import progress
from ledgerlark.plans import fleet, promotion as P
from ledgerlark.sources import files, tables


def test_confirm(spark):
    rows = [
        ("good", 7, 1, 0.9, 0.8, None), ("good", 101, 1, 0.9, 0.8, None), ("one_seed", 7, 1, 0.9, 0.8, None), ("one_seed", 101, 1, 0.7, 0.8, None),
        ("crash", 7, 1, None, 0.8, "boom"), ("crash", 101, 1, 0.9, 0.8, None), ("worse_holdout", 7, -1, 0.7, 0.8, None), ("worse_holdout", 101, -1, 0.7, 0.8, None),
        ("no_base_holdout", 7, 1, 0.9, 0.8, None), ("no_base_holdout", 101, 1, 0.9, 0.8, None), ("missing_seed", 7, 1, 0.9, 0.8, None),
    ]
    ev = spark.createDataFrame(rows, "candidate_id string, seed int, metric_sign int, candidate_cv double, baseline_cv double, error string")
    ho = spark.createDataFrame([("good", 0.9, 0.8), ("one_seed", 0.9, 0.8), ("crash", 0.9, 0.8), ("worse_holdout", 0.9, 0.8), ("no_base_holdout", 0.9, None), ("missing_seed", 0.9, 0.8)], "candidate_id string, candidate_holdout double, baseline_holdout double")
    got = {r.candidate_id: (r.confirmed, r.memo) for r in P.confirm(ev, ho).collect()}
    assert got == {"good": (True, False), "one_seed": (False, True), "crash": (False, False), "worse_holdout": (False, True), "no_base_holdout": (True, False), "missing_seed": (False, True)}


@pytest.mark.parametrize("cv,folds,sign,over", [(0.99, [0.99, 0.99], 1, True), (0.985, [0.97, 1.0, 0.985], 1, False), (0.97, None, 1, False), (0.05, [0.05, 0.05], -1, True), (0.99, None, 1, True)])
def test_ceiling(spark, cv, folds, sign, over):
    att = spark.createDataFrame([(1, 1, cv, folds)], "attempt_id int, competition_id int, cv_score double, fold_scores array<double>")
    board = spark.createDataFrame([(1, 0.98), (1, 0.1)], "competition_id int, score double")
    comp = spark.createDataFrame([(1, sign)], "competition_id int, metric_sign int")
    assert P.ceiling_violations(att, board, comp).count() == int(over)


def test_fingerprint_guard(spark):
    comp = spark.createDataFrame([(1, None, None), (2, "x", "train_fp: old"), (3, "x", None), (4, "x", "other")], "competition_id int, train_fingerprint string, auto_submit_paused_reason string")
    now = spark.createDataFrame([(1, "n"), (2, "x"), (3, "n"), (4, "x")], "competition_id int, fingerprint string")
    got = {r.competition_id: (r.outcome, r.auto_submit_paused_reason) for r in P.fingerprint_guard(comp, now, "train_fingerprint", "train_fp").collect()}
    assert got == {1: ("stamp", None), 2: ("pass", None), 3: ("mismatch", "train_fp: stored x != current n"), 4: ("pass", "other")}


def test_assign_actions(spark):
    bandit = spark.createDataFrame([("live", "ensemble", 40.0, 1.0)] + [("dead", a, 1.0, 30.0) for a in ("feature_engineering", "preprocessing", "model_swap", "hyperparam_search", "ensemble")]
                                   + [("few", a, 1.0, 30.0) for a in ("feature_engineering", "preprocessing", "model_swap", "hyperparam_search")], "scope_key string, action_type string, alpha double, beta double").withColumn("scope", F.lit("local"))
    bandit = bandit.unionByName(bandit.withColumns({"scope": F.lit("global"), "alpha": F.lit(99.0)}))
    comps = spark.createDataFrame([("live",), ("dead",), ("few",), ("new",)], "competition_id string")
    att = spark.createDataFrame([(k, i) for k in ("live", "dead", "few") for i in range(50)], "competition_id string, i int")
    def picks(seed):
        out = {}
        for r in fleet.assign_actions(bandit, att, comps, 3, seed).collect():
            out.setdefault(r.scope_key, []).append((r.slot, r.action_type))
        return {k: [a for _, a in sorted(v)] for k, v in out.items()}

    got = picks(1)
    assert got == picks(1) and all(len(v) == 3 for v in got.values())
    assert got["live"][0] == "ensemble" and len(set(got["live"])) == 3
    assert got["few"] == ["ensemble"] * 3 and len(set(got["dead"])) == 3
    opened = fleet.assign_actions(bandit, att.limit(0), comps, 3, 1).filter("scope_key = 'few'").select("action_type").distinct().count()
    assert opened == 3


def test_action_prior_is_a_probability(spark):
    bandit = spark.createDataFrame([("k", "ensemble", 90.0, 10.0)], "scope_key string, action_type string, alpha double, beta double").withColumn("scope", F.lit("local"))
    comps = spark.createDataFrame([("k",)], "competition_id string")
    got = {r.action_type: r.prior for r in fleet.action_prior(bandit, comps, 3).collect()}
    assert len(got) == 5 and all(0 <= v <= 1 for v in got.values()) and got["ensemble"] > 0.7


def test_upsert_and_update(spark):
    base = spark.createDataFrame([(1, "a", None), (2, "b", "keep")], "k int, v string, f string")
    rows = spark.createDataFrame([(2, "old", "x", 1), (2, "new", "y", 2), (3, "c", "z", 1)], "k int, v string, f string, t int")
    got = {r.k: (r.v, r.f) for r in tables.upsert(base, rows, ["k"], ["t"], keep=["f"]).collect()}
    assert got == {1: ("a", None), 2: ("new", "keep"), 3: ("c", "z")}
    assert {r.k: r.v for r in tables.insert_if_absent(base, rows, ["k"], ["t"]).collect()} == {1: "a", 2: "b", 3: "c"}
    new, changed = tables.update_where(base, F.col("f").isNull(), {"f": F.lit("set")})
    assert {r.k: r.f for r in new.collect()} == {1: "set", 2: "keep"} and [r.k for r in changed.collect()] == [1]


def test_listing_and_header(spark):
    lines = spark.createDataFrame([("Warning: new version",), (" m1 ,SubmissionStatus.COMPLETE,0.5",), ("m2,complete,",), ("m3,Status.INVALID,1",), ("m4,running,2",)], "value string")
    got = {r.description: (r.state, r.score) for r in files.parse_submission_listing(lines).select("description", "state", "score").collect()}
    assert got == {"m1": ("complete", 0.5), "m2": ("complete", None), "m3": ("invalid", None), "m4": ("pending", None)}
    text = spark.createDataFrame([("# a\n# ----\nbody\n",), ("plain",)], "t string")
    assert [r.x for r in text.select(files.strip_header(F.col("t"), "# ----").alias("x")).collect()] == ["body", "plain"]


def test_refresh_and_states(spark):
    ts = lambda m: F.lit("2024-01-01 12:00:00").cast("timestamp_ntz") - F.expr(f"INTERVAL '{m}' MINUTE")
    due = lambda s, c: spark.range(1).select(rules.refresh_due(ts(s), ts(c), ts(0)).alias("x")).first().x
    assert [due(5, 1), due(5, 2), due(30, 9), due(30, 10), due(300, 29), due(300, 30), due(400, 119), due(400, 120)] == [False, True] * 4


def test_projections(spark):
    lines = spark.createDataFrame([("a", 0, "stage=preselect_done cpu=100"), ("a", 1, "stage=fold_done fold=1/5 cpu=200"), ("a", 2, "stage=fold_done fold=2/5 cpu=260"), ("b", 0, "stage=preselect_done cpu=10"), ("b", 1, "stage=cv_done cpu=20"),
                                   ("c", 0, "stage=preselect_start cand=0/4 cpu=10"), ("c", 1, "stage=preselect_fit cand=1/4 cpu=30"), ("d", 0, "stage=preselect_start cand=0/4 cpu=10")], "run string, n int, line string")
    now = spark.createDataFrame([("a", 300.0), ("b", 30.0), ("c", 90.0), ("d", 50.0)], "run string, cpu_now double")
    cv = {r.run: (r.fold, r.projected) for r in progress.project_cpu(lines, now, "run", "n", "line", 5).collect()}
    assert cv == {"a": (3, 260 + 3 * 80.0)}
    pre = {r.run: (r.candidate, r.projected) for r in progress.project_preselect(lines, now, "run", "n", "line").collect()}
    assert pre == {"c": (2, 30 + 60 + 2 * 20.0), "d": (1, 50.0)}
