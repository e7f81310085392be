"""Plans of the model operators: what they shuffle does not gather by a few values, and shared work is done once."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ledgerlark.operators import evaluation as E, training
from ledgerlark.operators.extra_trees import ExtraTrees

REG = E.Context(target="y", metric="rmse")


def rows(spark, n=600):
    return spark.range(n).select(F.col("id").cast("string").alias("row_id"), (F.col("id") % 7).cast("double").alias("a"), F.concat(F.lit("s"), F.col("id") % 3).alias("s"), (F.col("id") % 7 * 2 + F.col("id") % 5).cast("double").alias("y"))


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_codes_join_without_a_shuffle_by_value(spark):
    df = rows(spark)
    coded = training.apply_codes(df, training.string_codes(df, ["s"]), ["s"])
    assert "SortMergeJoin" not in planned(coded) and {r["s"] for r in coded.collect()} == {0, 1, 2}


def test_ranks_take_one_join_and_no_gathering_by_class(spark):
    ranked = training.digest_rank(rows(spark), ["row_id"], 1, ["s"])
    assert planned(ranked).count("Join") == 1
    got = ranked.groupBy("s").agg(F.sort_array(F.collect_list("_rank")).alias("r"), F.max("_size").alias("n")).collect()
    assert all(r["r"] == list(range(200)) and r["n"] == 200 for r in got)


def test_stack_joins_nothing(spark):
    df = rows(spark)
    spec = {"method": "stack", "members": [{"model": "ridge"}, {"model": "random_forest", "params": {"n_estimators": 2, "max_depth": 2}}]}
    out = E.fit_predict(E.Pipeline(ensemble_spec=spec), {}, df.filter("a > 0"), df.filter("a = 0"), REG, truth=True)
    assert "SortMergeJoin" not in planned(out) and out.filter("y IS NOT NULL AND pred IS NOT NULL").count() == df.filter("a = 0").count()


def test_search_prepares_the_rows_of_a_rung_once(spark, monkeypatch):
    made = []
    start = E.Prepared.__init__
    monkeypatch.setattr(E.Prepared, "__init__", lambda self, *a: (made.append(1), start(self, *a))[1])
    best = E.param_search("elastic_net", {"alpha": 1.0, "l1_ratio": 0.5}, rows(spark), REG, n_trials=4)
    assert len(made) == len(best["rungs"]) + REG.n_splits


def test_trees_predict_without_interpreted_steps(spark):
    x = np.random.default_rng(1).normal(size=(200, 2))
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame([(float(a), float(b), float(a > 0)) for a, b in x], "a double, b double, label double"))
    out = ExtraTrees(numTrees=3, classification=True).fit(df).transform(df)
    assert "lambdafunction" not in planned(out) and out.count() == 200


def test_models_of_one_split_share_their_rows(spark, monkeypatch):
    """Rows are coded and prepared once for all models, and every model predicts what it predicts alone."""
    df = rows(spark)
    train, valid = df.filter("a > 0"), df.filter("a = 0")
    small = {"n_estimators": 2, "max_depth": 2}
    pipes = [E.Pipeline(model_spec={"model": m, "params": p}) for m, p in (("ridge", {}), ("random_forest", small), ("extra_trees", small))]
    alone = [E.fit_predict(p, {}, train, valid, REG, truth=True).collect() for p in pipes]
    made, coded = [], []
    start, codes = E.Prepared.__init__, training.string_codes
    monkeypatch.setattr(E.Prepared, "__init__", lambda self, *a: (made.append(1), start(self, *a))[1])
    monkeypatch.setattr(training, "string_codes", lambda *a: (coded.append(1), codes(*a))[1])
    for want, got in zip(alone, E.fit_predict_all(pipes, train, valid, REG)):
        assert {(r["row_id"], r["y"], round(r["pred"], 6)) for r in got.collect()} == {(r["row_id"], r["y"], round(r["pred"], 6)) for r in want}
    assert len(made) == len(coded) == 1
    with pytest.raises(ValueError, match="hooks"):
        next(E.fit_predict_all([E.Pipeline(ensemble_spec={"method": "stack", "members": []})], train, valid, REG))
