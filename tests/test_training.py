"""Training preparation on small frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerlark.operators import metrics, training as T


def test_merge_marks_and_drops_twins(spark):
    base = spark.createDataFrame([(1, 0, "a"), (2, 1, None)], "x int, y int, c string")
    extra = spark.createDataFrame([(" 1.0", 0, "a ", 5), ("3", 1, "b", 6), ("2", 1, None, 7), ("9", None, "z", 8)], "x string, y int, c string, unrelated int")
    kept = T.remove_twins(T.project_common(extra, base), base, ["x", "y", "c"]).select("x").toPandas()["x"].tolist()
    assert sorted(kept) == ["3", "9"]
    with pytest.raises(PySparkException, match="twins"):
        T.load_train(base, [extra.limit(1)], "y").collect()
    more = spark.createDataFrame([(i, i % 2, "q") for i in range(10, 20)], "x int, y int, c string")
    out = T.load_train(base, [more], "y").toPandas()
    assert out["is_original"].tolist().count(True) == 10 and len(out) == 12
    with pytest.raises(ValueError, match="target"):
        T.load_train(base, [more.drop("y")], "y")


def _frame(spark, n=500):
    rng = np.random.default_rng(0)
    return spark.createDataFrame(pd.DataFrame({"row_id": np.arange(n), "y": rng.choice(["a", "b", "c"], n, p=[0.7, 0.25, 0.05]), "is_original": np.arange(n) % 10 == 0}))


def test_folds_are_stratified_disjoint_and_repeatable(spark):
    df = _frame(spark)
    a = T.assign_folds(df, "y", 5, 42, True, ["row_id"]).toPandas().set_index("row_id")["fold"].sort_index()
    b = T.assign_folds(df.repartition(7), "y", 5, 42, True, ["row_id"]).toPandas().set_index("row_id")["fold"].sort_index()
    assert (a == b).all()
    pdf = df.toPandas().set_index("row_id")
    assert (a[pdf["is_original"]] == -1).all()
    sizes = pdf[~pdf["is_original"]].assign(fold=a).groupby(["y", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()
    assert (a != T.assign_folds(df, "y", 5, 7, True, ["row_id"]).toPandas().set_index("row_id")["fold"].sort_index()).any()


def test_audit_split_keeps_originals_in_train(spark):
    out = T.audit_split(_frame(spark), "y", True, ["row_id"]).toPandas()
    assert not out[out.is_original].is_holdout.any()
    share = out[~out.is_original].groupby("y").is_holdout.mean()
    assert ((share - 0.1).abs() < 0.04).all()


def test_samples(spark):
    df = _frame(spark)
    s = T.stratified_sample(df, "y", 100, ["row_id"]).toPandas()
    assert abs(len(s) - 100) <= 2
    assert T.stratified_sample(df, "y", 5000, ["row_id"]).count() == 500
    assert T.row_cap(df, 60, ["row_id"]).count() == 60


def test_encode_strings(spark):
    train = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("éa", 4)], "s string, v int")
    other = spark.createDataFrame([("a", 1), ("zz", 2), (None, 3), ("b", 4), ("éa", 5)], "s string, v int")
    got = T.encode_strings(train, other).orderBy("v").toPandas()["s"].tolist()
    assert got == [0, -1, -1, 1, 2]


def test_fingerprint(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    pdf = pd.DataFrame(x, columns=["x0", "x1", "x2"]).assign(y=(x[:, 0] > 0).astype(int))
    f = T.fingerprint(spark.createDataFrame(pdf), "y", "binary", "auc", 1).first()
    assert (f.n_rows, f.n_cols, f.n_numeric, f.n_categorical, f.size_class) == (200, 3, 3, 0, "tiny")
    assert f.target_stat == pytest.approx(min(pdf.y.mean(), 1 - pdf.y.mean()), abs=1e-6)
    skewed = pd.DataFrame({"x0": rng.normal(size=200), "y": np.exp(rng.normal(size=200))})
    assert T.fingerprint(spark.createDataFrame(skewed), "y", "regression", "rmse", -1).first().target_stat > 0.5
    text = spark.createDataFrame([(1.0, None, 0), (2.0, None, 1), (3.0, None, 0)], "x0 double, notes string, y int")
    g = T.fingerprint(text, "y", "binary", "auc", 1).first()
    assert g.n_text_ish == 0 and g.cardinality_max == 1 and g.missing_ratio_overall == 0.5


def test_target_encoding_leaves_own_fold_out(spark):
    pdf = pd.DataFrame({"row_id": range(60), "c": [f"k{i % 4}" for i in range(60)], "y": [float(i * i % 17) for i in range(60)], "fold": [i % 3 for i in range(60)]})
    got = T.target_encode(spark.createDataFrame(pdf), "c", "y", 5.0).toPandas().set_index("row_id")["c_encoded"]
    for _, r in pdf.iterrows():
        rest = pdf[pdf.fold != r.fold]
        mine = rest[rest.c == r.c]
        assert got[r.row_id] == pytest.approx((mine.y.sum() + 5.0 * rest.y.mean()) / (len(mine) + 5.0))


METRICS = [
    ("auc", [0, 0, 1, 1, 1], [0.1, 0.3, 0.6, 0.7, 0.9], 1.0), ("auc", [0, 1, 0, 1], [0.5, 0.5, 0.2, 0.9], 0.875),
    ("accuracy", [0, 0, 1], [0, 1, 1], 2 / 3), ("f1", [0, 0, 1, 1], [0, 1, 1, 0], 0.5), ("balanced_accuracy", [0, 0, 0, 1], [0, 0, 1, 1], 5 / 6),
    ("rmse", [1.0, 2, 3, 4], [1.1, 1.9, 3.1, 3.8], 0.0175**0.5), ("mae", [1.0, 2, 3, 4], [1.1, 1.9, 3.1, 3.8], 0.125),
    ("qwk", [0, 1, 2, 3, 2], [0, 1, 2, 2, 3], 1 - 2 / (2 * (5 * (0 + 1 + 4 + 9 + 4) - 64) / 5)),
    ("logloss", [1, 0], [0.8, 0.2], -np.log(0.8)), ("rmsle", [1.0, 3.0], [-2.0, 3.0], (np.log(2) ** 2 / 2) ** 0.5),
]


@pytest.mark.parametrize("name,y,p,want", METRICS)
def test_metric_values(spark, name, y, p, want):
    df = spark.createDataFrame(list(zip(map(float, y), map(float, p))), "y double, p double")
    assert metrics.get_metric(name)(df, "y", "p").first()["score"] == pytest.approx(want)


def test_auc_one_hot_score(spark, hot):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 3000), np.where(rng.random(3000) < 0.4, 0.5, rng.random(3000).round(3))
    got = metrics.auc(spark.createDataFrame(pd.DataFrame({"y": y, "p": p})), "y", "p").first()["score"]
    rank = pd.Series(p).rank()
    want = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert got == pytest.approx(want)


def test_registry():
    assert metrics.get_metric("RMSE").sign == -1
    with pytest.raises(ValueError, match="Unknown metric"):
        metrics.get_metric("nope")
