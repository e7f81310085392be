"""Ridge of all folds from one scan against fits of every fold."""

import numpy as np
import pandas as pd
import pytest

from ledgerlark.operators import evaluation as E, ridge

CTX = E.Context(target="y", metric="rmse", n_splits=4)


def _frame(spark, n=400, far=1e6, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    pdf = pd.DataFrame({"row_id": np.arange(n), "a": x[:, 0], "b": x[:, 1] * 1e-3 + far, "flat": 7.0, "kind": rng.choice(["p", "q", "r"], n), "day": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="D"),
                        "is_original": np.arange(n) % 9 == 0, "y": 3 * x[:, 0] + 2 * x[:, 1] + rng.normal(size=n) + 50})
    pdf.loc[::7, "a"] = np.nan
    return spark.createDataFrame(pdf)


def _scores(spark, pipe, df, closed, monkeypatch):
    if not closed:
        monkeypatch.setattr(E, "ridge_folds", lambda *a: None)
    got = E.cross_validate(pipe, df, CTX, {}).fold_scores
    monkeypatch.undo()
    return got


@pytest.mark.parametrize("alpha", [1e-6, 0.5, 50.0])
def test_equals_fits_of_every_fold(spark, monkeypatch, alpha):
    df = _frame(spark, far=0.0)  # the fits of every fold lose digits on values far from zero
    pipe = E.Pipeline(model_spec={"model": "ridge", "params": {"alpha": alpha}})
    assert E.ridge_folds(pipe, E.prepare_folds(df, CTX), CTX, {}) is not None
    np.testing.assert_allclose(_scores(spark, pipe, df, True, monkeypatch), _scores(spark, pipe, df, False, monkeypatch), rtol=1e-6)


def test_weights_equal_numpy(spark):
    df = _frame(spark).drop("kind", "day", "is_original").selectExpr("*", "CAST(row_id % 4 AS INT) AS fold")
    pdf = df.toPandas()
    names = ["a", "b", "flat"]
    for fold, line in ridge.fold_lines(df, names, "y", 0.7).items():
        part = pdf[pdf.fold != fold]
        x = part[names].fillna(part[names].mean()).to_numpy()
        mean, std, y = x.mean(axis=0), x.std(axis=0), part.y.to_numpy()
        use = np.array([0, 1])
        z = (x[:, use] - mean[use]) / std[use]
        w = np.linalg.solve(z.T @ z / len(z) + np.eye(2) * 0.7 / y.std(), z.T @ (y - y.mean()) / len(z)) / std[use]
        np.testing.assert_allclose(line.weights[use], w, rtol=1e-6)
        assert line.weights[2] == 0.0 and line.intercept == pytest.approx(y.mean() - w @ mean[use], rel=1e-6)


def test_where_the_closed_form_does_not_apply(spark):
    df = _frame(spark).drop("day")
    pipe = E.Pipeline(model_spec={"model": "ridge", "params": {"alpha": 1.0}})
    folds = E.prepare_folds(df, CTX)
    lonely = folds.selectExpr("row_id", "a", "y", "CASE WHEN row_id = 1 THEN 'once' ELSE kind END AS kind", "fold")
    assert E.ridge_folds(pipe, lonely, CTX, {}) is None
    net = E.Pipeline(model_spec={"model": "elastic_net", "params": {"alpha": 1.0}})
    assert E.ridge_folds(net, folds, CTX, {}) is None
    assert E.ridge_folds(E.Pipeline(model_spec={"model": "ridge", "params": {"alpha": 0.0}}), folds, CTX, {}) is None
    without = folds.selectExpr("row_id", "y", "IF(fold = 0, a, NULL) AS a", "fold")
    assert E.ridge_folds(pipe, without, CTX, {}) is None
    assert E.ridge_folds(pipe, folds.selectExpr("row_id", "a", "IF(row_id = 3, NULL, y) AS y", "fold"), CTX, {}) is None
    assert E.ridge_folds(pipe, folds.limit(0), CTX, {}) is None


def test_constant_target(spark):
    df = _frame(spark).selectExpr("row_id", "a", "4.0D AS y", "CAST(row_id % 4 AS INT) AS fold")
    assert all(line.intercept == pytest.approx(4.0) and not line.weights.any() for line in ridge.fold_lines(df, ["a"], "y", 1.0).values())
