"""Ordered operators against plain pandas, with one key that holds most rows and many equal timestamps."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import prefix


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    n = 900
    pdf = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 40, n)),
        "id": np.arange(n),
        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 200, n), unit="min"),
        "v": np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n).round(2)),
    })
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    return pdf.sort_values(["k", "ts", "id"]), df


def _sliced(df):
    return prefix.with_slice(df, ["k"], prefix.time_position("ts"))


def test_hot_key_is_cut_and_small_keys_are_not(frame, hot):
    pdf, df = frame
    slices = _sliced(df).groupBy("k").agg(F.count_distinct("_slice").alias("n")).toPandas().set_index("k")["n"]
    big = pdf.groupby("k").size() > 20
    assert slices[0] == 7
    assert (slices[~big] == 1).all()


@pytest.mark.parametrize("before", [False, True])
def test_running(frame, hot, before):
    pdf, df = frame
    aggs = {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}
    got = prefix.running(_sliced(df), ["k"], [F.col("ts"), F.col("id")], aggs, before=before).toPandas().set_index("id").sort_index()
    g = pdf.assign(one=1).groupby("k")
    want = pd.DataFrame({
        "id": pdf["id"], "n": g["one"].cumsum(), "s": g["v"].transform(lambda x: x.fillna(0).cumsum().where(x.notna().cumsum() > 0)),
        "m": g["v"].transform(lambda x: x.cummax().ffill()), "l": g["v"].ffill(), "k": pdf["k"],
    })
    if before:
        shifted = want.groupby("k")[["n", "s", "m", "l"]].shift(1)
        want[["n", "s", "m", "l"]] = shifted
        want["n"] = want["n"].fillna(0)
    want = want.set_index("id").sort_index()
    for c in ("n", "s", "m", "l"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1e-9)


def test_previous(frame, hot):
    pdf, df = frame
    got = prefix.previous(_sliced(df), ["k"], [F.col("ts"), F.col("id")], {"pv": F.col("v")}).toPandas().set_index("id").sort_index()
    want = pdf.assign(pv=pdf.groupby("k")["v"].shift(1)).set_index("id").sort_index()
    np.testing.assert_allclose(got["pv"].astype(float), want["pv"])


def test_as_of_is_strict(frame, hot):
    pdf, df = frame
    left, right = df.filter("id % 3 <> 0"), df.filter("id % 3 = 0").withColumnRenamed("id", "rid").withColumn("id", F.col("rid"))
    got = prefix.as_of(left, right, ["k"], "ts", ["rid"], tie="id").toPandas().set_index("id")["prev_rid"]
    for _, row in pdf[pdf.id % 3 != 0].iterrows():
        earlier = pdf[(pdf.k == row.k) & (pdf.ts < row.ts) & (pdf.id % 3 == 0)]
        want = earlier.sort_values(["ts", "id"])["id"].iloc[-1] if len(earlier) else None
        assert (got[row.id] == want) if want is not None else pd.isna(got[row.id])


def test_later_weighted_sum(frame, hot):
    pdf, df = frame
    rows = df.fillna({"v": 0.0})
    got = prefix.later_weighted_sum(_sliced(rows), ["k"], [F.col("ts"), F.col("id")], {"w": F.col("v")}, 0.9).toPandas().set_index("k")["w"]
    for k, g in pdf.fillna({"v": 0.0}).groupby("k"):
        acc = 0.0
        for v in g["v"]:
            acc = acc * 0.9 + v
        assert got[k] == pytest.approx(acc)


def test_percentiles_with_ties(frame, hot):
    pdf, df = frame
    got = prefix.ordered_percentiles(df, ["k"], F.round("v", 1), {"p90": 0.9, "p50": 0.5}).toPandas().set_index("k")
    want = pdf.assign(v=pdf.v.map(lambda x: float(np.floor(abs(x) * 10 + 0.5 + 1e-9) / 10 * np.sign(x)) if pd.notna(x) else x)).groupby("k")["v"].quantile([0.5, 0.9]).unstack()
    np.testing.assert_allclose(got.sort_index()["p90"], want[0.9].dropna(), atol=1e-9)
    np.testing.assert_allclose(got.sort_index()["p50"], want[0.5].dropna(), atol=1e-9)
