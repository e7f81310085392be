"""Nothing is cut off or left whole by surprise: slices of skewed keys, pages, windows, odd rows of the declared schema."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark import session
from ledgerlark.functions import text
from ledgerlark.operators import listings, prefix, summaries, training, views
from ledgerlark.sources import files


def _sizes(df, position):
    out = prefix.with_slice(df, ["k"], position)
    return out, [r["count"] for r in out.groupBy("k", "_slice").count().filter("_slice > 0").collect()]


@pytest.mark.parametrize("key", [7, None])
def test_slices_stay_even_with_outliers(spark, hot, key):
    rows = [(key, float(i)) for i in range(2000)] + [(key, -1e300), (key, float("inf")), (key, float("-inf")), (key, None), (1, 5.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    out, sizes = _sizes(df, F.col("v"))
    assert len(sizes) == 7 and max(sizes) < 2 * 2004 / 7
    got = prefix.running(out, ["k"], [F.col("v")], {"n": ("count", F.lit(1))}).filter(F.col("k").eqNullSafe(F.lit(key)))
    assert sorted(r["n"] for r in got.collect()) == list(range(1, 2005))
    in_order = [r["v"] for r in got.orderBy("n").collect()]
    assert in_order[0] is None and in_order[1:] == sorted(in_order[1:])


def test_equal_positions_share_a_slice(spark, hot):
    df = spark.createDataFrame([(1, float(i % 5)) for i in range(500)], "k int, v double")
    out, _ = _sizes(df, F.col("v"))
    assert out.groupBy("v").agg(F.count_distinct("_slice").alias("n")).filter("n > 1").count() == 0


def test_codes_with_an_odd_value(spark, hot):
    values = [f"customer#{i:06d}" for i in range(400)] + ["\u00ff odd", "", "customer#"]
    df = spark.createDataFrame([(v,) for v in values] * 2 + [(None,)], "c string")
    got = {r["value"]: r["code"] for r in training.string_codes(df, ["c"]).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values, key=lambda s: s.encode()))}


def test_pages_are_clamped_with_notice_only(spark):
    df = spark.range(700).withColumnRenamed("id", "n")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert listings.page(df, [F.col("n")], 600).count() == 600
        assert not seen
        assert listings.page(df, [F.col("n")], 600, listings.MAX_PAGE).count() == 500
        assert "600" in str(seen[0].message)


def test_full_values_by_default(spark):
    row = spark.range(1).select(F.lit("".join(f"x.alias('c{i}') " for i in range(80))).alias("s"))
    assert len(row.select(text.code_facts(F.col("s"))["columns"]).first()[0]) == 80
    assert len(row.select(text.code_facts(F.col("s"), 60)["columns"]).first()[0]) == 60
    assert row.select(F.length(text.squeeze(F.col("s")))).first()[0] > 1000


def test_first_fold_cache_has_all(spark):
    rows = [(1, i, i, [float(i), 1.0]) for i in range(300)] + [(1, 999, 999, [5.0, 2.0])]
    df = spark.createDataFrame(rows, "competition_id int, attempt_id int, run_ts int, fold_scores array<double>")
    got = {r["fold1"]: r["attempt_id"] for r in summaries.fold1_cache(df, 2).collect()}
    assert len(got) == 300 and got[5.0] == 999


def test_best_row_with_text_ids(spark):
    pipes = spark.createDataFrame([("c", f"a{i}", f"p{i}", s, None, None, True) for i, s in enumerate((0.5, 0.9, 0.9, None))],
                                  "competition_id string, attempt_id string, pipeline_id string, cv_score double, fold_scores array<double>, invalid_reason string, confirmed boolean").withColumn("materialized_origin", F.lit(None).cast("string"))
    atts = spark.createDataFrame([(f"a{i}", "m", "h", [1.0]) for i in range(4)], "attempt_id string, model_type string, hypothesis string, fold_scores array<double>")
    comps = spark.createDataFrame([("c", 1)], "competition_id string, metric_sign int")
    row = summaries.best_row(pipes, atts, comps).first()
    assert (row["pipeline_id"], row["cv_score"]) == ("p1", 0.9)


def test_duplicates_skip_odd_vectors_and_have_no_cap(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 8))
    v[399] = v[0] + 1e-3
    rows = [(i, 1, i, False, [float(x) for x in w]) for i, w in enumerate(v)] + [(1000, 1, 1000, False, None), (1001, 1, 1001, False, [1.0, 2.0]), (1002, 2, 0, False, []), (1003, 1, 3, False, [None] * 8)]
    lessons = spark.createDataFrame(rows, "reflection_id int, competition_id int, created_at int, archived boolean, embedding array<double>")
    want = {(0, 399)}
    for got in (views.lesson_duplicates(lessons, 0.99), views.lesson_duplicates_all(lessons, 0.99, block=50), views.lesson_duplicates(lessons, 0.99, newest=500)):
        assert {(r["reflection_id_a"], r["reflection_id_b"]) for r in got.collect()} == want
    assert views.lesson_duplicates(lessons, 0.99, newest=100).count() == 0


def test_leaderboard_arrays(spark):
    rows = [("a", 1, [0.1, 0.2]), ("a", 2, [0.3, None, 0.4]), ("b", 1, [])]
    got = files.leaderboard_rows(spark.createDataFrame(rows, "competition_id string, fetched_at int, scores array<double>"))
    assert sorted((r["competition_id"], r["score"]) for r in got.collect()) == [("a", 0.3), ("a", 0.4)]


def test_local_folder_is_refused_off_local_mode():
    class Context:
        master = "spark://somewhere:7077"

    class Conf:
        @staticmethod
        def get(key, default=None):
            return default

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(ValueError, match="share"):
        session.work_dir(Session)
