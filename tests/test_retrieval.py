"""Retrieval against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlark.catalog import roles
from ledgerlark.operators import retrieval as R, views


def _lessons(spark, n=60, dim=8, competitions=2, seed=3):
    rng = np.random.default_rng(seed)
    vec = rng.normal(size=(n, dim)).astype("float32")
    vec[5] = vec[4] + 0.01
    pdf = pd.DataFrame({
        "reflection_id": [f"r{i:03d}" for i in range(n)], "competition_id": [f"c{i % competitions}" for i in range(n)], "embedding": list(vec),
        "generality": "L2_class", "lesson_type": ["no_op" if i % 7 == 0 else "avoid" for i in range(n)], "archived": [i % 11 == 0 for i in range(n)],
        "gain_vs_best": 0.0, "created_at": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="min"),
    })
    schema = "reflection_id string, competition_id string, embedding array<float>, generality string, lesson_type string, archived boolean, gain_vs_best double, created_at timestamp"
    return pdf, vec, spark.createDataFrame(pdf, schema)


def _greedy(vec, score, k, lam=0.5):
    unit = vec / (np.linalg.norm(vec, axis=1, keepdims=True) + 1e-9)
    rel = (score - score.min()) / (score.max() - score.min())
    chosen = [int(np.argmax(rel))]
    while len(chosen) < k:
        rest = [i for i in range(len(vec)) if i not in chosen]
        value = [lam * rel[i] - (1 - lam) * max(float(unit[i] @ unit[j]) for j in chosen) for i in rest]
        chosen.append(rest[int(np.argmax(value))])
    return chosen


def test_search_matches_greedy(spark):
    pdf, vec, df = _lessons(spark)
    q = np.arange(8, dtype=float)
    impact = spark.createDataFrame([(f"r{i:03d}", i / 100.0) for i in range(0, 60, 2)], "reflection_id string, avg_gain double")
    got = R.search(df, impact, list(q), "c0", k=4).orderBy("place").toPandas()["reflection_id"].tolist()
    sim = vec @ q / np.linalg.norm(vec, axis=1) / np.linalg.norm(q)
    live = [i for i in np.argsort(-sim) if not pdf.archived[i]][:16]
    gains = np.array([i / 100.0 for i in range(0, 60, 2)])
    z = np.array([((i / 100.0 if i % 2 == 0 else 0.0) - gains.mean()) / gains.std() for i in live])
    score = sim[live] * np.clip(1 + 0.15 * z, 0.5, 1.5) * np.where(pdf.lesson_type.iloc[live] == "no_op", 0.5, 1.0)
    assert got == [pdf.reflection_id[live[i]] for i in _greedy(vec[live], score, 4)]


def test_cosine_nulls_and_sizes(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [3.0, 4.0])], "id int, embedding array<float>")
    got = df.select("id", R.cosine_to([1.0, 0.0])("embedding").alias("s")).orderBy("id").toPandas()["s"]
    assert got[0] == 1.0 and got[1:4].isna().all() and got[4] == pytest.approx(0.6)


@pytest.mark.parametrize("block", [4, 512])
def test_all_duplicates_equals_capped_and_brute_force(spark, block):
    pdf, vec, df = _lessons(spark)
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    live = pdf[~pdf.archived]
    want = {(pdf.reflection_id[i], pdf.reflection_id[j]) for i in live.index for j in live.index if i < j and pdf.competition_id[i] == pdf.competition_id[j] and unit[i] @ unit[j] > 0.4}
    pairs = lambda d: {(r.reflection_id_a, r.reflection_id_b) for r in d.collect()}
    assert pairs(views.lesson_duplicates_all(df, 0.4, block)) == want
    assert pairs(views.lesson_duplicates(df, 0.4)) == want


def test_dataset_distance_parts(spark):
    cols = "competition_id int, task_type string, metric string, size_class string, n_numeric int, n_categorical int, missing_ratio_overall double, cardinality_max long, target_stat double"
    rows = [
        (0, "binary", "auc", "mid", 5, 5, 0.0, 9, 0.5), (1, "binary", "auc", "mid", 5, 5, 0.0, 9, 0.5), (2, "regression", "rmse", "large", 5, 5, 0.0, 9, 0.5),
        (3, "binary", "logloss", None, 10, 0, 0.2, None, 0.25),
    ]
    got = {r.competition_id: r.distance for r in R.similar_datasets(spark.createDataFrame(rows, cols), 0, 3).collect()}
    assert got == {1: 0.0, 2: pytest.approx(170.0), 3: pytest.approx(5.0 + 5.0 + 1.0 + 2 * np.log(10) + 0.5)}


def test_impact_without_spread_keeps_similarity(spark):
    cand = spark.createDataFrame([("a", 0.5, 0.0, "avoid"), ("b", 0.4, 3.0, "no_op")], "reflection_id string, sim double, avg_gain double, lesson_type string")
    stats = spark.createDataFrame([(0.0, 0.0)], "gain_mean double, gain_std double")
    assert {r.reflection_id: r.score for r in R.impact_score(cand, stats).collect()} == {"a": 0.5, "b": 0.2}


@pytest.mark.parametrize("blocks", [(8192, 2048), (7, 3)])
def test_candidates_of_many_queries_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(R, "ROWS_OF_BLOCK", blocks)
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(3)), ["L1_local", "L2_class", "L3_general", None][i % 4], bool(i % 9 == 5), [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(90)]
    rows += [(100 + i, 1, "L1_local", False, rows[3][4]) for i in range(30)]  # ties
    rows += [(200, 1, "L2_class", False, None), (201, 1, "L2_class", False, [0.0] * 6), (202, 1, "L2_class", False, [1.0, 2.0]), (203, None, "L1_local", False, [1.0] * 6), (204, 1, "L2_class", False, [None] * 6)]
    lessons = spark.createDataFrame(rows, "reflection_id long, competition_id int, generality string, archived boolean, embedding array<float>")
    impact = spark.createDataFrame([(3, 0.5)], "reflection_id long, avg_gain double")
    queries = lessons.filter("reflection_id % 4 = 0 OR reflection_id > 200").selectExpr("reflection_id AS query_id", "competition_id", "embedding")
    got = {}
    for r in R.candidates_of(queries, lessons, impact, 2).collect():
        got.setdefault(r.query_id, []).append((-r.sim, r.reflection_id))
    fits = lambda v: v is not None and None not in v and any(v)
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    want = {}
    for q, home, _, _, v in rows:
        if (q % 4 == 0 or q > 200) and fits(v):
            mine = [(-cos(v, w), i) for i, c, g, gone, w in rows if not gone and fits(w) and len(w) == len(v) and ((home is not None and c == home) or g in ("L2_class", "L3_general"))]
            if mine:
                want[q] = sorted(mine)[:8]
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert R.candidates_of(queries.limit(0), lessons, impact).count() == 0


def test_search_of_a_table_equals_single_searches(spark):
    t = roles.Roles(spark, "/root/testdata/sf0.001")
    queries = t.lessons.filter("reflection_id IN (0, 140, 260)").selectExpr("reflection_id AS query_id", "competition_id", "embedding")
    many = {}
    for r in R.search_table(queries, t.lessons, t.impact).collect():
        many.setdefault(r.query_id, {})[r.place] = r.reflection_id
    for q in queries.collect():
        one = {r.place: r.reflection_id for r in R.search(t.lessons, t.impact, [float(x) for x in q.embedding], q.competition_id).collect()}
        assert many[q.query_id] == one


def test_candidates_keep_the_digits_that_do_not_rank(spark):
    """A cosine just below the middle of two numbers of six digits is not moved over it by rounding to nine first."""
    at = lambda c: [c, (1 - c * c) ** 0.5]
    rows = [(1, 1, "L2_class", False, at(0.2190324999157265)), (2, 1, "L2_class", False, at(0.21903249992)), (3, 1, "L2_class", False, at(0.3))]
    lessons = spark.createDataFrame(rows, "reflection_id long, competition_id int, generality string, archived boolean, embedding array<double>")
    queries = spark.createDataFrame([(9, 1, [1.0, 0.0])], "query_id long, competition_id int, embedding array<double>")
    got = R.candidates_of(queries, lessons, spark.createDataFrame([], "reflection_id long, avg_gain double")).collect()
    assert {r.reflection_id: round(r.sim, 6) for r in got} == {1: 0.219032, 2: 0.219032, 3: 0.3}
