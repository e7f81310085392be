"""Queries over retrieval and similarity."""

from pyspark.sql import functions as F

from ..constants import DUPLICATE_NEWEST
from ..functions import arrays
from ..operators import listings as L, neighbours, retrieval as R, summaries as S, views
from . import query
from .shared import r
from .views import DUPLICATES

OWN = "(competition_id = 3 OR generality IN ('L2_class', 'L3_general'))"
CANDIDATES = f"""SELECT reflection_id, competition_id, lesson_type, sim, coalesce(avg_gain, 0) AS avg_gain FROM (SELECT *, list_cosine_similarity(embedding::DOUBLE[],
 (SELECT embedding::DOUBLE[] FROM lessons WHERE reflection_id = 0)) AS sim FROM lessons WHERE NOT archived AND {OWN} ORDER BY sim DESC, reflection_id LIMIT 20) LEFT JOIN impact USING (reflection_id)"""


def _query_vector(t):
    """The vector a search text would be embedded to; here the one of the first lesson."""
    return [float(x) for x in t.lessons.filter("reflection_id = 0").select("embedding").first()[0]]


@query("rt_candidates", f"SELECT reflection_id, round(sim, 6) AS sim, avg_gain FROM ({CANDIDATES}) AS c")
def _(t):
    return r(R.candidates(t.lessons, t.impact, _query_vector(t), 3).select("reflection_id", "sim", "avg_gain"))


@query("rt_impact_score", f"""WITH s AS (SELECT avg(avg_gain) AS m, stddev_pop(avg_gain) AS sd FROM impact)
 SELECT reflection_id, round(sim * least(greatest(1 + 15e-2 * (avg_gain - m) / sd, 5e-1), 15e-1) * CASE WHEN lesson_type = 'no_op' THEN 5e-1 ELSE 1e0 END, 6) AS score FROM ({CANDIDATES}) AS c, s""")
def _(t):
    cand = R.candidates(t.lessons, t.impact, _query_vector(t), 3)
    return r(R.impact_score(cand, S.gain_stats(t.impact)).select("reflection_id", "score"))


@query("rt_mmr")
def _(t):
    """One greedy re-ranking per competition over its nearest lessons to the query."""
    from ..operators import prefix

    sim = R.cosine_to(_query_vector(t))("embedding")
    live = t.lessons.filter("NOT archived").select("reflection_id", "competition_id", "lesson_type", "embedding", sim.alias("sim"))
    near = prefix.newest_per_key(live, ["competition_id"], [F.col("sim").desc(), F.col("reflection_id")], 20).drop("rn")
    near = near.join(t.impact.select("reflection_id", "avg_gain"), "reflection_id", "left").fillna({"avg_gain": 0.0})
    return r(R.mmr(R.impact_score(near, S.gain_stats(t.impact)), 5, ["competition_id"]))


@query("rt_search")
def _(t):
    return r(R.search(t.lessons, t.impact, _query_vector(t), 3))


def _queries(t):
    """Every lesson whose id is divisible by 20 asks for lessons like itself."""
    return t.lessons.filter("reflection_id % 20 = 0").select(F.col("reflection_id").alias("query_id"), "competition_id", "embedding")


@query("rt_candidates_table", """SELECT query_id, reflection_id, round(sim, 6) AS sim, coalesce(avg_gain, 0) AS avg_gain FROM (SELECT q.reflection_id AS query_id, l.reflection_id,
 list_cosine_similarity(q.embedding::DOUBLE[], l.embedding::DOUBLE[]) AS sim,
 row_number() OVER (PARTITION BY q.reflection_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], l.embedding::DOUBLE[]), 9) DESC, l.reflection_id) AS place
 FROM lessons q JOIN lessons l ON NOT l.archived AND (l.competition_id = q.competition_id OR l.generality IN ('L2_class', 'L3_general')) WHERE q.reflection_id % 20 = 0)
 LEFT JOIN impact USING (reflection_id) WHERE place <= 20""")
def _(t):
    return r(R.candidates_of(_queries(t), t.lessons, t.impact).select("query_id", "reflection_id", "sim", "avg_gain"))


@query("rt_search_table")
def _(t):
    return r(R.search_table(_queries(t), t.lessons, t.impact))


@query("rt_near_duplicates", DUPLICATES.replace("> 0.90", "> 0.30"))
def _(t):
    return r(views.lesson_duplicates(t.lessons, threshold=0.30, newest=DUPLICATE_NEWEST))


@query("rt_near_duplicates_all", """SELECT a.competition_id, a.reflection_id AS reflection_id_a, b.reflection_id AS reflection_id_b,
 round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos_sim FROM (SELECT * FROM lessons WHERE NOT archived) a
 JOIN (SELECT * FROM lessons WHERE NOT archived) b ON a.competition_id = b.competition_id AND a.reflection_id < b.reflection_id
 WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.30""")
def _(t):
    return r(views.lesson_duplicates_all(t.lessons, threshold=0.30, block=16))


@query("rt_near_duplicates_exact", """SELECT a.competition_id, a.reflection_id AS reflection_id_a, b.reflection_id AS reflection_id_b,
 round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos_sim FROM lessons a JOIN lessons b ON a.competition_id = b.competition_id
 AND a.reflection_id < b.reflection_id WHERE NOT a.archived AND NOT b.archived AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.90""")
def _(t):
    return r(views.lesson_duplicates_all(t.lessons))


LINKS = """SELECT a.competition_id, a.reflection_id, count(b.reflection_id) AS links FROM lessons a LEFT JOIN lessons b ON a.competition_id = b.competition_id
 AND a.reflection_id <> b.reflection_id AND NOT b.archived AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.30 WHERE NOT a.archived GROUP BY ALL"""


@query("rt_near_duplicates_index", LINKS)
def _(t):
    """Links of every lesson through the index; the SQL compares all pairs. At 0.30, as few lessons of the given tables are nearer."""
    return neighbours.duplicate_links(t.lessons, threshold=0.30, bucket=8).select("competition_id", "reflection_id", "links")


@query("rt_index_recall", f"SELECT competition_id, count(*) AS queries, CAST(sum(links) AS BIGINT) AS links, true AS recalled FROM ({LINKS}) WHERE reflection_id % 20 = 0 GROUP BY ALL")
def _(t):
    """Recall of the index for lessons whose id is divisible by 20, against all of their competition: nine of ten links or more."""
    asked = t.lessons.filter("reflection_id % 20 = 0")
    rows = neighbours.index_recall(asked, t.lessons, threshold=0.30, bucket=8)
    return rows.select("competition_id", "queries", "links", (F.col("found") * 10 >= F.col("links") * 9).alias("recalled"))


@query("rt_normalise", """WITH c AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS v FROM embeddings)
 SELECT vec_id, round(v[1] / sqrt(list_inner_product(v, v)), 4) AS first_value, 32 AS n, round(1e0, 4) AS length FROM c""")
def _(t):
    v = t.raw("embeddings").select("vec_id", arrays.fit_dim(F.col("embedding"), 32).alias("v"))
    return v.select("vec_id", F.round(F.get("v", F.lit(0)).cast("double"), 4).alias("first_value"), F.size("v").alias("n"), F.round(arrays.norm(F.col("v")), 4).alias("length"))


_CLS = "CASE WHEN {x}.metric IN ('rmse', 'mae') THEN 'regression_error' WHEN {x}.metric = 'accuracy' THEN 'classification' ELSE 'binary_proba' END"
_RANK = "CASE {x}.size_class WHEN 'tiny' THEN 0 WHEN 'small' THEN 1 WHEN 'mid' THEN 2 ELSE 3 END"
DISTANCE = f"""SELECT b.competition_id, CASE WHEN a.task_type = b.task_type THEN 0e0 ELSE 1e2 END + CASE WHEN {_CLS.format(x='a')} = {_CLS.format(x='b')} THEN 0e0 ELSE 5e1 END
 + abs({_RANK.format(x='a')} - {_RANK.format(x='b')}) * 2e1 + abs(a.n_numeric / 25e0 - b.n_numeric / 25e0) * 1e1 + abs(a.n_categorical / 25e0 - b.n_categorical / 25e0) * 1e1
 + abs(a.missing_ratio_overall - b.missing_ratio_overall) * 5e0 + abs(ln(a.cardinality_max + 1) - ln(b.cardinality_max + 1)) * 2e0 + abs(a.target_stat - b.target_stat) * 2e0 AS distance
 FROM competitions b, (SELECT * FROM competitions WHERE competition_id = 0) a WHERE b.competition_id <> 0"""
NEAR = f"SELECT competition_id, distance FROM ({DISTANCE}) AS d ORDER BY round(distance, 9), competition_id LIMIT 3"


@query("rt_dataset_distance", f"SELECT competition_id, round(distance, 6) AS distance FROM ({NEAR}) AS n")
def _(t):
    return r(R.similar_datasets(t.competitions, 0))


@query("rt_cold_start", f"""WITH near AS ({NEAR}), l AS (SELECT 'lesson' AS kind, reflection_id AS id, generality, coalesce(avg_gain, 0) AS value FROM lessons LEFT JOIN impact USING (reflection_id)
 WHERE NOT archived AND ((generality = 'L2_class' AND competition_id IN (SELECT competition_id FROM near)) OR generality = 'L3_general') ORDER BY coalesce(avg_gain, 0) DESC, reflection_id LIMIT 10),
 s AS (SELECT 'seed' AS kind, pipeline_id AS id, 'pipeline' AS generality, gain_vs_best AS value FROM pipelines WHERE gain_vs_best > 0 AND competition_id IN (SELECT competition_id FROM near)
 ORDER BY gain_vs_best DESC, pipeline_id LIMIT 2) SELECT kind, id, generality, round(value, 6) AS value FROM (SELECT * FROM l UNION ALL SELECT * FROM s)""")
def _(t):
    return r(R.cold_start(t.competitions, t.lessons, t.impact, t.pipelines, 0))
