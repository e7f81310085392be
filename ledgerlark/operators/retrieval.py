"""Vector retrieval over lessons: candidates by cosine, impact weighting, diversity re-ranking, data-set similarity.

The vector product runs as an Arrow function over whole column batches; only the best ``4k`` candidates of a query
(a top-n that every task cuts to size first) meet the impact table and the greedy re-ranking.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.rules import round_half
from . import listings, prefix, summaries


def cosine_to(query: Sequence[float]):
    """A column function: cosine between an array column and one query vector; null for null or other sizes."""
    q = np.asarray(query, dtype="float64")
    q = q / max(float(np.linalg.norm(q)), 1e-300)

    @F.arrow_udf("double")
    def cosine(vectors: pa.Array) -> pa.Array:
        sizes = pa.compute.fill_null(pa.compute.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
        usable = sizes == len(q)
        out = np.full(len(vectors), np.nan)
        if usable.any():
            flat = vectors.filter(pa.array(usable)).flatten().to_numpy(zero_copy_only=False)
            m = flat.reshape(-1, len(q)).astype("float64")
            norms = np.linalg.norm(m, axis=1)
            out[usable] = np.divide(m @ q, norms, out=np.full(len(m), np.nan), where=norms > 0)
        return pa.array(out, mask=np.isnan(out))

    return cosine


def candidates(lessons: DataFrame, impact: DataFrame, query: Sequence[float], competition, k: int = 5) -> DataFrame:
    """The 4k live own or general lessons nearest to the query, with their average gain."""
    live = lessons.filter(listings.own_or_general(competition)).filter("NOT archived")
    near = live.withColumn("sim", cosine_to(query)("embedding"))
    top = near.orderBy(F.col("sim").desc_nulls_last(), F.col("reflection_id")).limit(4 * k)
    return top.join(impact.select("reflection_id", "avg_gain"), "reflection_id", "left").fillna({"avg_gain": 0.0})


def impact_score(cand: DataFrame, stats: DataFrame) -> DataFrame:
    """Similarity scaled by how far the lesson's gain lies from the global mean; no-op lessons count half."""
    one = stats.select(F.struct("gain_mean", "gain_std").alias("s")).scalar()
    z = F.when(one.getField("gain_std") > 1e-9, (F.col("avg_gain") - one.getField("gain_mean")) / one.getField("gain_std")).otherwise(0.0)
    factor = F.least(F.greatest(F.lit(1.0) + z * K.IMPACT_WEIGHT, F.lit(K.IMPACT_LOW)), F.lit(K.IMPACT_HIGH))
    damp = F.when(F.col("lesson_type") == "no_op", K.NOOP_DAMP).otherwise(1.0)
    return cand.withColumn("score", F.col("sim") * factor * damp)


def mmr(cand: DataFrame, k: int, group: Sequence[str] = (), lam: float = K.MMR_LAMBDA) -> DataFrame:
    """Greedy pick of k candidates per group: relevance (scaled to 0..1) against the nearest pick so far.

    A group is the candidate list of one query (4k rows), so the greedy loop sees bounded input. Lists of at most
    k rows pass unchanged, in order of similarity.
    """
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sim", "reflection_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        if len(pdf) <= k:
            return pdf.drop(columns="embedding").assign(place=np.arange(1, len(pdf) + 1))
        vectors = np.stack(pdf["embedding"].to_numpy()).astype("float32")
        vectors = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9)
        raw = pdf["score"].to_numpy(dtype="float32")
        width = float(raw.max() - raw.min())
        rel = (raw - raw.min()) / width if width > 1e-9 else np.ones_like(raw)
        chosen = [int(np.argmax(rel))]
        nearest = vectors @ vectors[chosen[0]]
        while len(chosen) < k:
            value = lam * rel - (1 - lam) * nearest
            value[chosen] = -np.inf
            chosen.append(int(np.argmax(value)))
            nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
        return pdf.iloc[chosen].drop(columns="embedding").assign(place=np.arange(1, k + 1))

    rows = cand if group else cand.withColumn("_query", F.lit(0))
    keys = list(group) or ["_query"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "embedding"]
    return rows.groupBy(*keys).applyInPandas(pick, ", ".join([*fields, "place bigint"])).drop("_query")


def search(lessons: DataFrame, impact: DataFrame, query: Sequence[float], competition, k: int = 5) -> DataFrame:
    """The k most useful and mutually different lessons for a query vector."""
    cols = ["reflection_id", "competition_id", "generality", "gain_vs_best", "lesson_type", "archived", "embedding"]
    scored = impact_score(candidates(lessons.select(*cols), impact, query, competition, k), summaries.gain_stats(impact))
    return mmr(scored, k)


# --- many queries at once ------------------------------------------------------------------------------------------------

ROWS_OF_BLOCK = (8192, 2048)  # lessons and queries that meet in one product
STRIP = 256  # queries whose similarities are held at a time
DIGITS = 9  # similarities that agree to so many digits are ties


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype("float64")
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _best_of_block(lessons: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest allowed lessons of the block for every query of the block: ``_near``, which ranks, has DIGITS digits, ``sim`` all but noise."""
    lessons = lessons.sort_values("reflection_id", kind="stable")
    ids, homes, general = (lessons[c].to_numpy() for c in ("reflection_id", "_home", "_general"))
    out = []
    if len(lessons) and len(queries):
        theirs = _unit(lessons["embedding"]).T
        for i in range(0, len(queries), STRIP):
            strip = queries.iloc[i:i + STRIP]
            whole = _unit(strip["_vector"]) @ theirs
            sim = np.round(whole, DIGITS)
            sim[~(general[None, :] | (strip["_own"].to_numpy()[:, None] == homes[None, :]))] = -np.inf
            for query, row, values in zip(strip["query_id"], sim, whole):
                if len(row) > k:  # everything at or above the k-th value, so that ties go by the id
                    at = np.flatnonzero(row >= np.partition(row, -k)[-k])
                else:
                    at = np.arange(len(row))
                at = at[np.argsort(-row[at], kind="stable")][:k]
                at = at[row[at] > -np.inf]
                out.append(pd.DataFrame({"query_id": query, "reflection_id": ids[at], "sim": np.round(values[at], 12), "_near": row[at]}))
    return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "reflection_id", "sim", "_near"])


def candidates_of(queries: DataFrame, lessons: DataFrame, impact: DataFrame, k: int = 5) -> DataFrame:
    """For every row of ``queries`` (query_id, competition_id, embedding) its 4k nearest live own or general lessons.

    Exact: lessons and queries are dealt to blocks, every pair of blocks is one matrix product in a task of its own, and a task
    hands on at most 4k rows per query; Spark merges them by rank. No vector goes through the driver, and no group holds more
    than two blocks. Rows whose vector is null, without length or of another size than the queries' are left out.
    """
    size = F.size("embedding")

    def usable(df: DataFrame) -> DataFrame:
        return df.filter("embedding IS NOT NULL").filter(F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))

    live = usable(lessons.filter("NOT archived")).select("reflection_id", F.coalesce(F.col("competition_id").cast("string"), F.lit("")).alias("_home"),
                                                         F.coalesce(F.col("generality").isin(*K.GENERALITY[1:]), F.lit(False)).alias("_general"), "embedding", size.alias("_size"))
    asked = usable(queries).select("query_id", F.coalesce(F.col("competition_id").cast("string"), F.lit("\0")).alias("_own"), F.col("embedding").alias("_vector"), size.alias("_size"))
    counts = live.agg(F.count("*")).first()[0], asked.agg(F.count("*")).first()[0]
    n_live, n_asked = (1 + n // rows for n, rows in zip(counts, ROWS_OF_BLOCK))

    def dealt(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        blocks = df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)))
        return blocks.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint"))))

    pair = ["_left", "_right", "_size"]
    left = dealt(live, "reflection_id", "_left", n_live, "_right", n_asked).groupBy(*pair)
    right = dealt(asked, "query_id", "_right", n_asked, "_left", n_live).groupBy(*pair)
    near = left.cogroup(right).applyInPandas(lambda a, b: _best_of_block(a, b, 4 * k), f"query_id {dict(queries.dtypes)['query_id']}, reflection_id {dict(lessons.dtypes)['reflection_id']}, sim double, _near double")
    top = prefix.newest_per_key(near, ["query_id"], [F.col("_near").desc(), F.col("reflection_id")], 4 * k).drop("rn", "_near")
    return top.join(impact.select("reflection_id", "avg_gain"), "reflection_id", "left").fillna({"avg_gain": 0.0})


def search_table(queries: DataFrame, lessons: DataFrame, impact: DataFrame, k: int = 5) -> DataFrame:
    """The k most useful and mutually different lessons for every query: ``search`` for a table of queries."""
    cols = ["reflection_id", "competition_id", "generality", "gain_vs_best", "lesson_type", "embedding"]
    near = candidates_of(queries, lessons, impact, k).join(lessons.select(*cols), "reflection_id")
    return mmr(impact_score(near, summaries.gain_stats(impact)), k, ["query_id"])


_METRIC_CLASS = {name: cls for name, (_, cls) in K.METRICS.items() if name != "roc_auc"}


def _lookup(col: Column, mapping: dict, default) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), F.lit(default))


def dataset_distance(a, b) -> Column:
    """Weighted distance of two data-set descriptions; ``a`` and ``b`` map a field name to its column."""
    def ratio(x, field: str) -> Column:
        total = F.coalesce(x("n_numeric"), F.lit(0)) + F.coalesce(x("n_categorical"), F.lit(0))
        return F.coalesce(x(field), F.lit(0)) / F.when(total == 0, 1).otherwise(total)

    def gap(x: Column, y: Column) -> Column:
        return F.abs(x - y)

    def number(x, field: str) -> Column:
        return F.coalesce(x(field).cast("double"), F.lit(0.0))

    def kind(x) -> Column:
        return _lookup(x("metric"), _METRIC_CLASS, "unknown")

    def size(x) -> Column:
        return _lookup(x("size_class"), K.SIZE_RANK, 2)

    def log_card(x) -> Column:
        return F.log(number(x, "cardinality_max") + 1)

    # The weights of the parts.
    return (
        F.when(a("task_type").eqNullSafe(b("task_type")), 0.0).otherwise(100.0)
        + F.when(kind(a) == kind(b), 0.0).otherwise(50.0)
        + gap(size(a), size(b)) * 20.0
        + gap(ratio(a, "n_numeric"), ratio(b, "n_numeric")) * 10.0
        + gap(ratio(a, "n_categorical"), ratio(b, "n_categorical")) * 10.0
        + gap(number(a, "missing_ratio_overall"), number(b, "missing_ratio_overall")) * 5.0
        + gap(log_card(a), log_card(b)) * 2.0
        + gap(number(a, "target_stat"), number(b, "target_stat")) * 2.0
    )


FINGERPRINT = ("task_type", "metric", "size_class", "n_numeric", "n_categorical", "missing_ratio_overall", "cardinality_max", "target_stat")


def similar_datasets(fingerprints: DataFrame, competition, k: int = 3) -> DataFrame:
    """The k competitions whose data set is nearest to that of the given one, which is read as a one-row subquery."""
    own = fingerprints.filter(F.col("competition_id") == competition).select(F.struct(*FINGERPRINT)).scalar()
    others = fingerprints.filter(F.col("competition_id") != competition)
    dist = dataset_distance(lambda f: own.getField(f), lambda f: F.col(f))
    return others.select("competition_id", dist.alias("distance")).orderBy(round_half(F.col("distance"), 9), "competition_id").limit(k)


def cold_start(fingerprints: DataFrame, lessons: DataFrame, impact: DataFrame, pipelines: DataFrame, competition, k: int = 10, n: int = 2) -> DataFrame:
    """What a new competition starts from: lessons and seed pipelines of its nearest data sets."""
    near = similar_datasets(fingerprints, competition)
    l = listings.cold_start_lessons(lessons, impact, near, k)
    s = listings.bootstrap_seeds(pipelines, near, n)
    return l.select(F.lit("lesson").alias("kind"), F.col("reflection_id").alias("id"), "generality", F.col("avg_gain").alias("value")).unionByName(
        s.select(F.lit("seed").alias("kind"), F.col("pipeline_id").alias("id"), F.lit("pipeline").alias("generality"), F.col("gain_vs_best").alias("value"))
    )


def level_counts(start: DataFrame) -> DataFrame:
    return start.groupBy("kind", "generality").agg(F.count(F.lit(1)).alias("n"))
