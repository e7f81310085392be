"""Near-duplicate lessons through an index of random hyperplanes, verified on the vectors.

Two vectors at angle ``a`` lie on the same side of a random hyperplane with probability ``1 - a / pi``. A table cuts the lessons
of a competition by as many hyperplanes as leave about ``bucket`` of them on each side; there are as many tables as it takes
for a pair exactly at the threshold to share a bucket of some table with probability ``1 - miss``. Nearer pairs are surer. Hyperplanes
grow with the logarithm of the lessons, tables with a power of about 0.22 of them at a cosine of 0.9, so the work grows far
slower than the square. Only pairs that pass the exact cosine leave a task.

Lessons with equal vectors form one class, and the index holds one row per class: copies are never compared with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..constants import DUPLICATE_COSINE
from ..session import work_dir
from . import views

BUCKET = 64  # classes of a bucket, about
MISS = 1e-3  # probability that a pair at the threshold shares no bucket
BLOCK = 1024  # rows of a bucket that are compared in one task
PLANES = 40  # hyperplanes of a table, at most: 2^40 buckets
MOST_TABLES = 64  # tables, at most: a class is posted once per table
CLASS = ["competition_id", "class_id"]


def planes_of(rows: int, bucket: int = BUCKET) -> int:
    """Hyperplanes that leave about ``bucket`` of so many rows in a bucket."""
    return min(PLANES, max(0, math.ceil(math.log2(max(rows, 1) / bucket))))


def tables_of(planes: int, threshold: float, miss: float = MISS) -> int:
    """Tables after which a pair at the threshold is missed with probability ``miss``; without hyperplanes one is exact."""
    agree = (1.0 - math.acos(threshold) / math.pi) ** planes
    return 1 if agree >= 1.0 else max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def cut_of(rows: int, threshold: float, bucket: int = BUCKET, miss: float = MISS) -> tuple[int, int]:
    """(hyperplanes, tables) of a competition: buckets of about ``bucket`` classes, or larger ones where these would need more than
    MOST_TABLES tables. A low threshold needs so many tables that a class is posted more often than there are others to compare it
    with; fewer hyperplanes keep the probability of a miss, and what is posted stays in proportion to the classes."""
    planes = planes_of(rows, bucket)
    while planes > 1 and tables_of(planes, threshold, miss) > MOST_TABLES:
        planes -= 1
    return planes, tables_of(planes, threshold, miss)


def _packed(codes: np.ndarray, planes: int) -> list[bytes]:
    """The codes of each row as bytes, as narrow as the hyperplanes allow."""
    return [row.tobytes() for row in codes.astype(_narrow(planes))]


def _narrow(planes: int) -> str:
    return "uint8" if planes <= 8 else "uint16" if planes <= 16 else "uint64"


def _units(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype("float64")
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def codes_of(units: np.ndarray, planes: int, tables: int, seed: int) -> np.ndarray:
    """Bucket of every row in every table. Hyperplanes follow from (seed, table, dimension), so a repeated task gets the same ones."""
    out = np.zeros((len(units), tables), dtype="int64")
    for t in range(tables if planes else 0):
        normal = np.random.default_rng([seed, t, units.shape[1]]).normal(size=(units.shape[1], planes))
        out[:, t] = (units @ normal > 0) @ (1 << np.arange(planes, dtype="int64"))
    return out


def vector_classes(lessons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes) of the live lessons that have a vector of the usual length of their competition.

    members: competition_id, reflection_id, class_id, the smallest reflection_id with the same vector.
    classes: competition_id, class_id, n (members), embedding.
    """
    live = views._with_vectors(lessons, ["reflection_id", "competition_id", "embedding"])
    classes = live.groupBy("competition_id", "embedding").agg(F.min("reflection_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    members = live.join(classes.drop("n"), ["competition_id", "embedding"]).select("competition_id", "reflection_id", "class_id")
    return members, classes.select(*CLASS, "n", "embedding")


def indexed_pairs(classes: DataFrame, threshold: float = DUPLICATE_COSINE, bucket: int = BUCKET, miss: float = MISS, seed: int = 11) -> DataFrame:
    """(competition_id, class_a, class_b, cos_sim): pairs of classes above the threshold that share a bucket, each once.

    A pair comes out of the first table in which it shares a bucket, so nothing is collected to tell repeats. Buckets of more than
    BLOCK rows are cut into blocks whose pairs are separate work; buckets of one row end at the count.
    """
    sizes = classes.groupBy("competition_id").agg(F.count(F.lit(1)).alias("_rows"))
    kind = dict(classes.dtypes)
    schema = f"competition_id {kind['competition_id']}, class_id {kind['class_id']}, embedding {kind['embedding']}, _planes int, _packed binary, _codes array<bigint>"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (rows, _), part in batch.groupby(["_rows", batch["embedding"].map(len)]):
                planes, tables = cut_of(int(rows), threshold, bucket, miss)
                codes = codes_of(_units(part["embedding"]), planes, tables, seed)
                yield part.drop(columns="_rows").assign(_planes=planes, _packed=_packed(codes, planes), _codes=list(codes))

    placed = classes.select(*CLASS, "embedding").join(sizes, "competition_id").mapInPandas(place, schema)
    placed.write.parquet(path := work_dir(classes.sparkSession) + "/placed")
    placed = classes.sparkSession.read.schema(placed.schema).parquet(path)
    posted = placed.select(*CLASS, "embedding", "_planes", "_packed", F.posexplode("_codes").alias("_table", "_code"))
    key = ["competition_id", "_table", "_code"]
    counts = placed.select("competition_id", F.posexplode("_codes").alias("_table", "_code")).groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    counts.write.parquet(path := work_dir(classes.sparkSession) + "/counts")  # its size is known: the postings are not shuffled to meet few buckets
    counts = classes.sparkSession.read.schema(counts.schema).parquet(path)
    posted = posted.join(counts, key).withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("bigint"))
    own = posted.withColumn("_own", F.pmod(F.xxhash64("class_id"), F.col("_blocks")))
    meeting = own.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
    meeting = meeting.withColumns({"_lo": F.least("_own", "_other"), "_hi": F.greatest("_own", "_other")}).drop("_other", "_n", "_blocks")

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        table, lo, hi = (int(group[c].iloc[0]) for c in ("_table", "_lo", "_hi"))
        units, ids, blocks = _units(group["embedding"]), group["class_id"].to_numpy(), group["_own"].to_numpy()
        left, right = np.flatnonzero(blocks == lo), np.flatnonzero(blocks == hi)
        sim = units[left] @ units[right].T
        near = np.triu(sim > threshold, k=1) if lo == hi else sim > threshold
        i, j = np.nonzero(near)
        codes = np.stack([np.frombuffer(b, _narrow(int(group["_planes"].iloc[0]))) for b in group["_packed"]])
        first = (codes[left[i]] == codes[right[j]]).argmax(axis=1) == table
        i, j = i[first], j[first]
        a, b = ids[left[i]], ids[right[j]]
        return pd.DataFrame({"competition_id": group["competition_id"].iloc[0], "class_a": np.minimum(a, b), "class_b": np.maximum(a, b), "cos_sim": sim[i, j]})

    out = f"competition_id {kind['competition_id']}, class_a {kind['class_id']}, class_b {kind['class_id']}, cos_sim double"
    return meeting.groupBy(*key, "_lo", "_hi").applyInPandas(pairs, out)


def duplicate_links(lessons: DataFrame, threshold: float = DUPLICATE_COSINE, bucket: int = BUCKET, miss: float = MISS) -> DataFrame:
    """One row per live lesson with a usable vector: competition_id, reflection_id, class_id, copies (other lessons with the same
    vector) and links (other lessons above the threshold, copies included). Vectors of zeros are near nothing, themselves included."""
    members, classes = vector_classes(lessons)
    pairs = indexed_pairs(classes, threshold, bucket, miss)
    ends = pairs.select("competition_id", F.explode(F.array(F.struct(F.col("class_a").alias("class_id"), F.col("class_b").alias("other")),
                                                           F.struct(F.col("class_b").alias("class_id"), F.col("class_a").alias("other")))).alias("e"))
    weights = classes.select("competition_id", F.col("class_id").alias("other"), "n")
    linked = ends.select("competition_id", "e.class_id", "e.other").join(weights, ["competition_id", "other"]).groupBy(*CLASS).agg(F.sum("n").alias("_linked"))
    within = F.when(F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: F.isnan(x)), F.col("n") - 1).otherwise(F.lit(0))
    sizes = classes.join(linked, CLASS, "left").select(*CLASS, (F.col("n") - 1).alias("copies"), (within + F.coalesce("_linked", F.lit(0))).cast("bigint").alias("links"))
    return members.join(sizes, CLASS).select("competition_id", "reflection_id", "class_id", "copies", "links")


def exact_links(queries: DataFrame, lessons: DataFrame, threshold: float = DUPLICATE_COSINE, block: int = 2048) -> DataFrame:
    """(competition_id, reflection_id, links) of the asked lessons by comparing each with all live lessons of its competition.

    ``queries`` has competition_id and reflection_id. Both sides are dealt to blocks; a task multiplies one block with another.
    """
    live = views._with_vectors(lessons, ["reflection_id", "competition_id", "embedding"])
    asked = live.join(queries.select("competition_id", "reflection_id").distinct(), ["competition_id", "reflection_id"])
    asked = asked.select(*[F.col(c).alias(c) for c in live.columns])  # columns of its own, apart from those of the other side
    blocks = lambda df, name: df.groupBy("competition_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("bigint").alias(name))
    n = blocks(live, "_n").join(blocks(asked, "_m"), "competition_id")

    def dealt(df: DataFrame, own: str, size: str, other: str, others: str) -> DataFrame:
        rows = df.join(n, "competition_id").withColumn(own, F.pmod(F.xxhash64("reflection_id"), F.col(size)))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(others) - 1))).drop("_n", "_m")

    key = ["competition_id", "_l", "_q"]
    kind = dict(live.dtypes)

    def count(theirs: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        if not len(theirs) or not len(mine):
            return pd.DataFrame(columns=["competition_id", "reflection_id", "links"])
        near = _units(mine["embedding"]) @ _units(theirs["embedding"]).T > threshold
        near &= mine["reflection_id"].to_numpy()[:, None] != theirs["reflection_id"].to_numpy()[None, :]
        return pd.DataFrame({"competition_id": mine["competition_id"], "reflection_id": mine["reflection_id"], "links": near.sum(axis=1)})

    parts = dealt(live, "_l", "_n", "_q", "_m").groupBy(*key).cogroup(dealt(asked, "_q", "_m", "_l", "_n").groupBy(*key)).applyInPandas(
        count, f"competition_id {kind['competition_id']}, reflection_id {kind['reflection_id']}, links bigint")
    return parts.groupBy("competition_id", "reflection_id").agg(F.sum("links").alias("links"))


def index_recall(queries: DataFrame, lessons: DataFrame, threshold: float = DUPLICATE_COSINE, bucket: int = BUCKET, miss: float = MISS) -> DataFrame:
    """Per competition: how many lessons were asked, their links by comparison with all, and those that the index found."""
    exact = exact_links(queries, lessons, threshold)
    found = duplicate_links(lessons, threshold, bucket, miss).select("competition_id", "reflection_id", F.col("links").alias("_found"))
    both = exact.join(found, ["competition_id", "reflection_id"], "left")
    return both.groupBy("competition_id").agg(F.count(F.lit(1)).alias("queries"), F.sum("links").alias("links"), F.sum(F.coalesce("_found", F.lit(0))).cast("bigint").alias("found"))
