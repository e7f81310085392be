"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, free_name, id_key, running_sum, stored, whole

UNIT = 1 << 20  # expected copies are counted in parts of this size, so prefix sums are exact integers


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """source, source_size, target: shares of the total size by weight, none above ``most`` times its source's size.

    Sources in order of their code points, null last, take the weights in turn. What a stopped source leaves is shared by
    weight among the others: the level L with sum(min(most * size, L * weight)) = total, which is the largest of
    (total - sizes stopped) / (weights left) over the sources in order of size over weight.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("bigint"))
    ranked = running_sum(sizes, [], [F.col("source").asc_nulls_last()], {"rank": "one"})
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", weight.alias("weight"))
    filled = running_sum(weighed, [], [(F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()], {"size_to": "source_size", "weight_to": "weight"})
    filled = stored(filled)
    # before a source: what is stopped ahead of it, and the weights from it on; one number leaves the sources
    ahead = F.lit(most) * (F.col("size_to") - F.col("source_size"))
    total, weights_sum = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left = F.lit(weights_sum) - (F.col("weight_to") - F.col("weight"))
    level = filled.agg(F.max((F.lit(total) - ahead) / left)).first()[0] or 0.0
    return filled.select("source", "source_size", F.least(F.lit(most) * F.col("source_size"), F.lit(level) * F.col("weight")).alias("target"))


def copies_of(upto: Column, expected: Column, offset: Column) -> Column:
    """Integer boundaries crossed by a running sum of expected copies (in units of 1/UNIT) plus an offset."""
    return (F.floor((upto + offset) / UNIT) - F.floor((upto + offset - expected) / UNIT)).cast("bigint")


def source_key(source: Column) -> Column:
    """A text that tells a null source from one that is named ``null``."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string")))


def source_offset(seed: int, draw: int) -> Column:
    """A random offset of a source, in units: the first 20 bits of a digest of seed, draw and source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{draw}:"), id_key(F.col("source")))), 1, 5), 16, 10).cast("bigint")


def source_offsets(laid: DataFrame, seed: int, draws: int) -> DataFrame:
    """(_source_key, offset): of a few random offsets of every source the one whose words come nearest to the target; the first of equals."""
    taken = laid.groupBy("_source_key", "source").agg(F.first("target").alias("target"), *[F.sum(copies_of(F.col("upto"), F.col("expected"), source_offset(seed, i)) * F.col("size")).alias(f"t{i}") for i in range(draws)])
    misses = F.array_sort(F.array(*[F.struct(F.abs(F.col(f"t{i}") - F.col("target")).alias("miss"), F.lit(i).alias("draw"), source_offset(seed, i).alias("offset")) for i in range(draws)]))
    return taken.select("_source_key", misses[0]["offset"].alias("offset"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, seed: int = 42, draws: int = 16) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, text_key.

    size counts words; every document of a source expects target / source_size copies. Documents of a source are laid out by
    falling size, so the words taken miss the target by less than the largest document; one seeded offset per source decides
    where the copies fall, the best of ``draws``. Null texts are empty, null sources are a source of their own, and a source without words expects
    one copy of each document. Rows that repeat id and size are interchangeable. Empty in, empty out.
    """
    sized = stored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                               word_count(whole()).alias("size"), F.xxhash64(whole()).alias("text_key")))
    targets = source_targets(sized, weights, most).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("expected", F.round(rate * UNIT).cast("bigint"))
    rows = rows.withColumn("_source_key", source_key(F.col("source")))
    laid = running_sum(rows, ["_source_key"], [F.col("size").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_key")], {"upto": "expected"})
    offsets = stored(source_offsets(laid, seed, draws))  # a row per source, whose size the join can see
    placed = laid.join(offsets, "_source_key").withColumn("copies", copies_of(F.col("upto"), F.col("expected"), F.col("offset")))
    return placed.withColumn("taken", F.col("copies") * F.col("size")).drop("expected", "upto", "offset", "_source_key")


def emit(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, seed: int = 42) -> DataFrame:
    """The mixed documents, each as often as it was drawn, with all its columns."""
    key, text, source, copies, nth = (free_name(docs, c) for c in ("_id_key", "_text_key", "_source_key", "_copies", "_nth"))
    drawn = mix(docs, weights, most, seed).groupBy(id_key(F.col("doc_id")).alias(key), F.col("text_key").alias(text), source_key(F.col("source")).alias(source)).agg(F.sum("copies").alias("total"), F.count("*").alias("rows"))
    # rows that repeat id, text and source share their copies evenly
    rows = docs.withColumns({key: id_key(F.col("doc_id")), text: F.xxhash64(whole()), source: source_key(F.col("source"))})
    by = [key, text, source]
    first = Window.partitionBy(*by).orderBy(*[F.col(f"`{c}`").cast("string") for c in docs.columns if c != "text"])
    placed = rows.join(drawn.withColumnsRenamed({"total": copies, "rows": f"{copies}_rows"}), by).withColumn(nth, F.row_number().over(first))
    share = F.floor(F.col(copies) / F.col(f"{copies}_rows")) + (F.col(nth) <= F.col(copies) % F.col(f"{copies}_rows")).cast("bigint")
    chosen = placed.filter(share > 0).withColumn(nth, F.explode(F.sequence(F.lit(1), share.cast("int"))))
    return chosen.select(*[F.col(f"`{c}`") for c in docs.columns])
