"""Order-dependent operators that never put one hot key into one task.

A running value over an ordered key is computed in two levels. The order column of a hot key is cut into slices at
quantiles of its own rows and every (key, slice) is a window partition of its own, so a key that holds a third of all
rows is spread evenly over as many tasks as it has slices, whatever its outliers. A second, pre-aggregated table holds one row per slice; its running value over the earlier
slices is the carry that is joined back, on the partitioning the window already has. Rows that compare equal on the
slice column share a slice, so the cut never changes the order. All other keys keep their single shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import hot_rows, slice_count

SLICE = "_slice"


def time_position(ts: str) -> Column:
    """A timestamp (with or without zone) as microseconds, monotone in time."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def with_slice(df: DataFrame, keys: Sequence[str], position: Column, n: int | None = None) -> DataFrame:
    """Add the slice number: 0 for ordinary keys, 1 to n for hot ones, cut at quantiles of their ``position``.

    Hot are the keys with more than ``spark.ledgerlark.hotRows`` rows, null keys too. They are counted first, a partial
    aggregation over the key columns; without a hot key that is all, and the rows pass as they are. Otherwise quantiles are
    taken over the rows of the hot keys alone, and the join with the cut points is planned by size. Rows of equal position
    share a slice; null positions come first, as in the order of the rows.
    """
    n = n or slice_count(df.sparkSession)
    place = position.cast("double")
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_in_key")).filter(F.col("_in_key") > hot_rows(df.sparkSession))
    if n < 2 or hot.isEmpty():
        return df.withColumn(SLICE, F.lit(0))
    hot = hot.select(*[F.col(k).alias(f"_hot{i}") for i, k in enumerate(keys)])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_hot{i}")) for i, k in enumerate(keys)])
    hot_rows_only = df.select(*keys, place.alias("_place")).join(hot, same, "left_semi")
    cuts = F.percentile_approx("_place", [i / n for i in range(1, n)], max(1000, 20 * n)).alias("_cut_points")
    found = hot_rows_only.groupBy(*keys).agg(cuts).filter(F.size("_cut_points") > 0).withColumn("_cut_points", F.array_distinct("_cut_points"))
    # cut points in blocks, so that a row is compared with about twice the root of their number
    step = max(1, math.isqrt(n))
    blocks = F.transform(F.sequence(F.lit(0), F.lit((n - 1) // step)), lambda i: F.slice("_cut_points", i * step + 1, F.lit(step)))
    found = found.withColumn("_blocks", F.filter(blocks, lambda b: F.size(b) > 0))
    found = found.select(*[F.col(k).alias(f"_hot{i}") for i, k in enumerate(keys)], "_blocks", F.transform("_blocks", lambda b: F.element_at(b, -1)).alias("_ends"))
    marked = df.withColumn("_place", place).join(found, same, "left")
    passed = F.size(F.filter("_ends", lambda c: c < F.col("_place")))
    inside = F.size(F.filter(F.coalesce(F.try_element_at("_blocks", passed + 1), F.array().cast("array<double>")), lambda c: c < F.col("_place")))
    cut = F.when(F.col("_ends").isNull(), 0).when(F.col("_place").isNull(), 1).otherwise(passed * step + inside + 1)
    return marked.select(*[F.col(f"`{c}`") for c in df.columns], cut.cast("int").alias(SLICE))


def same_key(keys: Sequence[str]) -> list[Column]:
    """Stand-ins for keys that are never null, so that windows and the joins on them share one partitioning."""
    return [F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(f"_key{i}") for i, k in enumerate(keys)]


def hash_slice(df: DataFrame, digest: Column) -> DataFrame:
    """Slices by the leading hex digits of a digest: balanced by construction and ordered like the digest."""
    digits = 1
    while 16**digits < slice_count(df.sparkSession):
        digits += 1
    return df.withColumn(SLICE, F.substring(digest, 1, digits))


def _carry(sliced: DataFrame, keys: Sequence[str], aggs: dict[str, tuple[str, Column]], order: Sequence[Column]) -> DataFrame:
    """One row per (hot key, slice) with the combined value of all earlier slices."""
    if dict(sliced.dtypes)[SLICE] == "int":
        sliced = sliced.filter(F.col(SLICE) > 0)
    rank = F.struct(*order) if order else None
    per_slice = []
    for name, (kind, col) in aggs.items():
        if kind == "count":
            agg = F.count(F.lit(1))
        elif kind == "sum":
            agg = F.sum(col)
        elif kind == "max":
            agg = F.max(col)
        elif kind == "last":
            agg = F.max_by(col, F.when(col.isNotNull(), rank))
        else:
            raise ValueError(f"unknown running aggregate {kind!r}")
        per_slice.append(agg.alias(name))
    earlier = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    combined = []
    for name, (kind, _) in aggs.items():
        fn = {"count": F.sum, "sum": F.sum, "max": F.max}.get(kind)
        over = fn(name).over(earlier) if fn else F.last(name, ignorenulls=True).over(earlier)
        combined.append(over.alias(f"_carry_{name}"))
    return sliced.groupBy(*keys, SLICE).agg(*per_slice).select(*keys, SLICE, *combined)


def running(
    sliced: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    aggs: dict[str, tuple[str, Column]],
    *,
    before: bool = False,
) -> DataFrame:
    """Running ``count`` / ``sum`` / ``max`` / ``last`` per key in ``order``; ``sliced`` carries the slice column.

    ``order`` must refine the slice order. With ``before`` the current row is left out. A null key is a key like any other.
    """
    end = -1 if before else W.currentRow
    columns = sliced.columns
    sliced = sliced.select("*", *same_key(keys))
    keys = [f"_key{i}" for i in range(len(keys))]
    local = W.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(W.unboundedPreceding, end)
    cols = []
    for name, (kind, col) in aggs.items():
        if kind == "count":
            cols.append(F.count(F.lit(1)).over(local).alias(f"_local_{name}"))
        elif kind == "sum":
            cols.append(F.sum(col).over(local).alias(f"_local_{name}"))
        elif kind == "max":
            cols.append(F.max(col).over(local).alias(f"_local_{name}"))
        else:
            cols.append(F.last(col, ignorenulls=True).over(local).alias(f"_local_{name}"))
    carry = _carry(sliced, keys, aggs, order)
    joined = sliced.select("*", *cols).join(carry, [*keys, SLICE], "left")
    out = []
    for name, (kind, _) in aggs.items():
        loc, car = F.col(f"_local_{name}"), F.col(f"_carry_{name}")
        if kind == "count":
            value = F.coalesce(loc, F.lit(0)) + F.coalesce(car, F.lit(0))
        elif kind == "sum":
            value = F.when(loc.isNull(), car).when(car.isNull(), loc).otherwise(loc + car)
        elif kind == "max":
            value = F.greatest(loc, car)
        else:
            value = F.coalesce(loc, car)
        out.append(value.alias(name))
    return joined.select(*columns, *out).drop(SLICE)


def previous(sliced: DataFrame, keys: Sequence[str], order: Sequence[Column], cols: dict[str, Column]) -> DataFrame:
    """Values of the directly preceding row of the key (``lag``); null values of that row stay null."""
    whole = F.struct(*[c.alias(n) for n, c in cols.items()])
    out = running(sliced, keys, order, {"_prev": ("last", whole)}, before=True)
    return out.select(*[c for c in out.columns if c != "_prev"], *[F.col(f"_prev.{n}").alias(n) for n in cols])


def as_of(
    left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], *, tie: str, prefix: str = "prev_"
) -> DataFrame:
    """For every left row the right row of the same key with the greatest ``ts`` strictly before it.

    Equal right timestamps are ordered by ``tie``. Both sides become one stream of rows; right rows sort after
    left rows of the same instant, which makes the comparison strict.
    """
    own = F.struct(*[F.col(c) for c in left.columns])
    a = left.select(*keys, F.col(ts), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), own.alias("_own"),
                    F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_val"))
    b = right.select(*keys, F.col(ts), F.lit(1).alias("_side"), F.col(tie).alias("_tie"),
                     F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_own"),
                     F.struct(*values).alias("_val"))
    sliced = with_slice(a.unionByName(b), keys, time_position(ts))
    out = running(sliced, keys, [F.col(ts), F.col("_side"), F.col("_tie")], {"_hit": ("last", F.col("_val"))})
    return out.filter("_side = 0").select("_own.*", *[F.col(f"_hit.{v}").alias(prefix + v) for v in values])


def later_weighted_sum(
    sliced: DataFrame, keys: Sequence[str], order: Sequence[Column], values: dict[str, Column], decay: float
) -> DataFrame:
    """Per key: sum of value * decay^(number of later rows), the closed form of an ordered decayed update."""
    local_desc = W.partitionBy(*keys, SLICE).orderBy(*[c.desc() for c in order])
    weighted = sliced.withColumn("_later", F.row_number().over(local_desc) - 1)
    per_slice = weighted.groupBy(*keys, SLICE).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(v * F.pow(F.lit(decay), F.col("_later"))).alias(n) for n, v in values.items()],
    )
    later = W.partitionBy(*keys).orderBy(F.col(SLICE).desc()).rowsBetween(W.unboundedPreceding, -1)
    shifted = per_slice.withColumn("_after", F.coalesce(F.sum("_n").over(later), F.lit(0)))
    return shifted.groupBy(*keys).agg(
        F.sum("_n").alias("updates"),
        *[F.sum(F.col(n) * F.pow(F.lit(decay), F.col("_after"))).alias(n) for n in values],
    )


def ordered_percentiles(df: DataFrame, keys: Sequence[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles per key (``percentile_cont``) without a per-key buffer.

    Equal values are counted first, so copies cost one row; cumulative counts over the distinct values give the
    two order statistics around each rank.
    """
    counted = df.select(*keys, value.cast("double").alias("_v")).filter("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    cum = running(with_slice(counted, keys, F.col("_v")), keys, [F.col("_v")], {"_upto": ("sum", F.col("_c"))})
    totals = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ranked = cum.join(totals, list(keys))
    picks = []
    for name, p in shares.items():
        rank = F.lit(float(p)) * (F.col("_n") - 1)
        for end, r in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            hit = (F.col("_upto") - F.col("_c") <= r) & (F.col("_upto") > r)
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"{name}_{end}"))
    spread = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)
    out = []
    for name, p in shares.items():
        rank = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(name))
    return spread.select(*keys, *out)


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows per key in ``order``; Spark limits every map task to ``n`` rows per key first."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)
