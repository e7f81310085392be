"""Training-set preparation: profiles, twin removal, source merge, row caps, splits, folds, encodings.

Splits and folds order rows by a digest of their id, so they do not depend on partitioning. Ranks inside a class
are taken per (class, digest prefix) and shifted by the counts of the smaller prefixes: a class that holds most
rows is spread evenly over many window groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..constants import AUDIT_SEED, PRESELECT_SHARE, ROW_CAP_SEED, TWIN_ABORT_SHARE
from ..session import work_dir
from . import prefix

_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)
ORIGIN = "is_original"


# --- columns ---------------------------------------------------------------------------------------------------------


def columns_of(df: DataFrame, kind: str) -> list[str]:
    """Names of the numeric, string or temporal columns."""
    test = {
        "numeric": lambda t: isinstance(t, T.NumericType),
        "string": lambda t: isinstance(t, T.StringType),
        "temporal": lambda t: isinstance(t, _TEMPORAL),
    }[kind]
    return [f.name for f in df.schema.fields if test(f.dataType)]


def drop_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def project_common(extra: DataFrame, base: DataFrame) -> DataFrame:
    return extra.select(*[c for c in extra.columns if c in base.columns])


def with_origin(df: DataFrame, original: bool) -> DataFrame:
    return df.withColumn(ORIGIN, F.lit(original))


def target_present(df: DataFrame, target: str) -> DataFrame:
    present = F.col(target).isNotNull()
    if isinstance(df.schema[target].dataType, (T.FloatType, T.DoubleType)):
        present = present & ~F.isnan(target)
    return df.filter(present)


def strip_target(df: DataFrame, target: str) -> DataFrame:
    return df.drop(target)


def mask_target(df: DataFrame, target: str) -> DataFrame:
    return df.withColumn(target, F.lit(None).cast(df.schema[target].dataType)) if target in df.columns else df


def dummy_target(df: DataFrame, train: DataFrame, target: str, row_id: str) -> DataFrame:
    """The target of the train row with the smallest id in every row, as one scalar subquery."""
    value = train.filter(F.col(target).isNotNull()).select(F.min_by(target, row_id)).scalar()
    return df.withColumn(target, value.cast(train.schema[target].dataType))


def string_codes(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(field, value, code): rank (from 0) of every distinct value of every column, in binary order.

    All columns go through one distinct, stored before it is used. Values are ranked by their first six bytes and then among those
    that share them, where a hot head is sliced by the bytes after the prefix its values share. The codes are stored too: a scan
    has a size, so a join with few codes is planned without a shuffle of the rows by their values.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in cols])).alias("p")
    values = _stored(train.select(pairs).select("p.*").filter("value IS NOT NULL").distinct())
    head = F.rpad(F.left(F.hex("value"), F.lit(12)), 12, "0")  # the first six bytes, in binary order
    values = values.withColumn("head", head)
    # heads are ranked first, with the values before each of them; one odd value does not touch the others
    heads = values.groupBy("field", "head").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    upto = prefix.running(prefix.with_slice(heads, ["field"], F.conv("head", 16, 10)), ["field"], [F.col("head")], {"upto": ("sum", F.col("n"))})
    same = F.zip_with(F.split("lo", ""), F.split("hi", ""), lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, False)
    shared = F.when(first > 0, first - 1).otherwise(F.length("lo")).cast("int").alias("_shared")
    keyed = values.join(upto.select("field", "head", (F.col("upto") - F.col("n")).alias("before"), shared), ["field", "head"])
    after = F.rpad(F.left(F.hex(F.substring("value", F.col("_shared") + 1, F.lit(6))), F.lit(12)), 12, "0")
    sliced = prefix.with_slice(keyed, ["field", "head"], F.conv(after, 16, 10))
    ranked = prefix.running(sliced, ["field", "head"], [F.col("value")], {"place": ("count", F.lit(1))})
    return _stored(ranked.select("field", "value", (F.col("before") + F.col("place") - 1).cast("int").alias("code")))


def _stored(df: DataFrame) -> DataFrame:
    df.write.parquet(path := work_dir(df.sparkSession))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apply_codes(df: DataFrame, codes: DataFrame, cols: Sequence[str]) -> DataFrame:
    """String columns replaced by their codes; null and unseen values become -1."""
    out = df
    for c in cols:
        own = codes.filter(F.col("field") == c).select(F.col("value").alias(c), F.col("code").alias("_code"))
        out = out.join(own, c, "left").withColumn(c, F.coalesce("_code", F.lit(-1))).drop("_code")
    return out.select(*df.columns)


def encode_strings(train: DataFrame, other: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """String columns of ``other`` as codes by the sorted distinct values of ``train``."""
    cols = list(cols) if cols is not None else columns_of(train, "string")
    return apply_codes(other, string_codes(train, cols), cols) if cols else other


def map_values(col: Column, mapping: dict, default) -> Column:
    """Values through a dictionary, others to the default."""
    pairs = reduce(lambda acc, kv: acc + [F.lit(kv[0]), F.lit(kv[1])], mapping.items(), [])
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), F.lit(default))


# --- profiles --------------------------------------------------------------------------------------------------------


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column and their share, from one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = counts.select("_n", F.explode(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c))])).alias("field", "nulls"))
    return rows.select("field", "nulls", (F.col("nulls") / F.col("_n")).alias("share"))


def _n_unique(c: str) -> Column:
    return F.count_distinct(F.col(c)) + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))


def cardinality(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Largest and mean number of distinct values (null counts as one) of the string columns."""
    cols = list(cols) if cols is not None else columns_of(df, "string")
    if not cols:
        return df.sparkSession.range(1).select(F.lit(0).cast("long").alias("cardinality_max"), F.lit(0.0).alias("cardinality_mean"))
    counts = df.agg(*[_n_unique(c).alias(c) for c in cols])
    most = F.greatest(*[F.col(c) for c in cols]) if len(cols) > 1 else F.col(cols[0])
    return counts.select(most.alias("cardinality_max"), (reduce(Column.__add__, [F.col(c) for c in cols]) / len(cols)).alias("cardinality_mean"))


def n_text_ish(df: DataFrame) -> DataFrame:
    """Number of string columns with a mean length above 20."""
    tests = [(F.coalesce(F.avg(F.length(c)), F.lit(0.0)) > 20).cast("long") for c in columns_of(df, "string")]
    return df.agg(reduce(Column.__add__, tests, F.lit(0).cast("long")).alias("n_text_ish"))


def target_stat(df: DataFrame, target: str, task: str) -> DataFrame:
    """Share of the rarest class, or the population skewness."""
    if task in ("binary", "multiclass"):
        counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("_c"))
        return counts.agg((F.min("_c") / F.sum("_c")).alias("target_stat"))
    return df.agg(F.coalesce(F.nanvl(F.skewness(target), F.lit(0.0)), F.lit(0.0)).alias("target_stat"))


def fingerprint(df: DataFrame, target: str, task: str, metric: str, sign: int) -> DataFrame:
    """One row that describes a data set: size, column kinds, missing share, cardinality and target shape."""
    x = df.drop(target)
    base = x.agg(
        F.count(F.lit(1)).alias("n_rows"),
        reduce(Column.__add__, [F.count_if(F.col(c).isNull()) for c in x.columns], F.lit(0)).alias("_missing"),
    )
    n, cells = F.col("n_rows"), F.col("n_rows") * len(x.columns)
    size = F.when(n < 10_000, "tiny").when(n < 100_000, "small").when(n < 1_000_000, "mid").otherwise("large")
    card = cardinality(x)
    return base.select(
        "n_rows", F.lit(len(x.columns)).alias("n_cols"), F.lit(task).alias("task_type"), F.lit(metric).alias("metric"),
        F.lit(sign).alias("metric_sign"), *[F.lit(len(columns_of(x, k))).alias(n_) for k, n_ in (("numeric", "n_numeric"), ("string", "n_categorical"), ("temporal", "n_datetime"))],
        n_text_ish(x).scalar().cast("int").alias("n_text_ish"),
        F.round(F.coalesce(F.try_divide(F.col("_missing"), cells), F.lit(0.0)), 6).alias("missing_ratio_overall"),
        card.select("cardinality_max").scalar().alias("cardinality_max"),
        F.round(card.select("cardinality_mean").scalar(), 2).alias("cardinality_mean"),
        F.round(target_stat(df, target, task).scalar(), 6).alias("target_stat"), size.alias("size_class"),
    )


# --- sources ---------------------------------------------------------------------------------------------------------


def _twin_keys(cols: Sequence[str]) -> list[Column]:
    """Every value as number, so numbers written differently meet, and one text key of all values that are none."""
    numbers = {c: F.col(c).cast("string").try_cast("double") for c in cols}
    texts = [F.when(n.isNotNull(), "#").otherwise(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("\0"))) for c, n in numbers.items()]
    return [F.concat_ws("\1", *texts).alias("_text"), *[F.coalesce(n, F.lit(0.0)).alias(f"_num_{c}") for c, n in numbers.items()]]


def remove_twins(extra: DataFrame, base: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Extra rows that equal no base row on all common columns; one row per base key enters the join."""
    keys = _twin_keys(cols)
    names = ["_text", *[f"_num_{c}" for c in cols]]
    return extra.select("*", *keys).join(base.select(*keys).distinct(), names, "left_anti").drop(*names)


def diagonal_union(*frames: DataFrame) -> DataFrame:
    """Rows of frames with different columns; a column with two types takes the wider one."""
    def widest(types: list[T.DataType]) -> T.DataType:
        if len({t.simpleString() for t in types}) == 1:
            return types[0]
        if all(isinstance(t, T.IntegralType) for t in types):
            return T.LongType()
        return T.DoubleType() if all(isinstance(t, T.NumericType) for t in types) else T.StringType()

    kinds: dict[str, list[T.DataType]] = {}
    for f in frames:
        for field in f.schema.fields:
            kinds.setdefault(field.name, []).append(field.dataType)
    cast = [f.select(*[F.col(c).cast(widest(kinds[c])).alias(c) for c in f.columns]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def merge_source(base: DataFrame, extra: DataFrame, target: str) -> DataFrame:
    """Rows a further source adds: common columns, target known, no twins of the base.

    More than half twins is a configuration error and stops the job from inside the plan.
    """
    common = [c for c in extra.columns if c in base.columns]
    if target not in common:
        raise ValueError(f"target column {target!r} missing in the extra source")
    loaded = extra.select(*common)
    usable = target_present(loaded, target)
    kept = remove_twins(usable, base, common)
    def n(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1))).scalar()

    message = F.lit("more than half of the extra rows are twins of base rows")
    guard = F.when(n(usable) - n(kept) > TWIN_ABORT_SHARE * n(loaded), F.raise_error(message).cast("boolean")).otherwise(True)
    return kept.filter(guard)


def load_train(
    base: DataFrame, extras: Sequence[DataFrame], target: str, *, drop: Sequence[str] = (), max_rows: int | None = None,
    is_classification: bool = False, row_id: Sequence[str] = (), apply_row_cap: bool = True,
) -> DataFrame:
    """The training frame: dropped columns, merged sources with their origin flag, optional row cap."""
    train = drop_cols(base, drop)
    if extras:
        merged = [with_origin(merge_source(train, e, target), True) for e in extras]
        train = diagonal_union(with_origin(train, False), *merged)
    if apply_row_cap and max_rows:
        train = stratified_sample(train, target, max_rows, row_id) if is_classification else row_cap(train, max_rows, row_id)
    return train


# --- samples, splits, folds --------------------------------------------------------------------------------------------


def row_digest(row_id: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in row_id], F.lit(str(seed))))


def digest_rank(df: DataFrame, row_id: Sequence[str], seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Rank (from 0) of every row in digest order within ``by`` and the size of the class; rows of a null class are left out."""
    ranked = rank_by_digest(df, F.unhex(row_digest(row_id, seed)), by, row_id)
    return ranked.select(*df.columns, "_rank", "_size")


def rank_by_digest(df: DataFrame, digest: Column, by: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``_rank`` (from 0) in the order of a binary digest within ``by``, and ``_size``, the rows of the class.

    Rows are shuffled once, by class and slice of the digest. Counts per slice say what lies before a slice and how large its
    class is; they come back on the partitioning that the ranks already have, so no class meets in one task.
    """
    known = df.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in by])) if by else df
    keyed = prefix.hash_slice(known.withColumn("_digest", digest), F.hex("_digest"))
    names = prefix.same_key(by)
    keyed = keyed.select("*", *names)
    keys = [f"_key{i}" for i in range(len(names))]
    place = [*keys, prefix.SLICE]
    counts = keyed.groupBy(*place).agg(F.count(F.lit(1)).alias("_in_slice"))
    whole = Window.partitionBy(*keys)
    upto = F.sum("_in_slice").over(whole.orderBy(prefix.SLICE).rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.select(*place, (upto - F.col("_in_slice")).alias("_before"), F.sum("_in_slice").over(whole).alias("_size"))
    nth = F.row_number().over(Window.partitionBy(*place).orderBy("_digest", *[F.col(c) for c in ties]))
    ranked = keyed.withColumn("_nth", nth).join(counts, place)
    return ranked.select(*df.columns, (F.col("_before") + F.col("_nth") - 1).alias("_rank"), "_size")


def stratified_sample(df: DataFrame, target: str, n: int, row_id: Sequence[str], seed: int = ROW_CAP_SEED) -> DataFrame:
    """About ``n`` rows with the class shares kept: the first rows of every class in digest order; all if fewer."""
    total = df.agg(F.count(F.lit(1))).scalar()
    ranked = digest_rank(df, row_id, seed, [target])
    keep = (total <= n) | (F.col("_rank") < F.round(F.col("_size") * F.lit(n) / total))
    return ranked.filter(keep).select(*df.columns)


def row_cap(df: DataFrame, n: int, row_id: Sequence[str], seed: int = ROW_CAP_SEED) -> DataFrame:
    """``n`` rows in digest order (a top-n: every task keeps its own first n)."""
    return df.orderBy(row_digest(row_id, seed), *[F.col(c) for c in row_id]).limit(n)


def _synthetic(df: DataFrame) -> Column:
    return ~F.coalesce(F.col(ORIGIN), F.lit(False)) if ORIGIN in df.columns else F.lit(True)


def split(df: DataFrame, target: str, is_classification: bool, share: float, seed: int, row_id: Sequence[str], flag: str) -> DataFrame:
    """Mark ``share`` of the rows (per class) as held out; original rows never are.

    Original rows get ranks among themselves, so the held-out share refers to the synthetic rows.
    """
    marked = df.withColumn("_syn", _synthetic(df))
    by = ["_syn", target] if is_classification else ["_syn"]
    ranked = digest_rank(marked, row_id, seed, by)
    held = F.col("_syn") & (F.col("_rank") < F.round(F.col("_size") * share))
    return ranked.withColumn(flag, held).select(*df.columns, flag)


def audit_split(df: DataFrame, target: str, is_classification: bool, row_id: Sequence[str], frac: float = 0.1) -> DataFrame:
    return split(df, target, is_classification, frac, AUDIT_SEED, row_id, "is_holdout")


def inner_split(df: DataFrame, target: str, is_classification: bool, row_id: Sequence[str], seed: int) -> DataFrame:
    return split(df, target, is_classification, PRESELECT_SHARE, seed, row_id, "is_valid")


def assign_folds(df: DataFrame, target: str, k: int, seed: int, is_classification: bool, row_id: Sequence[str]) -> DataFrame:
    """Validation fold of every row (0 to k - 1), classes spread evenly; -1 for original rows, which only train."""
    marked = df.withColumn("_syn", _synthetic(df))
    by = ["_syn", target] if is_classification else ["_syn"]
    ranked = digest_rank(marked, row_id, seed, by)
    fold = F.when(F.col("_syn"), F.col("_rank") % k).otherwise(F.lit(-1))
    return ranked.withColumn("fold", fold.cast("int")).select(*df.columns, "fold")


# --- features --------------------------------------------------------------------------------------------------------


def group_stats(train: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, deviation and count of a category learnt on train, next to every row."""
    stats = train.groupBy(key).agg(
        F.avg(value).alias(f"{value}_mean"), F.stddev_samp(value).alias(f"{value}_std"), F.count(F.lit(1)).alias(f"{key}_count")
    )
    return other.join(stats, key, "left")


def union_features(base: DataFrame, patch: DataFrame, row_id: str) -> DataFrame:
    """Two feature sets side by side; on equal names the second one counts."""
    own = [c for c in base.columns if c == row_id or c not in patch.columns]
    return base.select(*own).join(patch, row_id)


def union_candidates(first: DataFrame, second: DataFrame, value: str, position: str) -> DataFrame:
    """Candidates of both lists without repeats: the first list leads, order within a list is kept."""
    both = first.withColumn("_list", F.lit(0)).unionByName(second.withColumn("_list", F.lit(1)))
    return both.groupBy(value).agg(F.min(F.struct("_list", position)).alias("_at")).select(value, F.col("_at._list").alias("source_list"), F.col(f"_at.{position}").alias(position))


def target_encode(df: DataFrame, key: str, target: str, smooth: float, fold: str = "fold") -> DataFrame:
    """Out-of-fold smoothed category means: the totals of a category minus those of the row's own fold.

    Categories unseen outside the fold get the mean of the other folds. Sums per (category, fold) are the only
    thing that is shuffled.
    """
    cell = df.groupBy(key, fold).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    per_key = cell.groupBy(key).agg(F.sum("_s").alias("_ks"), F.sum("_n").alias("_kn"))
    per_fold = cell.groupBy(fold).agg(F.sum("_s").alias("_fs"), F.sum("_n").alias("_fn"))
    all_s, all_n = per_fold.agg(F.sum("_fs")).scalar(), per_fold.agg(F.sum("_fn")).scalar()
    table = cell.join(per_key, key).join(per_fold, fold)
    prior = (all_s - F.col("_fs")) / (all_n - F.col("_fn"))
    s, n = F.col("_ks") - F.col("_s"), F.col("_kn") - F.col("_n")
    code = F.when(n > 0, (s + prior * smooth) / (n + smooth)).otherwise(prior)
    return df.join(table.select(key, fold, code.alias(f"{key}_encoded")), [key, fold], "left")


def feature_recipes(df: DataFrame, ratio: tuple[str, str], digits_of: str, date: str) -> DataFrame:
    """Common derived features: a guarded ratio, single digits of a number, parts of a date."""
    a, b = ratio
    whole = F.floor(F.abs(F.col(digits_of)))
    return df.withColumns({
        f"{a}_per_{b}": F.try_divide(F.col(a), F.col(b) + 1e-9),
        **{f"{digits_of}_digit{i}": (F.floor(whole / 10**i) % 10).cast("int") for i in range(3)},
        f"{date}_year": F.year(date), f"{date}_month": F.month(date), f"{date}_weekday": F.weekday(date),
    })
