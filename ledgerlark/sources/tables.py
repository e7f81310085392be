"""Table maintenance over plain Parquet: every operation returns the new table as a DataFrame.

Keys with many updates stay cheap: the update side is reduced to its newest row per key (a partial aggregation)
before it meets the base.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def append_rows(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Add rows that carry any subset of the base columns."""
    known = [c for c in rows.columns if c in base.columns]
    return base.unionByName(rows.select(*known), allowMissingColumns=True)


def newest_by_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*rows.columns)


def insert_if_absent(base: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Insert new keys only; of several new rows with one key the first in ``order`` is taken."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")
    return append_rows(base, first.join(base.select(*keys), list(keys), "left_anti"))


def upsert(
    base: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Insert or replace by key, newest update first; columns in ``keep`` hold on to an existing value.

    Columns the update does not carry keep the base value.
    """
    new = newest_by_key(rows, keys, order)
    carried = [c for c in base.columns if c in new.columns and c not in keys]
    update = new.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in carried])
    joined = base.withColumn("_have", F.lit(True)).join(update, list(keys), "full_outer")

    def pick(c: str) -> Column:
        if c in keys or c not in carried:
            return F.col(c)
        if c in keep:
            return F.coalesce(F.col(c), F.col(f"_new_{c}")).alias(c)
        return F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*[pick(c) for c in base.columns])


def update_where(df: DataFrame, condition: Column, values: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Conditional update; returns the new table and the changed rows."""
    hit = F.coalesce(condition, F.lit(False))
    updated = df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])
    changed = df.filter(hit).withColumns(dict(values))
    return updated, changed.select(*df.columns)


def fill_by_prefix(df: DataFrame, key: str, prefix: str, col: str, value: Column) -> DataFrame:
    """Fill a null column where the key starts with a prefix."""
    return df.withColumn(col, F.when(F.col(col).isNull() & F.col(key).startswith(prefix), value).otherwise(F.col(col)))


def ttl(df: DataFrame, ts: str, interval: str, now: Column) -> DataFrame:
    """Rows younger than the interval."""
    return df.filter(F.col(ts) > now - F.expr(f"INTERVAL {interval}"))


def delete_keys(tables: Mapping[str, DataFrame], keys: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given keys."""
    return {name: df.join(keys, keys.columns, "left_anti") for name, df in tables.items()}
