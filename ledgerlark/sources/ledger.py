"""Typed access to a ledger directory (one Parquet folder per table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .schemas import TABLES


def resolve_path(root: str | None, name: str, local_root: str = ".") -> str:
    """The object-store root if one is configured, else the local one; Spark picks the file system by scheme."""
    return f"{(root or local_root).rstrip('/')}/{name}"


class Ledger:
    """Lazy scans of the ledger tables with their declared schemas; missing columns read as null."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(resolve_path(self.root, name))

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    def register(self) -> None:
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)


def decode_json(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Parse JSON text columns into the given DDL types."""
    return df.withColumns({c: F.from_json(c, ddl) for c, ddl in spec.items()})


def finite_or_null(scores: Column) -> Column:
    """Array of numbers with NaN and infinities as null, which JSON can hold."""
    inf = F.lit(float("inf"))
    return F.transform(scores, lambda x: F.when(~F.isnan(x) & (F.abs(x) < inf), x))


def to_json_numbers(scores: Column) -> Column:
    return F.to_json(finite_or_null(scores), {"ignoreNullFields": "false"})
