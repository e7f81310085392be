"""Registered queries over the driver's tables and the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the role tables under a name, with the SQL that must give the same rows."""

    def wrap(fn: Callable[[roles.Roles], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(roles.Roles(spark, sf_dir))

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = roles.with_roles(sql)
        return fn

    return wrap


MODULES = (
    "views",
    "aggregates",
    "joins",
    "listings",
    "scalars",
    "sources",
    "training",
    "metrics",
    "evaluation",
    "retrieval",
    "decisions",
    "streams",
)


def load() -> None:
    """Import the modules that register queries."""
    from importlib import import_module

    for name in MODULES:
        import_module(f"{__name__}.{name}")
