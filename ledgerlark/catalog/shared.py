"""Small helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import round_half
from .roles import NOW_EVENTS, NOW_ORDERS, NOW_TUNES


def r(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, so results do not depend on the order of floating sums."""
    return df.select(*[round_half(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def at(ts: str) -> Column:
    return F.lit(ts).cast("timestamp_ntz")


EVENTS_NOW, ORDERS_NOW, TUNES_NOW = NOW_EVENTS, NOW_ORDERS, NOW_TUNES
