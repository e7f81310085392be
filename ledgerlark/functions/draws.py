"""Counter-based random draws in column expressions.

A draw is a function of its counter (seed, keys, number of the draw) alone: no generator has a state, so a task that runs
again draws the same, rows may come in any order, and any engine with SHA-256 can repeat the draws.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F

HEX = 13  # hexadecimal digits of a uniform: 52 bits, so that adding a half is exact in a double
TRIES = 24  # a try is rejected with a probability below 0.05, all of them with one below 1e-31


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; the body is a double."""
    return F.aggregate(F.array(value), F.lit(None).cast("double"), lambda _, x: body(x))


def uniforms(*counter: Column) -> Column:
    """Four numbers strictly between 0 and 1. Nulls in the counter count as empty texts."""
    digest = F.sha2(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in counter]), 256)
    number = lambda i: F.conv(F.substr(digest, F.lit(i * HEX + 1), F.lit(HEX)), 16, 10).cast("bigint").cast("double")
    return F.array(*[(number(i) + 0.5) / float(16 ** HEX) for i in range(4)])


def _normal(u: Column) -> Column:
    return F.sqrt(-2.0 * F.log(u[0])) * F.cos(2.0 * math.pi * u[1])


def log_gamma_draw(shape: Column, *counter: Column) -> Column:
    """Logarithm of a draw from the gamma distribution of a positive shape, by rejection from a cubed normal.

    A shape below 1 is raised by one, and the draw multiplied by a uniform to the power of 1 / shape. Logarithms keep the
    draws of tiny shapes apart from zero. Null shapes give null.
    """
    d = F.when(shape < 1, shape + 1).otherwise(shape) - 1 / 3
    scale = 1 / F.sqrt(9 * d)

    def attempt(u: Column) -> Column:
        def cubed(x: Column) -> Column:
            return _let(F.pow(1 + scale * x, F.lit(3.0)), lambda v: F.when((v > 0) & (F.log(u[2]) < x * x / 2 + d - d * v + d * F.log(v)), F.log(d * v)))

        return _let(_normal(u), cubed)

    found = F.aggregate(
        F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(None).cast("double"),
        lambda got, i: F.when(got.isNotNull(), got).otherwise(_let(uniforms(*counter, i), attempt)),
    )
    found = F.coalesce(found, F.when(shape.isNotNull(), F.log(d)))
    return F.when(shape < 1, found + F.log(uniforms(*counter, F.lit(-1))[0]) / shape).otherwise(found)


def beta_draw(alpha: Column, beta: Column, *counter: Column) -> Column:
    """A draw from the beta distribution: the share of the first of two gamma draws."""
    gap = log_gamma_draw(beta, *counter, F.lit("b")) - log_gamma_draw(alpha, *counter, F.lit("a"))
    return 1 / (1 + F.exp(gap))
