"""Counter-based draws: their distribution, repeatability and the absence of a Python worker."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import draws
from ledgerlark.plans import fleet

N = 20_000


def beta_cdf(x, a, b):
    """The regularised incomplete beta function by its density on a fine grid in the log odds, where it has no poles."""
    t = np.linspace(-60 / min(a, b, 1), 60 / min(a, b, 1), 400_001)
    log_p, log_q = -np.logaddexp(0, -t), -np.logaddexp(0, t)
    density = np.exp(a * log_p + b * log_q - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b))
    total = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2 * (t[1] - t[0]))])
    x = np.clip(x, 1e-300, 1 - 1e-16)
    return np.interp(np.log(x) - np.log1p(-x), t, total)


def kolmogorov(sample, cdf):
    """Largest distance of the sample from its distribution, in units of its deviation: above 1.95 in one case of a thousand."""
    at = cdf(np.sort(sample))
    n = len(sample)
    return math.sqrt(n) * max(np.max(np.arange(1, n + 1) / n - at), np.max(at - np.arange(n) / n))


@pytest.mark.parametrize("alpha,beta", [(1.0, 1.0), (3.5, 9.0), (120.0, 2.0), (0.4, 0.7), (0.05, 2.0), (4000.0, 5000.0)])
def test_beta_draws_follow_the_distribution(spark, alpha, beta):
    rows = spark.range(N).select(draws.beta_draw(F.lit(alpha), F.lit(beta), F.lit(7), F.col("id")).alias("p"))
    got = np.array([r.p for r in rows.collect()])
    assert got.min() >= 0 and got.max() <= 1
    assert kolmogorov(got, lambda x: beta_cdf(x, alpha, beta)) < 1.95


def test_uniforms_are_even_and_unrelated(spark):
    got = np.array([r.u for r in spark.range(N).select(draws.uniforms(F.lit(1), F.col("id")).alias("u")).collect()])
    assert got.shape == (N, 4) and 0 < got.min() and got.max() < 1
    assert all(kolmogorov(got[:, i], lambda x: x) < 1.95 for i in range(4))
    assert np.abs(np.corrcoef(got.T) - np.eye(4)).max() < 4 / math.sqrt(N)


def test_draws_repeat_and_nulls_are_defined(spark):
    rows = spark.createDataFrame([("a", 2.0, 3.0), ("b", 2.0, 3.0), (None, 2.0, 3.0), ("a", None, 3.0)], "k string, alpha double, beta double")
    p = draws.beta_draw(F.col("alpha"), F.col("beta"), F.lit(1), F.col("k")).alias("p")
    one, two = ([r.p for r in rows.repartition(n).select("k", "alpha", p).orderBy("alpha", "k").collect()] for n in (1, 3))
    assert one == two and one[0] is None and len(set(one[1:])) == 3


def test_no_python_worker(spark):
    bandit = spark.createDataFrame([("k", "ensemble", 90.0, 10.0, "local")], "scope_key string, action_type string, alpha double, beta double, scope string")
    comps = spark.createDataFrame([("k",)], "competition_id string")
    for df in (fleet.action_prior(bandit, comps, 1), fleet.assign_actions(bandit, comps, comps, 3, 1)):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
