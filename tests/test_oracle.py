"""Every registered query with SQL gives the rows of that SQL."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]).startswith("ok"), name


ORDERED = ["win_score_progression", "win_cv_lb_calibration", "win_bandit_replay", "agg_snr", "agg_percentile_in", "join_asof_prev", "ml_auc", "flt_submittable", "ml_behaviour_drift"]


@pytest.mark.parametrize("name", ORDERED)
def test_hot_keys_do_not_change_results(spark, hot, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]).startswith("ok"), name


def test_names_and_schema(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "best_so_far" in entry.entry(spark).columns
