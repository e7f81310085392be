"""Decision tables."""

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import arrays, rules, text
from ledgerlark.streaming.jobs import gate_reason


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("trace,want", [
    ("Traceback\n  File \"a.py\", line 3\nValueError: could not convert 'abc' at 12", "ValueError: could not convert <val> at <val>"),
    ("x\npkg.mod.CatError: bad 1.5 in /tmp/a.py", "CatError: bad <val> in <val>"),
    ("_catboost.CatBoostError: depth 17", "CatBoostError: depth <val>"),
    ("KeyError: 1\n  File \"x\"\nSyntaxError: bad", None),
    ("runner exited without output.json (rc=-9)", "runner exited without output.json (rc=-9)"),
    ("cpu budget exceeded: 3600s\n[last_progress] stage=fold_done fold=2/5 cpu=9", "cpu budget exceeded: 3600s"),
    ("  \n\n", None),
    ("plain   guard 42 text", "plain guard <val> text"),
])
def test_error_signature(spark, trace, want):
    assert one(spark, text.error_signature(F.lit(trace))) == want


def test_kill_stage_and_code_facts(spark):
    k = one(spark, text.kill_stage(F.lit("a\n[last_progress] stage=fold_done fold=2/5 cpu=7")))
    assert (k.stage, k.fold) == ("fold_done", "fold=2/5")
    f = one(spark, text.code_facts(F.lit("XGBClassifier(); x.alias('a'); y.alias(\"b\"); z.alias('a'); LogisticRegression(class_weight=1)")))
    assert (f.models, f.columns, f.weighting) == (["XGBClassifier", "LogisticRegression"], ["a", "b"], ["class_weight"])


@pytest.mark.parametrize("alpha,beta,dead", [(1.0, 1.0, False), (1.0, 6.0, False), (1.0, 10.0, True), (1.2, 20.0, True), (3.0, 10.0, False)])
def test_dead_action(spark, alpha, beta, dead):
    assert one(spark, rules.is_dead_action(F.lit(alpha), F.lit(beta))) is dead


@pytest.mark.parametrize("success,done,span,waited,want", [
    (2, 2, 10.0, 10.0, "quorum"), (0, 3, 10.0, 10.0, "all_done"), (1, 1, 900.0, 950.0, "grace"), (1, 1, 899.0, 950.0, None),
    (0, 0, None, 3000.0, "maxwait"), (0, 2, None, 100.0, None), (1, 2, 100.0, 200.0, None),
])
def test_gate(spark, success, done, span, waited, want):
    cols = [F.lit(success), F.lit(done), F.lit(span).cast("double"), F.lit(waited)]
    assert one(spark, gate_reason(*cols)) == want


def _sig(spark, cand, base, gain=None, var=None, sign=1):
    a = lambda v: F.lit(v).cast("array<double>") if v is None else F.array(*[F.lit(float(x)) for x in v])
    d = lambda v: F.lit(v).cast("double")
    return one(spark, rules.is_significant(a(cand), a(base), d(gain), d(var), F.lit(sign)))


def test_significance(spark):
    assert _sig(spark, [1, 2, 3], [0, 1, 2]) is True  # equal positive deltas
    assert _sig(spark, [1, 2, 3], [1, 2, 3]) is False
    assert _sig(spark, [1.0, 1.1, 1.2], [0.9, 1.0, 1.15]) is True
    assert _sig(spark, [1.0, 0.8, 1.2], [0.9, 1.0, 1.15]) is False
    assert _sig(spark, [1, 2, 3], [2, 3, 4], sign=-1) is True
    assert _sig(spark, [1], [0], gain=3.0, var=1.0) is True  # too few folds: absolute rule
    assert _sig(spark, None, None, gain=1.9, var=1.0) is False
    assert _sig(spark, [1, 2], [1, 2, 3], gain=None, var=1.0) is False


@pytest.mark.parametrize("cv,best,sign,want", [(1.0, 0.5, 1, ("jump", 0.5, False)), (0.5, 1.0, 1, ("regression", -0.5, False)), (0.5, 0.5 + 1e-8, 1, ("neutral", -1e-8, True)), (0.5, 1.0, -1, ("jump", 0.5, False))])
def test_label_gain(spark, cv, best, sign, want):
    g = one(spark, rules.label_gain(F.lit(cv), F.lit(0.1), F.lit(sign), F.lit("classification"), F.lit(best), F.lit(None).cast("double")))
    assert g.label == want[0] and g.gain == pytest.approx(want[1]) and g.noop_tie is want[2]


def test_gain_floor_and_relative(spark):
    g = one(spark, rules.label_gain(F.lit(500.0), F.lit(0.1), F.lit(-1), F.lit("regression_error"), F.lit(5.0), F.lit(10.0)))
    assert g.gain == pytest.approx(-95.0) and g.relative == pytest.approx(-9.5) and g.label == "regression"


def test_bandit_deltas_priorities(spark):
    def d(label, gain, error, noop):
        s = one(spark, rules.bandit_deltas(F.lit(label), F.lit(gain).cast("double"), F.lit(error).cast("string"), F.lit(noop)))
        return s.alpha, s.beta

    assert d("jump", 1.0, "boom", False) == (0.0, 1.0)
    assert d("neutral", 0.0, None, True) == (0.0, 1.0)
    assert d("jump", 1.0, None, False) == (1.0, 0.0)
    assert d("neutral", 0.2, None, False) == (0.5, 0.1)
    assert d("neutral", None, None, False) == (0.1, 0.1)


def test_array_statistics(spark):
    a = F.array(*[F.lit(x) for x in (1.0, 2.0, 4.0)])
    assert one(spark, arrays.variance(a)) == pytest.approx(14 / 9)
    assert one(spark, arrays.standard_error(a)) == pytest.approx((7 / 3) ** 0.5 / 3**0.5)
    assert one(spark, arrays.standard_error(F.array(F.lit(1.0)))) == 0.0
    assert one(spark, arrays.norm(arrays.fit_dim(F.array(F.lit(3.0), F.lit(4.0), F.lit(9.0)), 2))) == pytest.approx(1.0, abs=1e-6)
