"""Column rules: labels, gains, significance, refresh and status decisions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as K
from . import arrays


def round_half(value: Column, digits: int) -> Column:
    """Round half away from zero as decimals do: binary noise beyond twelve places is dropped first."""
    return F.round(F.round(value, 12), digits)


def noise_tolerance(score: Column) -> Column:
    return F.greatest(F.lit(K.NOISE_ABS), F.lit(K.NOISE_REL) * F.abs(score))


def is_not_false(flag: Column) -> Column:
    """True and unknown count, only an explicit false does not."""
    return F.coalesce(flag, F.lit(True))


def behaviour_key(cv: Column, folds: Column) -> Column:
    """Digest of a score and its folds rounded to nine places; equal computations share it."""
    parts = F.transform(F.coalesce(folds, F.expr("CAST(array() AS array<double>)")), lambda x: F.format_number(x, 9))
    return F.sha2(F.concat_ws("|", F.format_number(cv, 9), F.array_join(parts, ",")), 256)


def lesson_type(label: Column, error: Column) -> Column:
    return (
        F.when(error != "", "failure").when(label == "jump", "recommend")
        .when(label == "regression", "avoid").otherwise("no_op")
    )


def traffic_light(green: Column, red: Column) -> Column:
    return F.when(red, "red").when(green, "green").otherwise("amber")


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)


def refresh_due(submitted: Column, checked: Column, now: Column) -> Column:
    """Back-off: the older a submission, the longer the wait between two looks at it."""
    age = seconds_between(submitted, now)
    wait = F.when(age < 600, 120).when(age < 3600, 600).when(age < 6 * 3600, 1800).otherwise(7200)
    return checked.isNull() | (seconds_between(checked, now) >= wait)


def submission_state(status: Column, seen: Column, submitted: Column, now: Column) -> Column:
    """Next stored status from the listing state; final ones stay, unseen ones turn unknown after a day."""
    final = status.isin("complete", "error", "invalid")
    stale = (seen == "not_found") & (seconds_between(submitted, now) >= 24 * 3600)
    return (
        F.when(final, status).when(stale, "unknown")
        .when(seen.isin("not_found", "pending"), status).otherwise(seen)
    )


def bandit_deltas(label: Column, gain: Column, error: Column, noop: Column) -> Column:
    """(alpha, beta) increments of one outcome."""
    def pair(a: float, b: float) -> Column:
        return F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta"))

    return (
        F.when(error.isNotNull() | (label == "regression"), pair(0.0, 1.0))
        .when(noop, pair(0.0, 1.0))
        .when(label == "jump", pair(1.0, 0.0))
        .when(gain > 0, pair(0.5, 0.1))
        .otherwise(pair(0.1, 0.1))
    )


def is_dead_action(alpha: Column, beta: Column) -> Column:
    return (alpha + beta - 2.0 >= K.DEAD_MIN_OBSERVED) & (alpha / (alpha + beta) < K.DEAD_MEAN)


def is_significant(candidate: Column, baseline: Column, gain: Column, fold_var: Column, sign: Column) -> Column:
    """Paired t over folds above z; equal deltas decide by their mean; without pairs gain against z fold deviations."""
    paired = (F.size(candidate) == F.size(baseline)) & (F.size(candidate) >= 2)
    deltas = F.zip_with(candidate, baseline, lambda c, b: sign * (c - b))
    m, s = arrays.mean(deltas), arrays.std_sample(deltas)
    by_folds = F.when(s == 0, m > 0).otherwise(F.try_divide(m, s / F.sqrt(F.size(deltas))) > K.SIGNIFICANCE_Z)
    by_gain = F.coalesce(gain > K.SIGNIFICANCE_Z * F.sqrt(fold_var), F.lit(False))
    return F.when(F.coalesce(paired, F.lit(False)), by_folds).otherwise(by_gain)


def label_gain(
    cv: Column, fold_std: Column, sign: Column, metric_class: Column, best: Column, baseline_cv: Column
) -> Column:
    """Label, gain, relative gain and tie flag of a score against the best one so far."""
    delta = sign * (cv - best)
    usable = F.coalesce(baseline_cv > 0, F.lit(False))
    floor = sign * (baseline_cv * K.IMPLAUSIBLE_BASELINE_RATIO - best)
    gain = F.when(usable, F.greatest(delta, floor)).otherwise(delta)
    relative = F.when((metric_class == "regression_error") & usable, gain / baseline_cv).otherwise(gain)
    label = (
        F.when(delta > K.SIGNIFICANCE_Z * fold_std, "jump")
        .when(delta < -K.SIGNIFICANCE_Z * fold_std, "regression").otherwise("neutral")
    )
    tie = F.coalesce(F.abs(cv - best) <= noise_tolerance(best), F.lit(False))
    return F.struct(label.alias("label"), gain.alias("gain"), relative.alias("relative"), tie.alias("noop_tie"))


def leak_verdict(cv: Column, sign: Column, metric_class: Column, baseline_cv: Column) -> Column:
    """Why a score is too good to be true; null where it is not."""
    perfect = F.when(sign > 0, cv >= K.LEAK_PERFECT_HIGH).otherwise(cv <= K.LEAK_PERFECT_LOW)
    scale = (metric_class == "regression_error") & (sign < 0) & (cv > 0) & (baseline_cv / cv > K.LEAK_BASELINE_RATIO)
    return F.when(perfect, "perfect").when(scale, "scale")


def futility(fold1: Column, base_folds: Column, sign: Column, metric_class: Column, audit_key: Column) -> Column:
    """stop / audit / run after the first fold; a tenth of the stops, chosen by digest, runs on as audit."""
    worse = sign * (fold1 - F.get(base_folds, F.lit(0))) < -K.FUTILITY_STD * arrays.std_pop(base_folds)
    stop = F.coalesce(worse & (metric_class != "regression_error"), F.lit(False))
    return F.when(~stop, "run").when(audit_draw(audit_key) < K.FUTILITY_AUDIT_SHARE, "audit").otherwise("stop")


def audit_draw(key: Column) -> Column:
    """A repeatable number in [0, 1) from a key."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
