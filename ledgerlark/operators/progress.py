"""Cost projections from progress logs (one line per finished step of a run)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: the shape of a progress line.
LINE = r"stage=(\w+)(?: (?:fold|cand)=(\d+)/(\d+))? cpu=(\d+)"


def parse(lines: DataFrame, line: str) -> DataFrame:
    """Stage, step, number of steps and CPU seconds of every progress line; other lines are dropped."""
    def part(i: int) -> Column:
        return F.regexp_extract(line, LINE, i)

    rows = lines.filter(F.col(line).rlike(LINE))
    return rows.withColumns({
        "stage": part(1), "step": part(2).try_cast("int"), "steps": part(3).try_cast("int"), "cpu": part(4).cast("double"),
    })


def _after(run: str, order: str, parsed: DataFrame, start: str) -> DataFrame:
    """Lines from the last start line of every run on (found by aggregation, no ordered pass)."""
    begin = parsed.filter(F.col("stage") == start).groupBy(run).agg(F.max(order).alias("_begin"), F.max_by("cpu", order).alias("_start_cpu"), F.max_by("steps", order).alias("_steps"))
    return parsed.join(begin, run).filter(F.col(order) >= F.col("_begin"))


def project_cpu(lines: DataFrame, now: DataFrame, run: str, order: str, line: str, n_folds: int) -> DataFrame:
    """Projected CPU of runs inside cross-validation and the fold they are in.

    The remaining folds cost the mean of the finished ones or the time of the running one, whichever is more.
    Runs that finished all folds, or reported the end of cross-validation, have no projection.
    """
    parsed = parse(lines, line)
    ended = parsed.filter("stage = 'cv_done'").select(run)
    inside = _after(run, order, parsed.join(ended, run, "left_anti"), "preselect_done")
    done = F.col("stage") == "fold_done"
    state = inside.groupBy(run).agg(
        F.count_if(done).alias("_done"), F.max_by("cpu", F.when(done, F.col(order))).alias("_last"), F.first("_start_cpu").alias("_start")
    ).join(now, run)
    last = F.coalesce("_last", "_start")
    average = F.when(F.col("_done") > 0, (last - F.col("_start")) / F.col("_done")).otherwise(0.0)
    per_fold = F.greatest(F.col("cpu_now") - last, average)
    return state.filter(F.col("_done") < n_folds).select(
        run, (F.col("_done") + 1).alias("fold"), (last + (F.lit(n_folds) - F.col("_done")) * per_fold).alias("projected")
    )


def project_preselect(lines: DataFrame, now: DataFrame, run: str, order: str, line: str) -> DataFrame:
    """The same for runs that still score candidates: the running one costs at least the mean, each waiting one the mean.

    Before the first one is done the CPU so far is the bound."""
    parsed = parse(lines, line)
    ended = parsed.filter("stage IN ('preselect_done', 'cv_done')").select(run)
    inside = _after(run, order, parsed.join(ended, run, "left_anti"), "preselect_start")
    fit = F.col("stage") == "preselect_fit"
    state = inside.groupBy(run).agg(
        F.coalesce(F.max_by("step", F.when(fit, F.col(order))), F.lit(0)).alias("_done"), F.max_by("cpu", F.when(fit, F.col(order))).alias("_last"),
        F.first("_start_cpu").alias("_start"), F.first("_steps").alias("candidates"),
    ).join(now, run).filter(F.col("_done") < F.col("candidates"))
    average = F.try_divide(F.col("_last") - F.col("_start"), F.col("_done"))
    running = F.greatest(average, F.col("cpu_now") - F.col("_last"))
    waiting = (F.col("candidates") - F.col("_done") - 1) * average
    projected = F.when(F.col("_done") == 0, F.col("cpu_now")).otherwise(F.col("_last") + running + waiting)
    return state.select(run, (F.col("_done") + 1).cast("long").alias("candidate"), "candidates", projected.alias("projected"))
