"""Structured Streaming jobs over an append-only feed of attempts or submissions.

* Windows, sessions and duplicate removal are built-in operators with a watermark, written in append mode.
* Keyed tables behind a stream are change logs: a micro-batch appends its rows and rewrites nothing.
* Order-dependent rules are keyed state; see ``keyed``. The gate's rules are here as columns too, for tables.

The stream's event time must be TIMESTAMP; rows later than the watermark are dropped by the windowed jobs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules
from ..operators import prefix
from ..sources import tables
from ..sources.changelog import BUCKET, ChangeLog


def run_append(stream: DataFrame, path: str) -> DataFrame:
    """Process all available input of an append-mode stream into Parquet and return the written rows."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start(f"{path}/rows")
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


# --- windows -----------------------------------------------------------------------------------------------------------


def stream_activity(attempts: DataFrame, delay: str = "1 hour", window: str = "14 days", slide: str = "1 day") -> DataFrame:
    """Attempts, jumps and errors per competition in sliding windows."""
    per = attempts.withWatermark("run_ts", delay).groupBy(F.window("run_ts", window, slide), "competition_id")
    counts = per.agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("label") == "jump").alias("jumps"), F.count_if(F.col("label") == "error").alias("errors")
    )
    return counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "competition_id", "attempts", "jumps", "errors")


def stream_pacing(attempts: DataFrame, limits: dict[str, int], delay: str = "1 hour") -> DataFrame:
    """Attempts per tumbling window of each length, with a flag where the limit of that length is reached."""
    out = None
    for length, limit in limits.items():
        counts = attempts.withWatermark("run_ts", delay).groupBy(F.window("run_ts", length)).agg(F.count(F.lit(1)).alias("attempts"))
        part = counts.select(F.lit(length).alias("length"), F.col("window.start").alias("window_start"), "attempts", (F.col("attempts") >= limit).alias("over"))
        out = part if out is None else out.unionByName(part)
    return out


def stream_idle(attempts: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Closed activity sessions per competition; a session ends when nothing ran for the gap."""
    per = attempts.withWatermark("run_ts", delay).groupBy(F.session_window("run_ts", gap), "competition_id")
    return per.agg(F.count(F.lit(1)).alias("attempts")).select(
        "competition_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("idle_since"), "attempts"
    )


def stream_dedup(attempts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First attempt per behaviour key; repeats within the watermark are dropped, older ones by ``first_of_keys``."""
    keyed = attempts.withColumn("behaviour", rules.behaviour_key(F.col("cv_score"), F.col("fold_scores")))
    return keyed.withWatermark("run_ts", delay).dropDuplicatesWithinWatermark(["competition_id", "behaviour"]).select("competition_id", "behaviour")


# --- tables behind a stream ------------------------------------------------------------------------------------------------


def first_of_keys(stream: DataFrame, log: ChangeLog, path: str) -> DataFrame:
    """Keys of a stream that never came before, each once, for good.

    The stream has dropped what its watermark remembers; what is left meets the history of all keys, read from the buckets
    that the micro-batch touches. A repeated micro-batch looks at earlier versions only and replaces its own rows.
    """

    def process(batch: DataFrame, epoch: int) -> None:
        keys = batch.select(*log.columns).dropDuplicates(log.keys).persist()
        log.append(log.absent(keys, epoch), epoch)
        keys.unpersist()

    _for_each_batch(stream, process, path)
    return log.changes().drop(BUCKET)


def upsert_stream(stream: DataFrame, log: ChangeLog, path: str, compact_every: int = 0) -> DataFrame:
    """Appends every micro-batch, newest row per key, to the change log and returns the merged table."""

    def process(batch: DataFrame, epoch: int) -> None:
        log.append(tables.newest_by_key(batch.select(*log.columns), log.keys, log.order), epoch)
        if compact_every and (epoch + 1) % compact_every == 0:
            log.compact()

    _for_each_batch(stream, process, path)
    return log.table()


def _for_each_batch(stream: DataFrame, process: Callable[[DataFrame, int], None], path: str) -> None:
    query = stream.writeStream.foreachBatch(process).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


# --- gate ----------------------------------------------------------------------------------------------------------------


def gate_reason(
    n_success: Column, n_done: Column, span_sec: Column, waited_sec: Column, *, expected: int = 3, min_done: int = 2, grace_sec: float = 900.0, max_wait_sec: float = 3000.0
) -> Column:
    """Why a super cycle may be judged now; null while it has to wait."""
    return (
        F.when(n_success >= min_done, "quorum").when(n_done >= expected, "all_done")
        .when((n_done >= 1) & (span_sec >= grace_sec), "grace").when(waited_sec >= max_wait_sec, "maxwait")
    )


def gate_facts(attempts: DataFrame, expected: int) -> DataFrame:
    """What a gate depends on, per super cycle: first row, first full result, last row, first ``expected`` results.

    Later results cannot change the outcome, so every map task hands on at most ``expected`` rows per super cycle.
    """
    full = ~F.coalesce("futility_early_exit", F.lit(False))
    times = attempts.groupBy("super_cycle_id").agg(
        F.min("run_ts").alias("start"), F.min(F.when(full, F.col("run_ts"))).alias("first_full"), F.max("run_ts").alias("last_seen")
    )
    results = attempts.filter("cv_score IS NOT NULL OR error_trace IS NOT NULL").select(
        "super_cycle_id", "run_ts", "attempt_id", (F.col("cv_score").isNotNull() & full).alias("ok")
    )
    first = prefix.newest_per_key(results, ["super_cycle_id"], [F.col("run_ts"), F.col("attempt_id")], expected)
    entry = F.struct(F.col("run_ts").alias("at"), F.col("attempt_id").alias("id"), "ok")
    return times.join(first.groupBy("super_cycle_id").agg(F.sort_array(F.collect_list(entry)).alias("results")), "super_cycle_id", "left")


def gate_events(facts: DataFrame, mark: Column, *, expected: int, min_done: int, grace_sec: int, max_wait_sec: int) -> DataFrame:
    """When and why each gate fires; no row while the deciding instant has not been passed by the data yet."""
    results = F.col("results")
    wins = F.filter(results, lambda e: e["ok"])

    def after(ts: Column, seconds: int) -> Column:
        return ts + F.expr(f"INTERVAL '{int(seconds)}' SECOND")

    quorum, everyone = F.get(wins, F.lit(min_done - 1))["at"], F.get(results, F.lit(expected - 1))["at"]
    first_result = F.get(results, F.lit(0))["at"]
    grace = F.when(first_result.isNotNull(), F.greatest(after(F.col("first_full"), grace_sec), first_result))
    grace = F.when(F.col("first_full").isNotNull(), grace)
    longest = after(F.col("start"), max_wait_sec)
    at = F.least(quorum, everyone, grace, longest)
    reason = F.when(at == quorum, "quorum").when(at == everyone, "all_done").when(at == grace, "grace").otherwise("maxwait")
    rows = facts.withColumns({"fired_at": at, "reason": reason}).filter((F.col("fired_at") <= mark) | (F.col("fired_at") <= F.col("last_seen")))
    seen = F.filter("results", lambda e: e["at"] <= F.col("fired_at"))
    return rows.select(
        "super_cycle_id", "reason", F.coalesce(F.size(F.filter(seen, lambda e: e["ok"])), F.lit(0)).cast("long").alias("n_success"),
        F.coalesce(F.size(seen), F.lit(0)).cast("long").alias("n_done"), "fired_at",
    )
