"""Order-dependent rules as keyed state: one processor per rule, its state in the RocksDB store of the query.

A micro-batch reads and writes the state of the keys it holds and of no others, so its cost follows its rows and not the keys
ever seen; the store writes change logs and takes part in the checkpoint of the query, which makes a restart exact.
Every processor takes the rows of one key one after the other. Those that need an order sort the rows of the key in the
micro-batch (its size is bounded by the source, for example ``maxFilesPerTrigger`` or ``maxOffsetsPerTrigger``) and go on from
the state; rows that arrive in a later micro-batch are placed after it, whatever their time. The others keep a bounded list.
Every call on the state crosses from Python to the JVM, so rules of many small keys (newest lists, gates) keep the state of all keys
of a bucket in one list: a micro-batch reads and writes the buckets of its keys, each in one call.
Times go in and out as microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from .. import constants as K
from ..functions import rules
from ..operators.views import noop_tie

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES_ONLY = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"  # a batch uploads its changes, not the store
ROW_COUNTS = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"  # looks a key up before every write: a list is read once per element
KEEP_MS = 90 * 86_400_000  # lists of a key that gets no rows for so long are dropped
BUCKETS = 1024


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Queries started inside see these settings of the session; queries started later do not."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_keyed(stream: DataFrame, path: str, expiring: bool = False) -> DataFrame:
    """Processes all available input into Parquet, append only, and returns everything written on the path so far.

    State lives in RocksDB. ``expiring`` is for rules whose state has a time to live: the clock of such a query never
    stands still, so it is told not to run batches without data, which would never end.
    """
    values = {PROVIDER: ROCKSDB, CHANGES_ONLY: "true", ROW_COUNTS: "false", **({"spark.sql.streaming.noDataMicroBatches.enabled": "false"} if expiring else {})}
    with settings(stream.sparkSession, values):
        query = (
            stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True).start(f"{path}/rows")
        )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def state_of(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """The newest committed state of a query, one row per key and value: columns of the key, then those of the variable."""
    table = spark.read.format("statestore").option("stateVarName", variable).load(f"{path}/checkpoint")
    held = next(c for c in table.columns if c not in ("key", "partition_id"))
    return table.select("key.*", f"{held}.*")


def newest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of every key of an append-only feed of results whose ``version`` grows per key."""
    values = [c for c in rows.columns if c not in (*keys, version)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), version).alias("_row")).select(*keys, "_row.*")


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _ordered(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r["run_ts"], r["attempt_id"]))


def _keyed(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, time: str = "None", initial: DataFrame | None = None) -> DataFrame:
    processor.out = Row(*[c.split()[0] for c in schema.split(", ")])  # makes named rows
    return stream.groupBy(*keys).transformWithState(processor, schema, "Append", time, initial.groupBy(*keys) if initial is not None else None)


def _bucketed(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, time: str) -> DataFrame:
    """Like ``_keyed`` with one call of the processor for all keys of a bucket."""
    rows = stream.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    return _keyed(rows, ["_bucket"], processor, schema, time)


# --- numbers and running bests ---------------------------------------------------------------------------------------------


class Progress(StatefulProcessor):
    """State: attempts so far and the best signed score. A NaN score counts as none."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("progress", "n bigint, best double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, best = self.state.get() or (0, None)
        for row in _ordered(rows):
            signed = row["signed"]
            if signed is not None and signed == signed and (best is None or signed > best):
                best = signed
            n += 1
            yield self.out(*row[:len(PROGRESS_COLUMNS)], n, None if best is None else best * row["metric_sign"])
        self.state.update((n, best))

    def close(self) -> None:
        pass


PROGRESS_COLUMNS = ["attempt_id", "competition_id", "run_ts", "stage", "action_type", "cv_score", "lb_score", "label", "gain_vs_best"]


def progress(attempts: DataFrame, competitions: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Number and signed running best of every attempt of a known competition, in order of arrival and time.

    ``initial`` (competition_id, n, best: signed) is the state to start from.
    """
    signs = competitions.select("competition_id", F.col("metric_sign").cast("double").alias("metric_sign"))
    rows = attempts.select(*PROGRESS_COLUMNS).join(signs, "competition_id")
    rows = rows.select(*[_micros(c).alias(c) if c == "run_ts" else c for c in PROGRESS_COLUMNS], "metric_sign", (F.col("metric_sign") * F.col("cv_score")).alias("signed"))
    types = {**dict(attempts.select(*PROGRESS_COLUMNS).dtypes), "run_ts": "bigint"}
    schema = ", ".join(f"{c} {types[c]}" for c in PROGRESS_COLUMNS) + ", attempt_no bigint, best_so_far double"
    processor = Progress() if initial is None else SeededProgress()
    out = _keyed(rows, ["competition_id"], processor, schema, initial=initial)
    return out.withColumn("run_ts", F.timestamp_micros("run_ts")).select(*PROGRESS_COLUMNS[:2], "attempt_no", *PROGRESS_COLUMNS[2:], "best_so_far")


class SeededProgress(Progress):
    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.state.update((initialState["n"], initialState["best"]))


SIGNATURE_KEYS = ["competition_id", "action_type", "error_signature"]


class Recurrence(StatefulProcessor):
    """State: errors of the signature so far."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("errors", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (n,) = self.state.get() or (0,)
        for row in _ordered(rows):
            n += 1
            yield self.out(*row, n)
        self.state.update((n,))

    def close(self) -> None:
        pass


def error_recurrence(attempts: DataFrame, alert_from: int = 3) -> DataFrame:
    """Number of every error within its signature; from ``alert_from`` on it raises an alert."""
    errors = attempts.filter("label = 'error' AND error_signature IS NOT NULL").select("attempt_id", _micros("run_ts").alias("run_ts"), *SIGNATURE_KEYS)
    schema = ", ".join(f"{c} {t}" for c, t in errors.dtypes) + ", occurrence_no bigint"
    out = _keyed(errors, SIGNATURE_KEYS, Recurrence(), schema)
    return out.withColumn("run_ts", F.timestamp_micros("run_ts")).withColumn("alert", F.col("occurrence_no") >= alert_from)


class Belief(StatefulProcessor):
    """State: evidence for and against, each update fading what came before, and the number of updates."""

    def __init__(self, decay: float):
        self.decay = decay

    def init(self, handle) -> None:
        self.state = handle.getValueState("belief", "alpha double, beta double, updates bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        alpha, beta, updates = self.state.get() or (1.0, 1.0, 0)
        for row in _ordered(rows):
            alpha, beta = 1.0 + (alpha - 1.0) * self.decay + row["up"], 1.0 + (beta - 1.0) * self.decay + row["down"]
            updates += 1
        self.state.update((alpha, beta, updates))
        yield self.out(key[0], key[1], alpha, beta, updates)

    def close(self) -> None:
        pass


def beliefs(attempts: DataFrame) -> DataFrame:
    """Decayed belief per competition and action after every micro-batch that holds attempts of the two."""
    deltas = rules.bandit_deltas(F.col("label"), F.col("gain_vs_best"), F.col("error_trace"), noop_tie(F.col("gain_vs_best"), F.col("cv_score")))
    rows = attempts.select(F.col("competition_id").alias("scope_key"), "action_type", _micros("run_ts").alias("run_ts"), "attempt_id", deltas.alias("_d"))
    zero = F.lit(0.0)
    rows = rows.select("scope_key", "action_type", "run_ts", "attempt_id", F.coalesce(F.col("_d.alpha").cast("double"), zero).alias("up"), F.coalesce(F.col("_d.beta").cast("double"), zero).alias("down"))
    kind = dict(rows.dtypes)
    out = _keyed(rows, ["scope_key", "action_type"], Belief(K.BANDIT_DECAY), f"scope_key {kind['scope_key']}, action_type {kind['action_type']}, alpha double, beta double, updates bigint")
    return out.select(F.lit("local").alias("scope"), "*")


# --- newest rows per key ----------------------------------------------------------------------------------------------------


class NewestList(StatefulProcessor):
    """Keeps the newest few rows of a key by its first two columns, in any order of arrival; the list expires if the key gets no
    rows for ``KEEP_MS``: with its bucket in the store, or when the bucket is next read."""

    def __init__(self, key: str, kind: str, schema: str, size: int):
        self.key, self.kind, self.schema, self.size = key, kind, schema, size
        self.columns = [c.split()[0] for c in schema.split(", ")]

    def init(self, handle) -> None:
        self.lists = handle.getListState("lists", f"{self.key} {self.kind}, seen bigint, touched bigint, newest array<struct<{self.schema}>>", KEEP_MS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, fresh = timerValues.getCurrentProcessingTimeInMs(), set()
        held = {k: (seen, touched, [tuple(r) for r in newest]) for k, seen, touched, newest in self.lists.get() if touched + KEEP_MS > now}
        for row in rows:
            k = row[self.key]
            seen, _, best = held.get(k) or (0, now, [])
            new = tuple(row[c] for c in self.columns)
            if len(best) < self.size or new[:2] > best[-1][:2]:
                best = sorted([*best, new], key=lambda r: r[:2], reverse=True)[:self.size]
            held[k] = seen + 1, now, best
            fresh.add(k)
        self.lists.put([(k, *v) for k, v in held.items()])
        for k in fresh:
            seen, _, best = held[k]
            result = self.judge(best)
            if result is not None:
                yield self.out(k, *result, seen)

    def judge(self, newest: list[tuple]) -> tuple | None:
        """What the newest rows of a key say, newest first."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class Stagnation(NewestList):
    def __init__(self, kind: str, window: int, threshold: int):
        super().__init__("competition_id", kind, "run_ts bigint, attempt_id bigint, label string", window)
        self.threshold = threshold

    def judge(self, newest: list[tuple]) -> tuple:
        jumps = [i for i, row in enumerate(newest) if row[2] == "jump"]
        since = jumps[0] if jumps else len(newest)
        return len(jumps), since, since >= self.threshold


def stagnation(attempts: DataFrame, window: int = 5, threshold: int = 3) -> DataFrame:
    """Winners since the last jump among the newest of each competition, after every micro-batch that holds a winner."""
    winners = attempts.filter("was_promoted").select("competition_id", _micros("run_ts").alias("run_ts"), F.col("attempt_id").cast("bigint").alias("attempt_id"), "label")
    kind = dict(winners.dtypes)["competition_id"]
    return _bucketed(winners, "competition_id", Stagnation(kind, window, threshold), f"competition_id {kind}, jumps_in_window bigint, stagnant_for bigint, is_stagnant boolean, seen bigint", "ProcessingTime")


class Tripwire(NewestList):
    def __init__(self, kind: str, size: int, deadband: float):
        super().__init__("competition_id", kind, "submitted_at bigint, submission_id bigint, attempt_id bigint, cv double, lb double, sign double", size)
        self.deadband = deadband

    def judge(self, newest: list[tuple]) -> tuple | None:
        if len(newest) < 2:
            return None
        apart = 0
        for (*_, cv, lb, sign), (*_, old_cv, old_lb, _) in zip(newest, newest[1:]):
            apart += sign * (cv - old_cv) > 0 and sign * (lb - old_lb) < -self.deadband * abs(old_lb)
        return len(newest) - 1, apart, newest[0][2], apart >= 2


def tripwire(subs: DataFrame, attempts: DataFrame, competitions: DataFrame, size: int = 4) -> DataFrame:
    """Divergence of own and external score over the newest complete submissions of each competition.

    Both feeds are streams. Their join on the attempt keeps the score of each attempt in the state store, so the attempts are read
    once and a submission may come before or long after its attempt.
    """
    done = subs.filter("status = 'complete' AND lb_score IS NOT NULL")
    done = done.select(F.col("attempt_id").alias("_id"), "competition_id", _micros("submitted_at").alias("submitted_at"), "submission_id", F.col("lb_score").cast("double").alias("lb"))
    scored = attempts.filter("cv_score IS NOT NULL").select(F.col("attempt_id").cast("bigint").alias("attempt_id"), F.col("cv_score").cast("double").alias("cv"))
    signs = competitions.select("competition_id", F.col("metric_sign").cast("double").alias("sign"))
    both = done.join(scored, F.col("_id") == F.col("attempt_id")).drop("_id").join(signs, "competition_id")
    kind = dict(both.dtypes)["competition_id"]
    return _bucketed(both, "competition_id", Tripwire(kind, size, K.LB_DEADBAND), f"competition_id {kind}, n_deltas bigint, n_diverged bigint, newest_attempt bigint, tripped boolean, seen bigint", "ProcessingTime")


# --- gate ---------------------------------------------------------------------------------------------------------------------


class Gate(StatefulProcessor):
    """State: for every super cycle of a bucket what decides about it, whether it has fired and the instant it waits for; the timer
    of the bucket, which is at the first of these instants.

    The instant at which a gate opens is known from the rows so far: the second success, the last expected result, the end of the
    grace after the first full result, or the longest wait, whichever is first. Once the rows of the cycle itself reach
    that instant, the gate fires at once; otherwise it waits until the watermark has passed it. A fired cycle is
    remembered, so that late attempts start no second round, until the watermark passes the end of its time and removes it.
    """

    def __init__(self, kind: str, expected: int, min_done: int, grace_sec: int, max_wait_sec: int, keep_sec: int):
        self.kind, self.expected, self.min_done = kind, expected, min_done
        self.grace, self.longest, self.keep = (s * 1_000_000 for s in (grace_sec, max_wait_sec, keep_sec))

    def init(self, handle) -> None:
        self.handle = handle
        self.facts = handle.getListState(
            "facts", f"super_cycle_id {self.kind}, start bigint, first_full bigint, last_seen bigint, fired boolean, due bigint, "
            "results array<struct<at bigint, id bigint, ok boolean>>")
        self.clock = handle.getValueState("clock", "timer bigint")

    def _opens(self, start: int, full: int | None, results: list[tuple]) -> tuple[int, str]:
        wins = [r for r in results if r[2]]
        options = []
        if len(wins) >= self.min_done:
            options.append((wins[self.min_done - 1][0], 0, "quorum"))
        if len(results) >= self.expected:
            options.append((results[self.expected - 1][0], 1, "all_done"))
        if full is not None and results:
            options.append((max(full + self.grace, results[0][0]), 2, "grace"))
        options.append((start + self.longest, 3, "maxwait"))
        at, _, reason = min(options)
        return at, reason

    def _settled(self, cycle: tuple, mark: int, out: list) -> tuple | None:
        """The cycle after its rows or the watermark (``mark``) moved on, none when it is over; its row goes out if it fires."""
        name, start, full, seen, fired, _, results = cycle
        until = start + self.longest + self.keep
        if not fired:
            at, reason = self._opens(start, full, results)
            if at > max(seen, mark):
                return name, start, full, seen, False, at, results
            early = [r for r in results if r[0] <= at]
            out.append(self.out(name, reason, sum(r[2] for r in early), len(early), at))
        return (name, start, full, seen, True, until, []) if until > mark else None

    def _hold(self, cycles: list[tuple], timer: int) -> None:
        """Stores the cycles of a bucket and moves its timer (-1: none)."""
        if cycles:
            due = -(-min(c[5] for c in cycles) // 1000)
            self.facts.put(cycles)
            if due != timer:
                self.handle.registerTimer(due)
                self.clock.update((due,))
        else:
            due = -1
            self.facts.clear()
            self.clock.clear()
        if timer not in (-1, due):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        cycles, fresh, out = {c[0]: self._plain(c) for c in self.facts.get()}, set(), []
        for row in rows:
            name, at = row["super_cycle_id"], row["run_ts"]
            _, start, full, seen, fired, _, results = cycles.get(name) or (name, at, None, at, False, 0, [])
            if fired or at is None:
                continue
            if row["complete"]:
                full = at if full is None else min(at, full)
            if row["done"]:
                results = sorted([*results, (at, row["attempt_id"], row["ok"])])[:self.expected]
            cycles[name] = name, min(at, start), full, max(at, seen), False, 0, results
            fresh.add(name)
        for name in fresh:
            cycles[name] = self._settled(cycles[name], -1, out)
        if fresh:
            (timer,) = self.clock.get() or (-1,)
            self._hold([*cycles.values()], timer)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark, cycles, out = timerValues.getCurrentWatermarkInMs() * 1000, [], []
        for cycle in map(self._plain, self.facts.get()):
            left = self._settled(cycle, mark, out) if cycle[5] <= mark else cycle
            if left:
                cycles.append(left)
        self._hold(cycles, expiredTimerInfo.getExpiryTimeInMs())
        yield from out

    @staticmethod
    def _plain(cycle: tuple) -> tuple:
        return (*cycle[:6], [tuple(r) for r in cycle[6]])

    def close(self) -> None:
        pass


def gate(
    attempts: DataFrame, delay: str = "1 hour", *, expected: int = 3, min_done: int = 2, grace_sec: int = 900, max_wait_sec: int = 3000, keep_sec: int = 0,
) -> DataFrame:
    """Fires every super cycle once: on enough successes, on all results, after the grace or the longest wait.

    The clock is the watermark, ``delay`` behind the newest event time. The state of a fired cycle is removed when the clock has
    passed its longest wait and ``keep_sec`` more.
    """
    whole = ~F.coalesce("futility_early_exit", F.lit(False))
    scored = F.col("cv_score").isNotNull()
    rows = attempts.withWatermark("run_ts", delay).select(
        "super_cycle_id", "run_ts", F.col("attempt_id").cast("bigint").alias("attempt_id"), whole.alias("complete"),
        (scored | F.col("error_trace").isNotNull()).alias("done"), (scored & whole).alias("ok"),
    )
    rows = rows.withColumn("event_time", F.col("run_ts")).withColumn("run_ts", _micros("run_ts"))
    kind = dict(rows.dtypes)["super_cycle_id"]
    processor = Gate(kind, expected, min_done, grace_sec, max_wait_sec, keep_sec)
    out = _bucketed(rows, "super_cycle_id", processor, f"super_cycle_id {kind}, reason string, n_success bigint, n_done bigint, fired_at bigint", "EventTime")
    return out.withColumn("fired_at", F.timestamp_micros("fired_at"))
