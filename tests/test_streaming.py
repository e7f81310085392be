"""Streams in several micro-batches give what the batch operators give at once; state holds what it should and no more."""

import pytest
from pyspark.sql import functions as F

from ledgerlark.catalog import roles
from ledgerlark.functions import text
from ledgerlark.operators import summaries, views
from ledgerlark.session import work_dir
from ledgerlark.sources.changelog import BUCKET, ChangeLog
from ledgerlark.streaming import jobs as J, keyed

SF = "/root/testdata/sf0.001"


def parts(spark, frames):
    """One file per frame, read one per micro-batch."""
    root = work_dir(spark) + "/feed"
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(root)
    schema = frames[0].schema
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root)


@pytest.fixture(scope="module")
def feed(spark):
    """Events in four files by time."""
    ev = spark.read.parquet(f"{SF}/events.parquet")
    days = [f"2024-01-{1 + i * 8:02d}" for i in range(4)] + ["2025-01-01"]
    raw = parts(spark, [ev.filter((F.col("ts") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("ts") < F.lit(hi).cast("timestamp_ntz"))) for lo, hi in zip(days, days[1:])])

    def stream():
        out = roles.project(raw(), "attempts").withColumn("run_ts", F.col("run_ts").cast("timestamp"))
        return out.withColumn("error_signature", text.error_signature(F.col("error_trace")))

    return stream, roles.Roles(spark, SF)


def _rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).toPandas().round(6).astype(str).values.tolist()))


def test_progress(spark, feed):
    stream, t = feed
    rows = keyed.run_keyed(keyed.progress(stream(), t.competitions), work_dir(spark))
    cols = ["attempt_id", "attempt_no", "best_so_far"]
    assert _rows(rows, *cols) == _rows(views.score_progression(t.attempts, t.competitions), *cols)


def test_beliefs_and_restart(spark, feed):
    stream, t = feed
    path = work_dir(spark)
    keyed.run_keyed(keyed.beliefs(stream()), path)
    again = keyed.run_keyed(keyed.beliefs(stream()), path)  # nothing new: the state and all rows are still there
    cols = ["scope_key", "action_type", "alpha", "beta", "updates"]
    last = keyed.newest(again.withColumn("v", F.col("updates")), ["scope_key", "action_type"], "v")
    assert _rows(last, *cols) == _rows(t.bandit, *cols)
    assert _rows(keyed.state_of(spark, path, "belief"), *cols) == _rows(t.bandit, *cols)


def test_error_recurrence(spark, feed):
    stream, t = feed
    rows = keyed.run_keyed(keyed.error_recurrence(stream()), work_dir(spark))
    got = rows.groupBy(*keyed.SIGNATURE_KEYS).agg(F.max("occurrence_no").alias("total"), F.count_if("alert").alias("occurrences_after_active"))
    cols = [*keyed.SIGNATURE_KEYS, "total", "occurrences_after_active"]
    assert _rows(got, *cols) == _rows(views.error_recurrence(t.signed_attempts, t.lessons), *cols)


def test_stagnation_keeps_five(spark, feed):
    stream, t = feed
    path = work_dir(spark)
    rows = keyed.run_keyed(keyed.stagnation(stream()), path, expiring=True)
    cols = ["competition_id", "jumps_in_window", "stagnant_for", "is_stagnant"]
    assert _rows(keyed.newest(rows, ["competition_id"], "seen"), *cols) == _rows(summaries.stagnation(t.attempts).filter("competition_id IS NOT NULL"), *cols)


def test_tripwire_reads_both_feeds_once(spark, feed):
    stream, t = feed
    subs = t.raw("orders")
    half = parts(spark, [subs.filter("o_orderkey % 3 <> 0"), subs.filter("o_orderkey % 3 = 0")])
    rows = keyed.run_keyed(keyed.tripwire(roles.project(half(), "subs"), stream(), t.competitions), work_dir(spark), expiring=True)
    cols = ["competition_id", "n_deltas", "n_diverged", "newest_attempt", "tripped"]
    assert _rows(keyed.newest(rows, ["competition_id"], "seen"), *cols) == _rows(views.cv_lb_tripwire(t.subs, t.attempts, t.competitions), *cols)


def gate_rows(spark, rows):
    df = spark.createDataFrame(rows, "super_cycle_id string, attempt_id long, s int, cv_score double, error_trace string, futility_early_exit boolean")
    return df.withColumn("run_ts", F.timestamp_seconds(F.col("s") + 1_000_000)).drop("s")


GATES = [
    ("quorum", 1, 0, 0.5, None, False), ("quorum", 2, 100, 0.6, None, None), ("errors", 3, 0, None, "x", False), ("errors", 4, 5, None, "x", False), ("errors", 5, 9, None, "x", False),
    ("grace", 6, 0, 0.5, None, False), ("grace", 7, 2000, 0.5, None, False), ("futile", 8, 0, 0.5, None, True), ("futile", 9, 10, 0.5, None, True),
]


def test_gate_fires_once_and_forgets(spark):
    """Four micro-batches: rules, timers without new rows of a cycle, a late row of a fired cycle, state removed after expiry."""
    first = gate_rows(spark, GATES)
    second = gate_rows(spark, [("late", 20, 3700, 0.5, None, False), ("quorum", 21, 3650, 0.9, None, False)])
    third = gate_rows(spark, [("clock", 10, 90_000, 0.5, None, False)])
    path = work_dir(spark)
    rows = keyed.run_keyed(keyed.gate(parts(spark, [first, second, third])(), "1 hour", keep_sec=600), path)
    got = {r.super_cycle_id: (r.reason, r.n_success, r.n_done, int(r.fired_at.timestamp())) for r in rows.collect()}
    zero = int(first.agg(F.min("run_ts")).first()[0].timestamp())  # the time of second 0
    assert rows.count() == len(got)  # once each
    assert {k: (*v[:3], v[3] - zero) for k, v in got.items()} == {
        "quorum": ("quorum", 2, 2, 100), "errors": ("all_done", 0, 3, 9), "grace": ("grace", 1, 1, 900), "futile": ("maxwait", 0, 2, 3000), "late": ("grace", 1, 1, 4600),
    }
    left = keyed.state_of(spark, path, "facts")
    assert [(r.super_cycle_id, r.fired) for r in left.collect()] == [("clock", False)]


def test_gate_equals_its_columns(spark, feed):
    stream, t = feed
    several = keyed.run_keyed(keyed.gate(stream(), "1 hour", keep_sec=86_400), work_dir(spark))
    attempts = t.attempts.withColumn("run_ts", F.col("run_ts").cast("timestamp"))
    mark = attempts.agg(F.max("run_ts")).scalar() - F.expr("INTERVAL '1' HOUR")
    once = J.gate_events(J.gate_facts(attempts, 3), mark, expected=3, min_done=2, grace_sec=900, max_wait_sec=3000)
    cols = ["super_cycle_id", "reason", "n_success", "n_done", "fired_at"]
    assert _rows(several, *cols) == _rows(once, *cols)


@pytest.mark.parametrize("buckets", [1, 3])
def test_gates_share_the_state_of_their_bucket(spark, monkeypatch, buckets):
    """All cycles of a bucket are one call and one timer: same rows as alone, and as many state entries as buckets, not as cycles."""
    monkeypatch.setattr(keyed, "BUCKETS", buckets)
    many = [(f"m{i}", 1000 + 3 * i + j, 50 * i + j * 100, 0.5, None, False) for i in range(60) for j in range(i % 3 + 1)]
    feed = parts(spark, [gate_rows(spark, GATES + many), gate_rows(spark, [("quorum", 21, 3650, 0.9, None, False), ("m0", 5000, 3650, 0.9, None, False)]),
                         gate_rows(spark, [("clock", 10, 90_000, 0.5, None, False)])])
    path = work_dir(spark)
    rows = keyed.run_keyed(keyed.gate(feed(), "1 hour", keep_sec=600), path)
    zero = int(gate_rows(spark, [("", 0, 0, 0.5, None, False)]).first().run_ts.timestamp())
    got = {r.super_cycle_id: (r.reason, r.n_success, int(r.fired_at.timestamp()) - zero) for r in rows.collect()}
    want = {f"m{i}": ("grace", 1, 50 * i + 900) if i % 3 == 0 else ("quorum", 2, 50 * i + 100) for i in range(60)}
    assert rows.count() == len(got)
    assert got == {**want, "quorum": ("quorum", 2, 100), "errors": ("all_done", 0, 9), "grace": ("grace", 1, 900), "futile": ("maxwait", 0, 3000)}
    assert [(r.super_cycle_id, r.fired) for r in keyed.state_of(spark, path, "facts").collect()] == [("clock", False)]
    first = spark.read.format("statestore").option("stateVarName", "clock").option("batchId", 0).load(f"{path}/checkpoint")
    assert first.count() == buckets


def test_newest_lists_share_the_state_of_their_bucket(spark, feed, monkeypatch):
    monkeypatch.setattr(keyed, "BUCKETS", 2)
    stream, t = feed
    path = work_dir(spark)
    rows = keyed.run_keyed(keyed.tripwire(roles.project(parts(spark, [t.raw("orders")])(), "subs"), stream(), t.competitions), path, expiring=True)
    cols = ["competition_id", "n_deltas", "n_diverged", "newest_attempt", "tripped"]
    assert _rows(keyed.newest(rows, ["competition_id"], "seen"), *cols) == _rows(views.cv_lb_tripwire(t.subs, t.attempts, t.competitions), *cols)


def test_lists_of_a_bucket_expire_one_by_one():
    """A key without rows for the time to live starts anew, though its bucket lives on."""
    class Held:
        rows = []

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

    class Handle:
        def getListState(self, *_):
            return Held()

    class Clock:
        def __init__(self, now):
            self.now = now

        def getCurrentProcessingTimeInMs(self):
            return self.now

    processor = keyed.Stagnation("bigint", 5, 3)
    processor.out = lambda *values: values
    processor.init(Handle())
    row = lambda k, ts: {"competition_id": k, "run_ts": ts, "attempt_id": ts, "label": "x"}
    call = lambda now, *rows: sorted(processor.handleInputRows((0,), iter(rows), Clock(now)))
    assert call(0, row(1, 1), row(2, 1)) == [(1, 0, 1, False, 1), (2, 0, 1, False, 1)]
    assert call(keyed.KEEP_MS - 1, row(1, 2)) == [(1, 0, 2, False, 2)]
    assert call(keyed.KEEP_MS, row(2, 3)) == [(2, 0, 1, False, 1)]
    assert call(keyed.KEEP_MS, row(1, 3)) == [(1, 0, 3, True, 3)]


def test_a_batch_touches_its_own_keys_only(spark):
    """20,000 keys in the state, a batch of 50 rows: 50 keys are read and written."""
    n = 20_000
    rows = lambda ids, ts: ids.select(F.col("id").alias("attempt_id"), (F.col("id") % n).alias("competition_id"), F.timestamp_seconds(F.lit(ts)).alias("run_ts"), F.lit("s").alias("stage"),
                                      F.lit("a").alias("action_type"), (F.col("id") * 1.0).alias("cv_score"), F.lit(None).cast("double").alias("lb_score"), F.lit("x").alias("label"), F.lit(0.0).alias("gain_vs_best"))
    competitions = spark.range(n).select(F.col("id").alias("competition_id"), F.lit(1).alias("metric_sign"))
    known = spark.range(n).select(F.col("id").alias("competition_id"), F.lit(7).cast("long").alias("n"), F.when(F.col("id") % 2 == 0, 5e6).alias("best"))
    feed = parts(spark, [rows(spark.range(1), 1), rows(spark.range(2 * n, 2 * n + 50), 2)])
    path = work_dir(spark)
    with keyed.settings(spark, {keyed.PROVIDER: keyed.ROCKSDB}):
        query = keyed.progress(feed(), competitions, known).writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"] == 50]
    assert updated == [50]
    out = {r.competition_id: (r.attempt_no, r.best_so_far) for r in spark.read.parquet(f"{path}/rows").filter("attempt_id >= 40000").collect()}
    assert out[0] == (9, 5e6) and out[1] == (8, 40001.0) and len(out) == 50
    assert keyed.state_of(spark, path, "progress").count() == n


def test_keys_come_once_though_the_watermark_has_passed(spark):
    feed = parts(spark, [
        spark.createDataFrame([(1, "a", 0), (2, "b", 10), (1, "a", 20)], "k int, s string, t int"),
        spark.createDataFrame([(3, "c", 90_000)], "k int, s string, t int"),
        spark.createDataFrame([(1, "a", 99_000), (4, "d", 99_001), (None, "e", 99_002)], "k int, s string, t int"),
    ])
    stream = feed().withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["k", "s"]).select("k", "s")
    log = ChangeLog(spark, work_dir(spark), stream.schema, ["s"], ["s"], buckets=4)
    assert sorted(r.s for r in J.first_of_keys(stream, log, work_dir(spark)).collect()) == ["a", "b", "c", "d", "e"]


def test_change_log(spark):
    log = ChangeLog(spark, work_dir(spark), "k int, v int, s string", ["k"], ["v"], buckets=8)
    frame = lambda rows: spark.createDataFrame(rows, "k int, v int, s string")
    assert log.commits() == [] and log.table().count() == 0
    log.append(frame([(i, 1, "old") for i in range(100)]), 0)
    log.append(frame([(3, 2, "new"), (100, 1, "new"), (None, 1, "null")]), 1)
    log.append(frame([(3, 2, "new"), (100, 1, "new"), (None, 1, "null")]), 1)  # a repeated version replaces itself
    assert log.changes().count() == 103 and spark.read.parquet(f"{log.path}/log-1").count() == 3
    before = sorted(map(str, log.table().collect()))
    assert len(before) == 102 and log.table().filter("k = 3").first().s == "new"
    found = log.lookup(frame([(3, 0, ""), (500, 0, "")]))
    assert [(r.k, r.s) for r in found.collect()] == [(3, "new")]
    one = log.changes(buckets=log.touched(frame([(3, 0, "")])))
    assert "PartitionFilters: [_bucket" in one._jdf.queryExecution().toString().replace("isnotnull(_bucket", "[_bucket") or one.select(BUCKET).distinct().count() == 1
    log.compact()
    assert log.commits() == [(1, True)] and sorted(map(str, log.table().collect())) == before
    log.append(frame([(5, 9, "after")]), 2)
    assert log.commits() == [(1, True), (2, False)] and log.table().filter("k = 5").first().s == "after" and log.changes().count() == 103
    log.compact()
    assert log.commits() == [(2, True)] and log.changes().count() == 102
    # rows of a version without its commit are not seen
    log._bucket(frame([(777, 1, "x")])).write.partitionBy(BUCKET).parquet(log._folder(3, False))
    assert log.table().filter("k = 777").count() == 0


def test_upsert_stream_writes_its_rows_only(spark):
    feed = parts(spark, [spark.createDataFrame([(i, 1) for i in range(50)], "k int, v int"), spark.createDataFrame([(3, 2), (3, 5), (60, 1)], "k int, v int")])
    log = ChangeLog(spark, work_dir(spark), "k int, v int", ["k"], ["v"], buckets=4)
    table = J.upsert_stream(feed(), log, work_dir(spark))
    assert {(r.k, r.v) for r in table.collect()} == {(i, 5 if i == 3 else 1) for i in [*range(50), 60]}
    assert spark.read.parquet(f"{log.path}/log-1").count() == 2
