"""Fingerprints: peeling recovers the exact difference; neighbours and likeness against plain Python."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from ledgerlark.llm import sketches


def sets(seed, sizes):
    rng = random.Random(seed)
    for a, b, common in sizes:
        shared = [rng.getrandbits(30) for _ in range(common)]
        yield shared + [rng.getrandbits(29) for _ in range(a)], shared + [(1 << 29) + rng.getrandbits(29) for _ in range(b)]


def test_difference_is_exact_at_every_size(spark):
    pairs = list(sets(1, [(0, 0, 0), (0, 0, 9), (1, 0, 3), (3, 4, 100), (12, 12, 0), (40, 60, 5), (300, 5, 50), (900, 900, 100), (0, 700, 0)] * 2))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<bigint>, b array<bigint>")
    for r in df.select("i", sketches.difference(F.col("a"), F.col("b")).alias("d"), sketches.likeness(F.col("a"), F.col("b")).alias("l")).collect():
        a, b = map(set, pairs[r["i"]])
        assert {(x["n"], x["k"]) for x in r["d"]} == {(1, k) for k in a - b} | {(-1, k) for k in b - a}
        assert len(r["d"]) == len(a ^ b)
        assert abs(r["l"] - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12


def test_stuck_sketch_is_null(spark):
    (a, b), = sets(2, [(60, 60, 0)])
    df = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    assert df.select(sketches._attempt(F.col("a"), F.col("b"), 0)).first()[0] is None


def test_sketches_that_all_stick_still_give_the_exact_likeness(spark, monkeypatch):
    pairs = list(sets(4, [(0, 0, 0), (0, 0, 9), (1, 0, 3), (12, 7, 5), (300, 5, 50)]))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<bigint>, b array<bigint>")
    monkeypatch.setattr(sketches, "peel", lambda cells, seed=0: F.when(F.size(cells) < 0, F.array().cast("array<bigint>")))
    for r in df.select("i", sketches.difference(F.col("a"), F.col("b")).alias("d"), sketches.likeness(F.col("a"), F.col("b")).alias("l")).collect():
        a, b = map(set, pairs[r["i"]])
        assert sorted((x["n"], x["k"]) for x in r["d"]) == sorted([(1, k) for k in a - b] + [(-1, k) for k in b - a])
        assert abs(r["l"] - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12


def test_cells_of_very_long_texts_wrap_and_still_subtract(spark):
    top = (1 << sketches.DIGEST_BITS) - 1
    many = F.array_repeat(F.lit(top).cast("bigint"), 600_000)  # more than a cell could count without wrapping
    df = spark.range(1).select(sketches.sketch(F.concat(many, F.array(F.lit(5).cast("bigint")))).alias("a"), sketches.sketch(many).alias("b"))
    got = df.select("a", sketches.peel(sketches.subtract(F.col("a"), F.col("b"))).alias("d"), sketches.peel(sketches.subtract(F.col("b"), F.col("a"))).alias("e")).first()
    assert all(0 <= c < sketches.SPAN for c in got["a"])
    assert len(got["d"]) == 1 and got["e"] == [-got["d"][0]] and abs(got["d"][0]) % sketches.ONE >> sketches.CHECK_BITS == 5


def units(text):
    out = []
    for line in re.split(r"[\n\r]+", text):
        words = list(re.finditer(r"[^\x20\x09-\x0D]+[\x20\x09\x0b\x0c]*", line))
        for i in range(0, len(words), sketches.WORDS):
            out.append("".join(w.group() for w in words[i:i + sketches.WORDS]).rstrip(" "))
    return set(out)


def brute(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        near = lambda x, y: len(units(x) & units(y)) / len(units(x) | units(y)) if units(x) | units(y) else 1.0
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), round(near(t, edited), 9), round(near(t, nxt), 9))
    return out


def test_neighbours_and_likeness(spark, monkeypatch):
    rng = random.Random(5)
    line = lambda: " ".join("".join(rng.choice("abcdéß😀") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 80)))
    lines = [line() for _ in range(30)]
    rows = [(rng.randint(-10**12, 10**12), "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12)))) for _ in range(150)]
    rows[3] = (rows[3][0], "")
    for ranges in (1, 100):
        monkeypatch.setattr(sketches, "RANGES", ranges)
        got = sketches.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
        assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got} == brute(rows)
    text = dict(rows)
    by_text = {}
    for r in got:
        assert by_text.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c"), (1, None), (1, None), (2, "x y"), (2, "x y")]
    got = sketches.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] is None, r["n_chars"]) for r in got) == [(False, 0), (False, 0), (False, 3), (False, 3), (True, 5)]
    assert all(r["near_edited"] is not None and r["near_next"] is not None for r in got)
    assert sketches.fingerprints(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    one = sketches.fingerprints(spark.createDataFrame([(7, "one two")], "doc_id bigint, text string")).first()
    assert one["near_next"] == 1.0
