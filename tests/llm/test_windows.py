"""Benchmark windows, periodic runs and importance resampling next to brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerlark.llm import decontaminate, periodic, resample

DOCS = "doc_id long, text string, _digest string, h string"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def letters(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def brute_contamination(text, items, width=10):
    words = letters(text)
    hit, found = set(), set()
    for item, body in items:
        own = letters(body)
        size = min(width, len(own))
        grams = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in grams:
                hit.update(range(i, i + size))
                found.add("null" if item is None else str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def small_world(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "ÉTÉ", "été", "x1", "σας", "a", "b", "zz", "ΑΣ"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "  ", "."]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 8, 10, 11, 30]))) for i in range(12)] + [(None, text(4)), (3, text(6)), (50, None), (51, ""), (52, " .,")]
    docs = [(i, text(rng.randrange(60)), None, "h") for i in range(40)] + [(None, text(9), "d", None), (None, None, None, None), (7, "", None, None), (8, " - ", None, None)]
    docs += [(100 + i, f"Start {items[i][1]} end" if items[i][1] else None, None, None) for i in range(17)]
    return docs + docs[-1:], items


def test_contamination_equals_brute_force(spark):
    docs, items = small_world(5)
    out = decontaminate.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(map(repr, map(tuple, out.collect())))
    assert got == sorted(repr((d[0], *brute_contamination(d[1], items))) for d in docs)


def test_windows_beyond_the_broadcast_bound(spark, monkeypatch):
    docs, items = small_world(6)
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(repr, decontaminate.contamination(*frames).collect()))
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    assert sorted(map(repr, decontaminate.contamination(*frames).collect())) == want


def test_equal_hashes_are_verified(spark, monkeypatch):
    """All windows share one hash: only equal words count."""
    docs, items = small_world(7)
    real = F.xxhash64
    monkeypatch.setattr(decontaminate.F, "xxhash64", lambda *c: real(F.lit(1)))
    out = decontaminate.contamination(spark.createDataFrame(docs[:25], DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr((d[0], *brute_contamination(d[1], items))) for d in docs[:25])


def test_contamination_of_long_and_empty_tables(spark):
    item = "one two three four five six seven eight nine ten eleven"
    long = "pad " * 200_000 + item.upper() + " pad" * 200_000
    docs, bench = spark.createDataFrame([(1, long)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert tuple(decontaminate.contamination(docs, bench).first())[:4] == (1, 400_011, 11, 1)
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    row = decontaminate.contamination(docs, bench.limit(0)).first()
    assert row.n_hit == 0 and not row.contaminated and row.items_sha256 == hashlib.sha256(b"").hexdigest()


def test_spans_and_documents_are_removed(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    rows = [(1, "So: Alpha, beta -- GAMMA! End.", "k"), (2, "alpha beta", None), (3, None, None), (4, "alpha beta gamma", None), (5, "alpha beta gamma beta gamma alpha beta gamma", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _cut_text string")
    cut = decontaminate.drop_spans(docs, bench)
    assert cut.columns == docs.columns
    assert {r.doc_id: r.text for r in cut.collect()} == {1: "So: ! End.", 2: "alpha beta", 3: None, 4: "", 5: " beta gamma "}
    left = decontaminate.drop_documents(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]


def brute_runs(x, least=12):
    n, out = len(x), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, e - a, q) for (a, e), q in out.items())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 30), st.integers(0, 90), st.sampled_from([2, 4, 1 << 17]), st.sampled_from([8, 1 << 20]))
def test_runs_equal_brute_force(head, period, repeated, block, cells):
    x = head + [head[i % period % len(head)] if head else 0 for i in range(repeated)]
    before = periodic.MOST_BLOCK, periodic.CELLS
    periodic.MOST_BLOCK, periodic.CELLS = block, cells
    try:
        assert periodic.runs(np.array(x, np.int64)) == brute_runs(x)
    finally:
        periodic.MOST_BLOCK, periodic.CELLS = before


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**29), min_size=4, max_size=4), min_size=1, max_size=5), st.integers(4, 20), st.integers(0, 99))
def test_squared_differences_by_transform(blocks, width, seed):
    a = np.array(blocks, np.uint64)
    w = np.random.default_rng(seed).integers(0, 2**29, (len(blocks), width)).astype(np.uint64)
    want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(row, win[d:d + 4])) % periodic.PRIME for d in range(width - 3)] for row, win in zip(a, w)]
    assert periodic.squared_differences(a, w).tolist() == want
    spread = np.concatenate([a, a * 0], axis=1)
    assert (periodic.intt(periodic.ntt(spread)) == spread).all()


def rewritten(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_periodic_query_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["a", "b", "cc", "é x"]) for _ in range(rng.randrange(90)))) for i in range(80)]
    docs += [(None, "a b " * 9), (None, None), (90, ""), (91, " \t\n "), (92, "x " * 40), (92, "x " * 40), (93, "one two\x0bthree " * 7)]
    monkeypatch.setattr(periodic, "SLAB", 200)
    frame = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, runs string")
    got = sorted(map(repr, map(tuple, periodic.summary(periodic.find_runs(periodic.planted(frame))).collect())))
    want = []
    for doc_id, text in docs:
        words = rewritten(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        found = brute_runs(words)
        gone = {i for a, n, q in found for i in range(a + q, a + n)}
        best = min(((-n, a, q) for a, n, q in found), default=None)
        named = (None,) * 4 if best is None else (best[1], -best[0], best[2], -1000 * best[0] // best[2])
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in found)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append(repr((doc_id, len(found), *named, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())))
    assert got == sorted(want)
    assert periodic.find_runs(frame.limit(0)).count() == 0


def test_periods_of_a_very_long_text():
    x = np.concatenate([np.arange(1000), 1000 + np.arange(150_000) % 40_001])
    assert periodic.runs(x) == [(1000, 150_000, 40_001)]
    assert periodic.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=1, max_size=300).map(lambda b: b.hex().encode()), max_size=7), max_size=5), st.integers(1, 4))
def test_ngram_crcs_equal_the_library(texts, most):
    scans = [resample._scan(t) for t in texts] or [resample._scan([])]
    crcs, lengths = (np.concatenate(x) for x in zip(*scans))
    counts = np.array([len(x) for _, x in scans])
    found = resample.ngram_crcs(crcs, lengths, np.repeat(np.cumsum(counts) - counts, counts), most)
    got = sorted((int(a), n, int(c)) for n, (at, crc) in enumerate(found, 1) for a, c in zip(at, crc))
    base, want = 0, []
    for t in texts:
        want += [(base + i, n, zlib.crc32(b" ".join(t[i:i + n]))) for n in range(1, most + 1) for i in range(len(t) - n + 1)]
        base += len(t)
    assert got == sorted(want)


@pytest.mark.parametrize("most,slab", [(1, 1 << 18), (3, 50)])
def test_resampling_equals_plain_python(spark, monkeypatch, most, slab):
    rng = random.Random(most)
    text = lambda n: " ".join(rng.choice(["the", "The", "of", "Éa", "x-1", "zeta", "q"]) for _ in range(n))
    docs = [(i, text(rng.randrange(45))) for i in range(150)] + [(None, text(30)), (None, None), (7, ""), (8, "-. "), (9, text(25))]
    bench = [(i, text(12)) for i in range(9)] + [(9, None)]
    monkeypatch.setattr(resample, "SLAB", slab)
    feats = lambda t: [zlib.crc32(" ".join(w[i:i + n]).encode()) % 97 for w in [letters(t)] for n in range(1, most + 1) for i in range(len(w) - n + 1)]
    s, t = [0] * 97, [0] * 97
    for table, rows in ((s, docs), (t, bench)):
        for _, body in rows:
            for f in feats(body):
                table[f] += 1
    gain = [math.floor(1000 * math.log((t[i] + 1) * (sum(s) + 97) / ((s[i] + 1) * (sum(t) + 97)))) for i in range(97)]
    rows = []
    for i, body in docs:
        f = feats(body)
        weight = sum(gain[x] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(letters(body))))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = {r: n for n, r in enumerate(able[:10 * len(able) // 100], 1)}
    out = resample.resample(spark.createDataFrame([(d, x, "clash") for d, x in docs], "doc_id long, text string, buckets string"),
                            spark.createDataFrame(bench, "item_id long, text string"), "item_id", most=most, buckets=97)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr((*r[:4], rank.get(r))) for r in rows)


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert resample.resample(docs.limit(0), docs, "doc_id").count() == 0
    assert resample.resample(docs, docs.limit(0), "doc_id").first().n_features == 30
