"""Exact and near duplicates against plain Python; the cuckoo index under insertion, deletion and overflow."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import common, exact_dedup, simhash

SCHEMA = "doc_id bigint, text string, points string, _sha int"


def word(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))


def exact_rows():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \n\t") for _ in range(rng.randint(0, 6))) for _ in range(400)] + ["é" * 5000, None, ""]
    rows = [(i, t, "x", i % 3) for i, t in enumerate(texts)]
    return rows + [(None, "a b", "y", 0), (None, "only null id", "y", 1), (3, texts[3], "x", 1), (3, texts[3], "x", 0), (1000, "hot", "h", 0)] + [(2000 + i, "h o t" if i % 2 else "hot", "h", 0) for i in range(300)]


def exact_brute(rows):
    groups = {}
    for i, t, *_ in rows:
        t = t or ""
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t), []).append((-len(t), i is None, i or 0))
    return {k: (sorted(v), len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("shards", [1, 7])
def test_exact_groups(spark, shards):
    rows = exact_rows()
    got = exact_dedup.find_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(6), shards).collect()
    want = exact_brute(rows)
    assert len(got) == len(rows)
    kept = {}
    by_id = {}
    for i, t, *_ in rows:
        by_id.setdefault(i, set()).add(hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", t or "").encode()).hexdigest())
    digest = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    for r in got:
        best, n = digest[r["text_sha256"]]
        assert r["text_sha256"] in by_id[r["doc_id"]]
        assert r["group_size"] == n and r["keep_id"] == (None if best[0][1] else best[0][2])
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
            kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + 1
    assert set(kept) == set(digest) and set(kept.values()) == {1}


def test_drop_duplicates_keeps_columns(spark):
    rows = exact_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = exact_dedup.drop_duplicates(df, 3)
    assert got.columns == df.columns
    out = got.collect()
    assert len(out) == len(exact_brute(rows))
    assert [r["_sha"] for r in out if r["doc_id"] == 3] in ([], [0])
    assert exact_dedup.drop_duplicates(df.limit(0)).count() == 0


def test_index_inserts_deletes_and_verifies():
    rng = random.Random(4)
    index, live = exact_dedup.CuckooIndex(1), {}
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for _ in range(20000):
        k = rng.choice(keys)
        if rng.random() < 0.6:
            assert index.insert(k, 1, (0, False, 0)) == (k in live)
            live[k] = live.get(k, 0) + 1
        else:
            assert index.delete(k, 1) == (k in live)
            if k in live:
                live[k] -= 1
                if not live[k]:
                    del live[k]
    assert {e[0]: e[1] for e in index.entries()} == live
    assert index.filter.used == len(live) and index.filter.buckets > 256
    assert all(k in index.filter for k in live)


def test_filter_hit_is_no_proof():
    index = exact_dedup.CuckooIndex(1)
    a = bytes(32)
    b = bytes(12) + b"x" * 20  # same bucket and mark, another digest
    index.insert(a, 1, (0, False, 0))
    assert b in index.filter and index.find(b) is None
    assert not index.insert(b, 1, (0, False, 1))
    index.delete(a, 1)
    assert index.find(b) is not None and index.find(a) is None


def test_index_table_update(spark):
    def rows(texts, start=0):
        return exact_dedup.digests(spark.createDataFrame([(i + start, t) for i, t in enumerate(texts)], "doc_id bigint, text string"))

    first = exact_dedup.update_index(None, rows(list("aabbbc")), None, 4)
    second = exact_dedup.update_index(first, rows(["d", "a"], 100), rows(["c", "b", "zz"]), 4)
    got = {bytes(r["digest"]).hex(): r["n"] for r in second.collect()}
    assert got == {hashlib.sha256(t.encode()).hexdigest(): n for t, n in (("a", 3), ("b", 2), ("d", 1))}


def brute_print(text, width):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values, linked):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_fingerprint_bits():
    for t in ("", "One", "a b", "The QUICK brown\tfox  jumps ÄÖ éa", "x y z " * 50, " \n"):
        for w in (1, 3, 5):
            assert simhash.simhash(t, w) & (1 << 64) - 1 == brute_print(t, w)


def near_rows():
    rng = random.Random(6)
    base = [[word(rng) for _ in range(rng.randint(3, 60))] for _ in range(60)]
    rows = []
    for i in range(300):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = word(rng)
        rows.append((i * 7 % 311, " ".join(w)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "!")]


@pytest.mark.parametrize("params", [dict(width=3), dict(width=3, block=2), dict(width=2, max_bits=7, min_bytes=3)])
def test_near_components_equal_brute_force(spark, params):
    rows = near_rows()
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), **params).collect()}
    prints = {i: brute_print(t or "", params["width"]) for i, t in rows}
    assert {i: r["fp"] & (1 << 64) - 1 for i, r in got.items()} == prints
    bits, least = params.get("max_bits", 3), params.get("min_bytes", 5)
    same = lambda a, b: bin(a ^ b).count("1") <= bits and sum((a ^ b) >> 8 * p & 255 == 0 for p in range(8)) >= least
    root = roots(sorted(set(prints.values())), same)
    low = {}
    for i, p in prints.items():
        low[root[p]] = min(low.get(root[p], i), i)
    assert {i: r["component_id"] for i, r in got.items()} == {i: low[root[p]] for i, p in prints.items()}


def test_planes_cover_five_positions():
    from itertools import combinations

    assert len(simhash.PLANES) == 14
    for five in combinations(range(8), 5):
        assert sum(set(p) <= set(five) for p in simhash.PLANES) == 1


def test_links_of_close_fingerprints(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(-2**63, 2**63, 4)
    values = {int(c) for c in centres}
    for _ in range(400):
        v = int(rng.choice(list(values))) & (1 << 64) - 1
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            v ^= 1 << int(b)
        values.add(v - (1 << 64) if v >> 63 else v)
    df = spark.createDataFrame([(v,) for v in values], "fp bigint")
    for block in (2048, 16):
        found = {r["node"]: r["root"] for r in common.components(simhash.links(df, block=block)).collect()}
        want = roots(sorted(values), lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 3)
        assert {v: found.get(v, v) for v in values} == want


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5)]
    got = dict((r["node"], r["root"]) for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert all(got.get(i, i) == 0 for i in range(1, 301)) and all(got[i] == 1000 for i in range(1001, 1200))


def test_keep_one(spark):
    rows = [(5, "a b c d e f g", "x"), (3, "a b c d e f g", "y"), (3, "a b c d e f g", "z"), (None, "null id here", "n"), (8, "other words entirely they are", "x")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, fp string")).collect()
    assert sorted((str(r["doc_id"]), r["fp"]) for r in got) == [("3", "y"), ("8", "x"), ("None", "n")]
    assert simhash.keep_one(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_running_sum(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.randint(0, 5), rng.randint(0, 9)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, v bigint").repartition(5)
    got = common.running_sum(df, ["g"], [F.col("o")], {"s": "v"}).collect()
    assert len(got) == 500
    for g in ("a", None, "b"):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: (r["o"], r["s"]))
        seen = 0
        totals = {}
        for r in mine:
            totals.setdefault(r["o"], []).append(r)
        for o in sorted(totals):
            ties = sorted(totals[o], key=lambda r: r["s"])
            assert max(r["s"] for r in ties) == seen + sum(r["v"] for r in ties)
            assert min(r["s"] for r in ties) >= seen
            seen = max(r["s"] for r in ties)
