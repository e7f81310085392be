"""Removal of repeated 100-byte strings against brute force over all windows."""

import hashlib
import random

import numpy as np
import pytest

from ledgerlark.llm import suffixes


def brute(rows, length=100):
    """rows: (doc_id, text) in order; what stays of each."""
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            w = data[i:i + length]
            if w in seen:
                gone[i:i + length] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randint(2, 7)))
    passage = [" ".join(word() for _ in range(rng.randint(15, 60))) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            p = rng.choice(passage)
            if kind < 0.4:
                parts.append(p)
            elif kind < 0.6:
                a = rng.randint(0, len(p) // 2)
                parts.append(p[a:a + rng.randint(60, 200)])
            elif kind < 0.7:
                parts.append(rng.choice(["a", "ab", "x" * 7 + "\n"]) * rng.randint(50, 300))
            else:
                parts.append(" ".join(word() for _ in range(rng.randint(1, 60))))
        docs.append((i, rng.choice(["", " ", "\n"]).join(parts)))
    docs += [(n, docs[3][1]), (n + 1, docs[5][1] + "!"), (n + 2, None), (n + 3, "")]
    return docs


def got(spark, rows, **kw):
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "doc_id bigint, text string").repartition(5)
    return sorted(tuple(r)[:5] for r in suffixes.remove_repeats(df, **kw).collect())


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows) == brute(rows)


def test_hot_buckets_equal_brute_force(spark):
    rows = corpus(7)
    assert got(spark, rows, hot_rows=3) == brute(rows)


def test_small_chunks_and_blocks(spark, monkeypatch):
    rows = corpus(9)
    for name, value in (("CHUNK", 300), ("BLOCK_ROWS", 5)):
        monkeypatch.setattr(suffixes, name, value)
    texts = [(i, 0, t or "") for i, t in rows]
    import pyarrow as pa

    # the scan is the part that cuts texts: anchors must not depend on the cuts
    def anchors():
        batch = pa.record_batch([pa.array([r[c] for r in texts], t) for c, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.string()))], names=["did", "th", "text"])
        out = [r for b in suffixes._scan(iter([batch])) for r in b.to_pylist()]
        return sorted((r["did"], r["pos"] >> 1) for r in out)

    small = anchors()
    monkeypatch.setattr(suffixes, "CHUNK", 1 << 20)
    assert small == anchors()


def test_repeated_ids_nulls_and_empty(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(1, text), (1, text), (None, text), (2, text[:50]), (2, text[:50]), (3, ""), (4, "d" * 300), (4, "d" * 300)]
    out = sorted(((r["doc_id"], r["n_removed"]) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert out == sorted([(1, 0), (1, 300), (None, 300), (2, 0), (2, 0), (3, 0), (4, 299), (4, 300)], key=str)
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_sort_block_finds_windows_in_any_alignment():
    rng = np.random.default_rng(1)
    around = rng.integers(97, 99, (300, 2 * suffixes.REACH), dtype=np.uint8)
    around[100:200, :90] = around[0, :90]
    around[150:250, 60:] = around[1, 60:]
    bucket = np.repeat(np.arange(3), 100)
    full = np.full(300, suffixes.REACH)
    bits = suffixes.sort_block(bucket, around, full, full)
    for s in range(suffixes.REACH + 1):
        seen = set()
        for i in range(300):
            key = (bucket[i], around[i, s:s + suffixes.REACH].tobytes())
            assert bits[i, s] == (key in seen)
            seen.add(key)
