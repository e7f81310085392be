"""Repeated passages of at least 100 bytes by blockwise suffix sorting with difference-cover ranks.

A suffix array of the whole corpus would ship every suffix. Here the suffixes are bucketed by anchors first: positions whose
24-byte hash is the least of some 100-byte window, so that equal windows have equal anchors at equal offsets. Buckets whose
anchor occurs once hold no repeat and end there. Occurrences whose whole neighbourhood was seen before repeat in full. Of the
rest, a block of buckets at a time is loaded with its neighbourhoods; the suffixes that start s bytes into them are sorted one
s at a time. Their long ties are resolved by ranks of 64-byte strings that were computed before at the positions of a
difference cover modulo 13 only; what the ranks leave of a window, 12 bytes, is compared directly. Memory is one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored, whole

LENGTH = 100  # bytes of a repeat
GRAM = 24  # bytes of an anchor
REACH = LENGTH - GRAM  # bytes on either side that a window can have beyond its anchor
MODULUS, COVER = 13, (0, 1, 3, 9)  # every difference modulo 13 occurs between two members
CORE = REACH - (MODULUS - 1)  # bytes that a cover rank stands for
CHUNK = 1 << 20  # bytes scanned at a time
BLOCK_ROWS = 20_000
HOT_ROWS = 200_000  # open occurrences of one anchor that a task may hold
ID_LAST = (1 << 63) - 1

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every window of ``width`` values."""
    size = 1
    while 2 * size <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[:len(x) - (width - size)], x[width - size:]) if width > size else x


def anchors(data: np.ndarray, ends: np.ndarray, forward: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, gram hashes and neighbourhood hashes of the anchors of texts that end at ``ends`` in ``data``."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * forward[:n], out=sums[1:])
    starts = np.concatenate([[0], ends[:-1]])
    last = np.repeat(ends, ends - starts)
    grams = n - GRAM + 1
    h = _mixed((sums[GRAM:] - sums[:grams]) * back[:grams])
    h[np.arange(grams) + GRAM > last[:grams]] = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = _sliding(h, REACH + 1, np.minimum)
    at = np.arange(len(least))
    least[at + LENGTH > last[:len(least)]] = 0
    # an anchor equals the least of a window that holds it, that is the greatest of those windows' least values
    pad = np.zeros(REACH, np.uint64)
    most = _sliding(np.concatenate([pad, least, pad]), REACH + 1, np.maximum)
    pos = np.flatnonzero((most[:grams] == h) & (h > 0))
    first = np.repeat(starts, ends - starts)
    lo, hi = np.maximum(pos - REACH, first[pos]), np.minimum(pos + LENGTH, last[pos])
    around = (sums[hi] - sums[lo]) * back[lo]
    around = _mixed(around + (pos - lo).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + (hi - pos).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return pos, h[pos], around


def _parts(ids: list, keys: list, texts: list) -> Iterator[tuple[list, list, list, list, list]]:
    """Texts in chunks of about CHUNK bytes; a longer text comes in parts that overlap by what an anchor can see."""
    held: list = []
    size = 0
    for i, k, text in zip(ids, keys, texts, strict=True):
        if len(text) < LENGTH:
            continue
        if len(text) <= CHUNK:
            held.append((i, k, text, 0, 0, len(text)))
            size += len(text)
        else:
            for at in range(0, len(text), CHUNK):
                lo, hi = max(0, at - REACH), min(len(text), at + CHUNK + LENGTH)
                yield [i], [k], [text[lo:hi]], [lo], [(at - lo, min(at + CHUNK, len(text)) - lo)]
        if size >= CHUNK:
            yield _columns(held)
            held, size = [], 0
    if held:
        yield _columns(held)


def _columns(held: list) -> tuple[list, list, list, list, list]:
    i, k, t, lo, a, b = zip(*held, strict=True)
    return list(i), list(k), list(t), list(lo), list(zip(a, b, strict=True))


ANCHOR = "h bigint, f bigint, did bigint, th bigint, pos bigint"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of a batch of texts; pos is 2 * position, plus 1 for an occurrence whose neighbourhood came earlier in the batch.

    The latter need no bucket any more and are dealt at random, so a passage of a third of all rows sends one row a batch.
    """
    forward, back = _powers(_BASE, CHUNK * 2 + 2 * LENGTH), _powers(_INVERSE, CHUNK * 2 + 2 * LENGTH)
    for batch in batches:
        got = []
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for ids, keys, parts, offsets, valid in _parts(batch.column("did").to_pylist(), batch.column("th").to_pylist(), texts):
            sizes = np.array([len(t) for t in parts])
            for lo, hi in _groups(sizes):
                ends = np.cumsum(sizes[lo:hi])
                pos, h, f = anchors(np.frombuffer(b"".join(parts[lo:hi]), np.uint8), ends, forward, back)
                doc = np.searchsorted(ends, pos, side="right")
                own = pos - (ends - sizes[lo:hi])[doc]
                doc = doc + lo
                bounds = np.array(valid)[doc]
                ok = (own >= bounds[:, 0]) & (own < bounds[:, 1])
                doc, own, h, f = doc[ok], own[ok], h[ok], f[ok]
                got.append((h.view(np.int64), f.view(np.int64), np.array(ids, np.int64)[doc], np.array(keys, np.int64)[doc], own + np.array(offsets, np.int64)[doc]))
        if not got:
            continue
        h, f, did, th, pos = (np.concatenate(c) for c in zip(*got, strict=True))
        order = np.lexsort((pos, th, did, f, h))
        h, f, did, th, pos = (c[order] for c in (h, f, did, th, pos))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (f[1:] != f[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        same = ~new & (did == did[lead]) & (th == th[lead]) & (pos == pos[lead])  # a repeated row is its own lead
        h = np.where(new, h, _mixed((did + pos).view(np.uint64)).view(np.int64))
        keep = ~same
        yield from _batches([h[keep], f[keep], did[keep], th[keep], (2 * pos + ~new)[keep]], ["h", "f", "did", "th", "pos"])


def _groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Index ranges of at most twice CHUNK bytes."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > 2 * CHUNK:
            yield lo, i
            lo, total = i, 0
        total += n
    yield lo, len(sizes)


def _batches(columns: list, names: list[str], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), rows):
        yield pa.record_batch([pa.array(c[at:at + rows]) for c in columns], names=names)


REPEAT = "h bigint, did bigint, th bigint, pos bigint, open boolean"


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, f, did, th, pos): occurrences that repeat in full, and open ones: the first of each neighbourhood
    of a bucket that has several. State across batches: the first row of the bucket, while it may be alone, and the lead."""
    tail = None  # (h, f, did, th, pos) of the lead of the last neighbourhood
    first = None  # the first lead of the last bucket if it has not been given out
    bucket = None
    for batch in batches:
        h, f, did, th, at = (batch.column(c).to_numpy() for c in ("h", "f", "did", "th", "pos"))
        done, pos = (at & 1).astype(bool), at >> 1
        if done.any():
            d = np.flatnonzero(done)
            yield from _batches([h[d], did[d], th[d], pos[d], np.zeros(len(d), bool)], REPEAT_NAMES)
        k = np.flatnonzero(~done)
        if not len(k):
            continue
        h, f, did, th, pos = (c[k] for c in (h, f, did, th, pos))
        if tail is not None:
            h, f, did, th, pos = (np.concatenate([[np.int64(t)], c]) for t, c in zip(tail, (h, f, did, th, pos), strict=True))
        n = len(h)
        new = np.ones(n, bool)
        new[1:] = (h[1:] != h[:-1]) | (f[1:] != f[:-1])
        start = np.ones(n, bool)
        start[1:] = h[1:] != h[:-1]
        lead = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        same = (did == did[lead]) & (th == th[lead]) & (pos == pos[lead])
        full = np.flatnonzero(~new & ~same)
        # leads of a bucket with several neighbourhoods are open; whether the last bucket has more is not known yet
        head = np.maximum.accumulate(np.where(start, np.arange(n), 0))
        more = np.zeros(n, bool)
        more[head[np.flatnonzero(new & ~start)]] = True
        opens = new & (~start | more)
        if tail is not None:
            opens[0] = False  # given out with its own batch, or held in ``first``
            if first is not None and h[0] == bucket and more[0]:
                yield _row(first)
                first = None
        o = np.flatnonzero(opens)
        picked = np.concatenate([full, o])
        yield from _batches([h[picked], did[picked], th[picked], pos[picked], np.concatenate([np.zeros(len(full), bool), np.ones(len(o), bool)])], REPEAT_NAMES)
        final = head[-1]
        if final > 0 or tail is None:  # the last bucket began in this batch
            bucket = h[-1]
            first = None if more[final] else (h[final], did[final], th[final], pos[final])
        last = lead[-1]
        tail = (h[last], f[last], did[last], th[last], pos[last])


REPEAT_NAMES = ["h", "did", "th", "pos", "open"]


def _row(row: tuple) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.array([v], np.int64)) for v in row] + [pa.array([True])], names=REPEAT_NAMES)


def _neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every open anchor of a text: the REACH bytes before and after it, padded, and how many of them are real."""
    names = ["h", "did", "th", "pos", "left", "right", "around"]
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for i in range(batch.num_rows):
            data = np.frombuffer(texts[i].as_buffer(), np.uint8)
            found = batch.column("found")[i].values
            pos, h = (found.field(c).to_numpy() for c in ("pos", "h"))
            padded = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(REACH, np.uint8)])
            for at in range(0, len(pos), 20_000):
                p, g = pos[at:at + 20_000], h[at:at + 20_000]
                index = np.concatenate([np.arange(REACH), np.arange(REACH) + REACH + GRAM])
                around = padded[p[:, None] + index]
                left, right = np.minimum(p, REACH), np.minimum(len(data) - p - GRAM, REACH)
                blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * REACH), len(p), [None, pa.py_buffer(around.tobytes())]).cast(pa.binary())
                own = [pa.array(np.full(len(p), batch.column(c)[i].as_py(), np.int64)) for c in ("did", "th")]
                yield pa.record_batch([pa.array(g), *own, pa.array(p), pa.array(left), pa.array(right), blob], names=names)


def cover_ranks(around: np.ndarray, at: int) -> np.ndarray:
    """Rank of the CORE bytes at a cover position among the rows of a block; equal bytes, equal rank."""
    words = np.ascontiguousarray(around[:, at:at + CORE]).view(f"S{CORE}").ravel()
    order = np.argsort(words, kind="stable")
    ordered = words[order]
    rank = np.empty(len(words), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
    return rank


def sort_block(bucket: np.ndarray, around: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For rows in order of bucket and occurrence: bit s is set if the window that starts s bytes into the neighbourhood
    equals that of an earlier row of the bucket."""
    n = len(bucket)
    repeated = np.zeros((n, REACH + 1), bool)
    if n < 2:
        return repeated
    ids = np.cumsum(np.concatenate([[0], (bucket[1:] != bucket[:-1]).astype(np.int64)]))
    cover = [p for p in range(2 * REACH - CORE + 1) if p % MODULUS in COVER]
    ranks: dict[int, np.ndarray] = {}
    for s in range(REACH + 1):
        at = next(p for p in cover if p >= s)
        if at not in ranks:
            ranks = {at: ids * n + cover_ranks(around, at)}
        key = ranks[at]
        live = np.flatnonzero((left >= REACH - s) & (right >= s))
        order = live[np.argsort(key[live], kind="stable")]
        tie = np.zeros(len(order), bool)
        same = key[order][1:] == key[order][:-1]
        tie[1:] |= same
        tie[:-1] |= same
        order = order[tie]  # only ties of bucket and cover rank are looked at further
        if not len(order):
            continue
        rest = np.concatenate([around[order, s:at], around[order, at + CORE:s + REACH]], axis=1)
        rest = np.ascontiguousarray(np.pad(rest, ((0, 0), (0, 16 - rest.shape[1])))).view(np.uint64)
        again = np.lexsort((order, rest[:, 1], rest[:, 0], key[order]))
        order, rest = order[again], rest[again]
        equal = (key[order][1:] == key[order][:-1]) & (rest[1:] == rest[:-1]).all(axis=1)
        repeated[order[1:][equal], s] = True
    return repeated


WINDOWS = "did bigint, th bigint, pos bigint, windows binary"


def _sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets are gathered to blocks of about BLOCK_ROWS rows and sorted; rows arrive in order of bucket and occurrence."""
    held: list[pa.RecordBatch] = []

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        # rows that repeat id and text have brought the same occurrence more than once
        keys = np.stack([table.column(c).to_numpy() for c in ("h", "did", "th", "pos")])
        table = table.filter(pa.array(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])))
        around = np.frombuffer(b"".join(table.column("around").to_pylist()), np.uint8).reshape(-1, 2 * REACH)
        bits = sort_block(*(table.column(c).to_numpy() if c != "around" else around for c in ("h", "around", "left", "right")))
        k = np.flatnonzero(bits.any(axis=1))
        if len(k):
            packed = np.packbits(bits[k], axis=1)
            yield pa.record_batch([pa.array(table.column(c).to_numpy()[k]) for c in ("did", "th", "pos")] + [pa.array([p.tobytes() for p in packed], pa.binary())], names=["did", "th", "pos", "windows"])

    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < BLOCK_ROWS:
            continue
        table = pa.Table.from_batches(held)
        h = table.column("h").to_numpy()
        change = np.flatnonzero(h[1:] != h[:-1])
        if len(change):
            stop = int(change[-1]) + 1
            yield from solve(table.slice(0, stop))
            held, rows = table.slice(stop).to_batches(), table.num_rows - stop
    if rows:
        yield from solve(pa.Table.from_batches(held))


def _hot_windows(opened: DataFrame) -> DataFrame:
    """Buckets too large for a task: every window is a group of its own, whose first occurrence is a partial aggregate."""
    at = F.explode(F.sequence(F.lit(0), F.lit(REACH))).alias("s")
    windows = opened.select("h", "did", "th", "pos", "left", "right", "around", at).filter((F.col("left") >= REACH - F.col("s")) & (F.col("right") >= F.col("s")))
    windows = windows.select("h", "did", "th", "pos", "s", F.expr(f"unhex(sha2(substring(around, s + 1, {REACH}), 256))").alias("w"))
    first = windows.groupBy("h", "s", "w").agg(F.min(F.struct("did", "th", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = windows.join(first, ["h", "s", "w"]).filter(F.struct("did", "th", "pos") != F.col("first"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(8 * ((REACH + 8) // 8) - 1)), lambda i: F.when(F.array_contains("set", i), "1").otherwise("0"))
    packed = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit((REACH + 8) // 8 - 1)), lambda b: F.lpad(F.conv(F.array_join(F.slice(F.col("bits"), b * 8 + 1, 8), ""), 2, 16), 2, "0")), ""))
    marked = later.groupBy("did", "th", "pos").agg(F.collect_set("s").alias("set")).withColumn("bits", bits)
    return marked.select("did", "th", "pos", packed.alias("windows"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covers the bytes of the repeated windows of each text and digests what is left."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        ids = batch.column("doc_id")
        out = []
        for i in range(batch.num_rows):
            raw = texts[i].as_py()
            data, n = np.frombuffer(raw, np.uint8), len(raw)
            found = batch.column("found")[i]
            if n < LENGTH or (not found.is_valid and batch.column("copy")[i].as_py() == 1):
                out.append((n, 0, 0, hashlib.sha256(raw).hexdigest(), raw))
                continue
            change = np.zeros(n + 1, np.int64)
            if batch.column("copy")[i].as_py() > 1:
                change[0] += 1
                change[n] -= 1
            else:
                pos = found.values.field("pos").to_numpy()
                bits = found.values.field("windows")
                whole_ones = bits.is_null().to_numpy(zero_copy_only=False)
                p = pos[whole_ones]
                np.add.at(change, np.maximum(p - REACH, 0), 1)
                np.add.at(change, np.minimum(p, n - LENGTH) + LENGTH, -1)
                if not whole_ones.all():
                    some = np.unpackbits(np.frombuffer(b"".join(b for b in bits.to_pylist() if b is not None), np.uint8).reshape(-1, (REACH + 8) // 8), axis=1)
                    row, s = np.nonzero(some[:, :REACH + 1])
                    start = pos[~whole_ones][row] - REACH + s
                    np.add.at(change, start, 1)
                    np.add.at(change, start + LENGTH, -1)
            gone = np.cumsum(change[:n]) > 0
            edges = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
            kept = data[~gone].tobytes()
            out.append((n, int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.record_batch([ids, *[pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]], names=names)


def repeated_windows(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(did, th, pos, windows) of anchors around which windows repeat an earlier one; null windows mean all of them."""
    texts = docs.select("did", "th", "text")
    order = ["h", "f", "did", "th", "pos"]
    scanned = texts.mapInArrow(_scan, ANCHOR).repartition("h").sortWithinPartitions(*order)
    repeats = stored(scanned.mapInArrow(_repeats, REPEAT))
    opened = repeats.filter("open").groupBy("did", "th").agg(F.collect_list(F.struct("pos", "h")).alias("found"))
    near = texts.join(opened, ["did", "th"]).select("did", "th", "text", "found")
    near = near.mapInArrow(_neighbourhoods, "h bigint, did bigint, th bigint, pos bigint, left bigint, right bigint, around binary")
    hot = repeats.filter("open").groupBy("h").count().filter(F.col("count") > hot_rows).select("h")
    if hot.isEmpty():
        large = None
    else:
        near = stored(near)
        large, near = near.join(hot, "h", "left_semi"), near.join(hot, "h", "left_anti")
    found = near.repartition("h").sortWithinPartitions("h", "did", "th", "pos").mapInArrow(_sorted_buckets, WINDOWS)
    if large is not None:
        found = found.union(_hot_windows(large.distinct()))
    full = repeats.filter("not open").select("did", "th", "pos", F.lit(None).cast("binary").alias("windows"))
    return stored(found.union(full))


def remove_repeats(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every row with its bytes left: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary).

    A byte goes if a 100-byte string that covers it also starts earlier: in a smaller doc_id, or earlier in the same document.
    Null texts count as empty; null ids come last; rows that share an id are ordered by a digest of the text, and of rows that
    repeat id and text all but one lose everything (texts under 100 bytes stay). Empty in, empty out.
    """
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(ID_LAST)).alias("did"), F.xxhash64(whole()).alias("th"), whole().alias("text"))
    windows = repeated_windows(keyed, hot_rows).groupBy("did", "th").agg(F.collect_list(F.struct("pos", "windows")).alias("found"))
    joined = keyed.join(windows, ["did", "th"], "left")
    nth = F.row_number().over(Window.partitionBy("did", "th").orderBy("did"))
    rows = joined.withColumn("copy", nth).select("doc_id", "text", "found", "copy")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_remove, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
