"""SimHash near-duplicates: byte-position inverted index, count filtering, verification, components.

Two fingerprints with at most 3 differing bits differ in at most 3 of their 8 bytes, so they share at least 5 positional
bytes. A posting list for one positional byte holds 1/256 of all fingerprints, whose pairs grow with the square of the
corpus; the index therefore keys its lists by four positional bytes at once. The 14 planes of the 3-dimensional space over
two elements are 14 sets of four of the eight positions such that any five positions contain one of them (exactly one), so
every pair that shares five bytes meets in a list. The pairs of a list are tallied on all eight bytes; those that reach five
are verified bit by bit. A list gives a spanning forest of its links instead of all its pairs.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import components, free_name, id_key, stored, whole

BITS, MAX_BITS, MIN_BYTES = 64, 3, 5
PLANES = [[p for p in range(8) if bin(p & a).count("1") % 2 == c] for a in range(1, 8) for c in (0, 1)]


def lists_for(min_bytes: int) -> list:
    """Sets of positions that key the posting lists: any ``min_bytes`` positions contain one of them."""
    return PLANES if min_bytes >= MIN_BYTES else [list(c) for c in combinations(range(8), min_bytes)]


BLOCK = 2048
CHUNK = 1 << 16
BRANCHES = 256  # texts of one fingerprint are linked over so many of them


def simhash(text: str, width: int) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is set in over half of the hashes of the word shingles."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(*[words[i:] for i in range(width)])), len(words) - width + 1
    ones, left = np.zeros(BITS, np.int64), n
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(42))
    while left:
        take = min(CHUNK, left)
        block = np.fromiter(hashes, np.dtype("<u8"), count=take)
        ones += np.unpackbits(block.view(np.uint8).reshape(take, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        left -= take
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, width: int) -> Column:
    @F.pandas_udf("bigint")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, width) for t in texts], dtype="int64")

    return hashed(text)


def _forest(a: np.ndarray, b: np.ndarray, max_bits: int, min_bytes: int) -> Iterator[tuple[int, int]]:
    """Spanning forest of the links between two sorted blocks (or within one), found row by row with a union-find."""
    same = a is b
    values = a if same else np.concatenate([a, b])
    root = list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    shift = 0 if same else len(a)
    for i, v in enumerate(a):
        rest = a[i + 1:] if same else b
        x = rest ^ v
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        near = np.flatnonzero(shared >= min_bytes)  # tally of positional bytes, then the bits
        near = near[np.bitwise_count(x[near]) <= max_bits]
        for j in near:
            k = int(j) + (i + 1 if same else shift)
            p, q = find(i), find(k)
            if p != q:
                root[max(p, q)] = min(p, q)
                yield int(v), int(values[k])


def _links(forest: Callable, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by (plane, bytes, left, right); a block pair is complete when its key changes. Memory: two blocks."""
    key, held = None, []

    def flush() -> list:
        left = np.unique(np.array([f for f, s in held if s != 2], np.int64).view(np.uint64))
        right = np.unique(np.array([f for f, s in held if s == 2], np.int64).view(np.uint64))
        return list(forest(left, right) if len(right) else forest(left, left))

    out: list = []
    for batch in batches:
        for plane, part, left, right, side, fp in zip(*(batch[c] for c in ("plane", "part", "left", "right", "side", "fp")), strict=True):
            if (plane, part, left, right) != key:
                if len(held) > 1:
                    out += flush()
                key, held = (plane, part, left, right), []
            held.append((fp, side))
        if len(out) >= 10_000:
            yield _edges(out)
            out = []
    if len(held) > 1:
        out += flush()
    yield _edges(out)


def _edges(pairs: list) -> pd.DataFrame:
    values = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": values[:, 0], "b": values[:, 1]})


def _dealt(prints: DataFrame, at: str, min_bytes: int, block: int) -> DataFrame:
    """Rows of the posting lists of more than one row, keyed by bytes of the fingerprint in column ``at``, with all columns of ``prints``.

    They are sorted by (plane, part, left, right): the list and two blocks of it, dealt by a hash of ``fp``.
    """
    masks = [(i, sum(0xFF << (8 * p) for p in positions)) for i, positions in enumerate(lists_for(min_bytes))]
    signed = [(i, m - (1 << 64) if m >> 63 else m) for i, m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("plane"), F.col(at).bitwiseAND(F.lit(m)).alias("part")) for i, m in signed])
    posted = prints.select(*prints.columns, F.explode(keys).alias("k")).select(*prints.columns, "k.plane", "k.part")
    lists = posted.groupBy("plane", "part").agg(F.count("*").alias("n")).filter("n > 1")
    lists = lists.select("plane", "part", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = posted.join(lists, ["plane", "part"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # a row meets its own block once and every other block in one pair, on the side of the smaller or larger number
    rows = rows.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("plane", "part", F.least("own", "mate").alias("left"), F.greatest("own", "mate").alias("right"),
                       F.when(F.col("own") > F.col("mate"), 2).otherwise(1).alias("side"), *prints.columns)
    work = ["plane", "part", "left", "right"]
    return rows.repartition(*work).sortWithinPartitions(*work)


def links(prints: DataFrame, max_bits: int = MAX_BITS, min_bytes: int = MIN_BYTES, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose components are those of all links: pairs that share at least
    ``min_bytes`` positional bytes and differ in at most ``max_bits`` bits. Up to 8 - min_bytes bits the first follows from the second;
    a wider radius loses pairs, which is warned of.

    Lists of one fingerprint are dropped before any pair is looked at. A list longer than ``block`` is cut into blocks, and
    every pair of its blocks is a piece of work of its own.
    """
    if max_bits > 8 - min_bytes:
        warnings.warn(f"pairs that differ in {9 - min_bytes} to {max_bits} bits are only found if they share {min_bytes} bytes", stacklevel=2)
    rows = _dealt(prints, "fp", min_bytes, block)
    return rows.mapInPandas(partial(_links, partial(_forest, max_bits=max_bits, min_bytes=min_bytes)), "a bigint, b bigint")


def text_links(texts: DataFrame, width: int = 5, max_bits: int = MAX_BITS, min_bytes: int = MIN_BYTES, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of keys ``fp`` of texts whose components are those of the texts under the links between their fingerprints.

    Texts of one fingerprint form a tree of two levels, so the pairs of a key stay few even where many texts share a fingerprint.
    """
    prints = stored(texts.select("fp", fingerprint(F.col("text"), width).alias("print")).withColumn("branch", F.pmod(F.xxhash64("fp"), F.lit(BRANCHES))))
    branches = prints.groupBy("print", "branch").agg(F.min("fp").alias("a"))
    tops = stored(branches.groupBy("print").agg(F.min("a").alias("top")))
    low, high = (tops.select(F.col("print").alias(c), F.col("top").alias(f"top_{c}")) for c in "ab")
    apart = links(tops.select(F.col("print").alias("fp")), max_bits, min_bytes, block).distinct().join(low, "a").join(high, "b").select("top_a", "top_b")
    equal = prints.join(branches, ["print", "branch"]).select("a", F.col("fp").alias("b"))
    equal = equal.union(branches.join(tops, "print").select("top", "a"))
    pairs = equal.union(apart).filter("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _unlinked(batches: Iterator[pd.DataFrame], max_bits: int, min_bytes: int) -> Iterator[pd.DataFrame]:
    """All pairs of a list (or of two blocks of it) that lie near each other and have different roots. Memory: two blocks."""
    key, held, out = None, [], []

    def flush() -> Iterator[pd.DataFrame]:
        fp, prints, root, side = (np.array(v) for v in zip(*held))
        prints, two = prints.view(np.uint64), bool((side == 2).any())
        for i in range(len(fp) - 1):
            x = prints[i + 1:] ^ prints[i]
            near = ((x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= min_bytes) & (np.bitwise_count(x) <= max_bits) & (root[i + 1:] != root[i])
            if two:
                near &= side[i + 1:] != side[i]
            other = fp[i + 1:][near]
            if len(other):
                out.append(pd.DataFrame({"a": np.minimum(other, fp[i]), "b": np.maximum(other, fp[i])}))
            if sum(map(len, out)) >= 10_000 or len(out) >= 1_000:
                yield pd.concat(out)
                out.clear()

    for batch in batches:
        for plane, part, left, right, *row in zip(*(batch[c] for c in ("plane", "part", "left", "right", "fp", "print", "root", "side")), strict=True):
            if (plane, part, left, right) != key:
                if len(held) > 1:
                    yield from flush()
                key, held = (plane, part, left, right), []
            held.append(tuple(row))
    if len(held) > 1:
        yield from flush()
    if out:
        yield pd.concat(out)


def text_pairs(texts: DataFrame, width: int = 5, max_bits: int = MAX_BITS, min_bytes: int = MIN_BYTES, block: int = BLOCK) -> DataFrame:
    """All pairs (a, b) of keys ``fp`` of different texts whose fingerprints link and whose ``root`` differs, none left out.

    ``text_links`` gives a tree of each class. Where a further test turns down links of the tree, these are the pairs still to be tested.
    """
    prints = stored(texts.select("fp", "root", fingerprint(F.col("text"), width).alias("print")))
    return _dealt(prints, "print", min_bytes, block).mapInPandas(partial(_unlinked, max_bits=max_bits, min_bytes=min_bytes), "a bigint, b bigint").distinct()


def rooted(prints: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds to (doc_id, fp) the component over the edges between the nodes (fp, its smallest id ``low``): ``root``, its smallest node, and
    ``component_id``, its smallest id."""
    roots = components(edges)
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    names = placed.select("fp", "root").join(named, "root")
    return prints.join(names, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = 5, max_bits: int = MAX_BITS, min_bytes: int = MIN_BYTES, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest id that can be reached over links between fingerprints).

    Null texts count as empty; texts without words have fingerprint 0 and link like any other. Null ids are reached but never
    name a component unless it has no other id. Repeated rows are repeated in the result. Empty in, empty out.
    """
    return _found(docs, width, max_bits, min_bytes, block).drop("root")


def _found(docs: DataFrame, width: int, max_bits: int, min_bytes: int, block: int) -> DataFrame:
    prints = stored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), fingerprint(whole(), width).alias("fp")))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    return rooted(prints, nodes, links(nodes.select("fp"), max_bits, min_bytes, block))


def keep_one(docs: DataFrame, width: int = 5, max_bits: int = MAX_BITS, min_bytes: int = MIN_BYTES, block: int = BLOCK) -> DataFrame:
    """The document with the smallest id of each component, with all its columns.

    Components without any id keep one row, and so do rows that repeat that id: the first by fingerprint and other columns.
    """
    return lowest(docs, _found(docs, width, max_bits, min_bytes, block), fingerprint(whole(), width))


def lowest(docs: DataFrame, found: DataFrame, print_of: Column) -> DataFrame:
    """One row of ``docs`` for each component (``root``) in ``found``: that of its smallest id, with a text of the component (``print_of`` is
    ``fp`` there). An id that comes again with a text of another component, and a null id, stands for each of them."""
    key, fp, nth = (free_name(docs, c) for c in ("_id_key", "_fp", "_nth"))
    own = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = stored(own.groupBy("root").agg(F.min(F.struct(id_key(F.col("doc_id")).alias("id"), "fp")).alias("k")).select(F.col("k.id").alias(key), F.col("k.fp").alias(fp)))
    first = Window.partitionBy(key, fp).orderBy(*[F.col(f"`{c}`").cast("string") for c in docs.columns if c != "text"], F.xxhash64(whole()))
    rows = docs.withColumn(key, id_key(F.col("doc_id"))).join(kept.select(key).distinct(), key, "left_semi")
    rows = rows.withColumn(fp, print_of).join(kept, [key, fp], "left_semi")
    return rows.withColumn(nth, F.row_number().over(first)).filter(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
