"""Near-duplicates by the Jaccard share of word shingles: prefix lists find every pair, texts verify it.

Two sets that share 4/5 of their union share at least ceil(4/5 n) elements of either, so under any order that all sets agree
on their first n - ceil(4/5 n) + 1 elements meet. The lists of these elements therefore hold every pair of the wanted
share, whatever their fingerprints. The order puts shingles that are frequent in a sample of the documents last, which
keeps lists short; it decides about work only, never about pairs. Within a list pairs are passed over only if their sizes or
the parities of their shingles in 512 buckets (which differ in no more buckets than the sets differ in elements) rule the share
out, or if verified links connect them already. What is left is verified on the shingles of both texts. Pairs that another index
proposes (``simhash.text_links``) are verified first, and where one is turned down, all pairs of its class by that index
(``simhash.text_pairs``); the lists then look only for what they leave unconnected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import components, cut, stored, whole
from .simhash import lowest, rooted

WIDTH = 5
SHARE = (4, 5)
BUCKETS = 512
BLOCK = 2048
FIRST = 16  # pairs of a row within a list in the first round; the second takes all others that are not connected by then
SAMPLE = 16  # one of so many documents is counted for the order of the shingles
FREQUENT, MOST_FREQUENT = 4, 200_000


def shingles(text: str, width: int) -> set:
    """The distinct word shingles; a text of fewer words is one shingle, a text without words the empty one."""
    words = text.encode().lower().split()
    if len(words) < width:
        return {b" ".join(words)}
    return set(map(b" ".join, zip(*[words[i:] for i in range(width)])))


def _hashes(text: str, width: int) -> np.ndarray:
    import xxhash

    found = shingles(text, width)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(42)), np.dtype("<u8"), count=len(found)))


def _sampled(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for text in batch["text"]:
            yield pd.DataFrame({"h": _hashes(text, width).view(np.int64)})


def _folded(wide: np.ndarray, size: int) -> np.ndarray:
    """Parities of fewer buckets from those of more."""
    return np.bitwise_xor.reduce(wide.reshape(-1, size), axis=0)


def _sets(batches: Iterator[pd.DataFrame], width: int, share: tuple[int, int], late: np.ndarray) -> Iterator[pd.DataFrame]:
    """Size, bucket parities and prefix of every text."""
    for batch in batches:
        rows = []
        for text in batch["text"]:
            h = _hashes(text, width)
            many = BUCKETS << max(0, (len(h) - 1).bit_length() - BUCKETS.bit_length() + 1)  # a power of two, at least the size
            odd = np.bincount((h % np.uint64(many)).astype(np.int64), minlength=many) & 1
            wide = np.packbits(odd.astype(np.uint8))
            after = np.isin(h, late, assume_unique=True)
            take = len(h) + share[0] * len(h) // -share[1] + 1
            first = np.concatenate([h[~after], h[after]])[:take]
            rows.append((len(h), _folded(wide, BUCKETS // 8).tobytes(), wide.tobytes(), first.view(np.int64)))
        n, parity, wide, prefix = zip(*rows) if rows else ((), (), (), ())
        yield pd.DataFrame({"fp": batch["fp"], "n": np.array(n, np.int32), "parity": list(parity), "wide": list(wide), "prefix": list(prefix)})


def _pairs(rows: list, share: tuple[int, int], lo: int, hi: int | None) -> Iterator[tuple[int, int]]:
    """Pairs of a list (or of two blocks of it) that may reach the share, for each row those with numbers lo to hi; pairs with
    one root get their number too but are left out, so both rounds number alike."""
    fp, n, parity, root, side = zip(*sorted({r[0]: r for r in rows}.values(), key=lambda r: (r[1], r[0])))
    size, top, side = np.array(n, np.int64), np.array(root, np.int64), np.array(side)
    bits = np.frombuffer(b"".join(parity), np.uint64).reshape(len(fp), -1)
    two = bool((side == 2).any())
    least = np.searchsorted(size * share[1], size * share[0], side="left")  # the smaller set has at least the share of the larger
    for i in range(1, len(fp)):
        j = least[i]
        if j >= i:
            continue
        # |a - b| + |b - a| <= (1 - share) / (1 + share) * (|a| + |b|)
        apart = np.bitwise_count(bits[j:i] ^ bits[i]).sum(axis=1, dtype=np.int64)
        fits = apart * (share[1] + share[0]) <= (size[j:i] + size[i]) * (share[1] - share[0])
        if two:
            fits &= side[j:i] != side[i]
        near = np.flatnonzero(fits)[lo:hi] + j
        for k in near[top[near] != top[i]]:
            yield fp[k], fp[i]


def _candidates(batches: Iterator[pd.DataFrame], share: tuple[int, int], lo: int, hi: int | None) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by (part, left, right); memory: two blocks of a list and the pairs of one row of blocks."""
    key, held, out = None, [], []

    def made(pairs: list) -> pd.DataFrame:
        p = np.array(pairs, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": p.min(axis=1), "b": p.max(axis=1)})

    def flush() -> Iterator[pd.DataFrame]:
        if len(held) > 1:
            for pair in _pairs(held, share, lo, hi):
                out.append(pair)
                if len(out) >= 10_000:
                    yield made(out)
                    out.clear()

    for batch in batches:
        for part, left, right, *row in zip(*(batch[c] for c in ("part", "left", "right", "fp", "n", "parity", "root", "side")), strict=True):
            if (part, left, right) != key:
                yield from flush()
                key, held = (part, left, right), []
            held.append(tuple(row))
    yield from flush()
    if out:
        yield made(out)


def _likely(batches: Iterator[pd.DataFrame], share: tuple[int, int]) -> Iterator[pd.DataFrame]:
    """Pairs that parities in as many buckets as shingles do not rule out either; few unlike pairs get past it, so few texts are moved."""
    for batch in batches:
        keep = []
        for n, x, y in zip(batch["n_a"] + batch["n_b"], batch["wide_a"], batch["wide_b"]):
            size = min(len(x), len(y))
            x, y = (_folded(np.frombuffer(v, np.uint8), size) for v in (x, y))
            keep.append(int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) * (share[1] + share[0]) <= n * (share[1] - share[0]))
        yield batch.loc[keep, ["a", "b"]]


def _verified(batches: Iterator[pd.DataFrame], width: int, share: tuple[int, int]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep, last, known = [], None, set()
        for a, ta, tb in zip(batch["a"], batch["text_a"], batch["text_b"]):
            if a != last:
                last, known = a, shingles(ta, width)
            other = shingles(tb, width)
            both = len(known & other)
            keep.append(both * share[1] >= (len(known) + len(other) - both) * share[0])
        yield batch.loc[keep, ["a", "b"]]


def _checked(texts: DataFrame, pairs: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """Those of the stored pairs (a, b) whose texts share enough."""
    ends = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
    needed = stored(texts.select("fp", "text").join(ends, "fp", "left_semi").dropDuplicates(["fp"]))
    known_a, known_b = (needed.select(F.col("fp").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    checked = pairs.join(known_b, "b").join(known_a, "a").select("a", "b", "text_a", "text_b")
    return cut(checked.mapInPandas(partial(_verified, width=width, share=share), "a bigint, b bigint"))


def _broken(texts: DataFrame, proposed: DataFrame, edges: DataFrame) -> DataFrame:
    """Texts (fp, text) of the classes by the proposed pairs that the verified edges cut in parts, with the part (``root``)."""
    placed = components(proposed).select(F.col("node").alias("fp"), F.col("root").alias("class"))
    placed = placed.join(components(edges).select(F.col("node").alias("fp"), F.col("root").alias("_root")), "fp", "left").select("fp", "class", F.coalesce("_root", "fp").alias("root"))
    cut_up = placed.groupBy("class").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("class")
    return texts.select("fp", "text").join(placed.join(cut_up, "class").select("fp", "root"), "fp").dropDuplicates(["fp"])


def links(texts: DataFrame, width: int = WIDTH, share: tuple[int, int] = SHARE, block: int = BLOCK, first: int = FIRST,
          proposed: DataFrame | None = None, rest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Edges (a, b) between the keys ``fp`` of different texts whose components are those of all pairs that share at least
    ``share`` (numerator and denominator) of their shingles.

    A list of more than ``block`` texts is cut into blocks, and every pair of its blocks is a piece of work of its own.
    ``proposed`` pairs (a, b) of keys become links first if their texts share enough. They may be the trees of larger classes: ``rest``
    makes all pairs of texts (fp, text, root) with different roots, of the classes whose trees did not hold.
    """
    spark = texts.sparkSession
    sample = texts.filter(F.pmod("fp", F.lit(SAMPLE)) == 0).select("text").mapInPandas(partial(_sampled, width=width), "h bigint")
    often = sample.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT)
    late = np.array([r["h"] for r in often.collect()], np.int64).view(np.uint64)
    sets = stored(texts.select("fp", "text").mapInPandas(partial(_sets, width=width, share=share, late=late), "fp bigint, n int, parity binary, wide binary, prefix array<bigint>"))
    posted = sets.select("fp", F.explode("prefix").alias("part"))
    lists = posted.groupBy("part").agg(F.count("*").alias("n")).filter("n > 1").select("part", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = posted.join(lists, "part").join(sets.select("fp", "n", "parity").dropDuplicates(["fp"]), "fp")
    rows = stored(rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")))
    work, edges = ["part", "left", "right"], None
    if proposed is not None:
        proposed = stored(proposed)
        edges = _checked(texts, proposed, width, share)
        if rest:
            edges = edges.union(_checked(texts, stored(rest(_broken(texts, proposed, edges))), width, share))
    for lo, hi in ((0, first), (first, None)):
        if edges is None:
            known = rows.withColumn("root", F.col("fp"))
        else:
            known = rows.join(components(edges).withColumnRenamed("root", "_root"), F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("_root", "fp"))
        met = known.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = met.select("part", F.least("own", "mate").alias("left"), F.greatest("own", "mate").alias("right"),
                         F.when(F.col("own") > F.col("mate"), 2).otherwise(1).alias("side"), "fp", "n", "parity", "root")
        found = met.repartition(*work).sortWithinPartitions(*work).mapInPandas(partial(_candidates, share=share, lo=lo, hi=hi), "a bigint, b bigint")
        wide_a, wide_b = (sets.select(F.col("fp").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}")).dropDuplicates([c]) for c in "ab")
        likely = found.distinct().join(wide_b, "b").join(wide_a, "a").mapInPandas(partial(_likely, share=share), "a bigint, b bigint")
        pairs = stored(likely)
        linked = _checked(texts, pairs, width, share)
        edges = linked if edges is None else edges.union(linked)
    return edges


def near_duplicates(docs: DataFrame, width: int = WIDTH, share: tuple[int, int] = SHARE, block: int = BLOCK, first: int = FIRST,
                    propose: Callable[[DataFrame], DataFrame] | None = None, rest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per document: doc_id, fp (key of its text), component_id (smallest id that can be reached over verified links).

    Null texts count as empty. Null ids are reached but never name a component unless it has no other id. Repeated rows are
    repeated in the result. Empty in, empty out. ``propose`` makes pairs (a, b) to verify first from texts (fp, text), ``rest`` those
    to verify where these are turned down (``links``).
    """
    return _found(docs, width, share, block, first, propose, rest).drop("root")


def _found(docs: DataFrame, width: int, share: tuple[int, int], block: int, first: int, propose: Callable | None, rest: Callable | None) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(whole()).alias("fp"), whole().alias("text"))
    prints = stored(texts.select("doc_id", "fp"))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    proposed = propose(texts.select("fp", "text")) if propose else None
    return rooted(prints, nodes, links(texts, width, share, block, first, proposed, rest))


def keep_one(docs: DataFrame, width: int = WIDTH, share: tuple[int, int] = SHARE, block: int = BLOCK, first: int = FIRST,
             propose: Callable[[DataFrame], DataFrame] | None = None, rest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The document with the smallest id of each component, with all its columns, as in ``simhash.keep_one``."""
    return lowest(docs, _found(docs, width, share, block, first, propose, rest), F.xxhash64(whole()))
