"""Runs of words that repeat with a period, found by block convolution at dyadic scales.

A run of period p and length of 2p words or more holds, within its first period, a whole block of b <= (p + 1) / 2 words that
starts at a multiple of b, and that block stands again p words on. So at the scale of b all blocks are laid over the words that
follow them at 2b to 4b - 1 words' distance (the smallest scale, b = 2, takes 1 to 7). With words as numbers, the sum of squared
differences of block and window at a distance is a convolution, computed for all distances of a block at once by a
number-theoretic transform; where it is zero, the distance is a seed. A seed is compared word by word and extended both ways to
the longest stretch of that period. Sums are exact modulo a prime: no repeat is missed, and a sum that is zero only
modulo the prime does not survive the comparison.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import WORD, whole

LEAST = 12  # words of the shortest run
PRIME, ROOT = 998244353, 3  # 119 * 2**23 + 1 and a generator
MOST_BLOCK = 1 << 17  # words; longer periods keep this block and take more windows, so a pass has bounded memory
SLAB = 1 << 19  # words of short texts that are searched together; longer texts are searched alone
CELLS = 1 << 20  # numbers per transform pass
LOOKS = 8  # words of a block that are looked up before it is transformed


@lru_cache(maxsize=64)
def _twiddles(size: int, inverse: bool) -> np.ndarray:
    """Powers 0 to size/2 - 1 of a size-th root of one."""
    w = pow(ROOT, (PRIME - 1) // size, PRIME)
    if inverse:
        w = pow(w, PRIME - 2, PRIME)
    out = np.ones(max(size // 2, 1), np.uint64)
    done = 1
    while done < len(out):
        out[done:2 * done] = out[:done] * np.uint64(pow(w, done, PRIME)) % np.uint64(PRIME)
        done *= 2
    return out


def ntt(rows: np.ndarray) -> np.ndarray:
    """Transform of every row (their length a power of two), in bit-reversed order."""
    n, p = rows.shape[1], np.uint64(PRIME)
    a, half = rows, n // 2
    while half:
        b = a.reshape(len(rows), -1, 2, half)
        low, high = b[:, :, 0], b[:, :, 1]
        out = np.empty_like(b)
        np.remainder(low + high, p, out=out[:, :, 0])
        np.remainder((low + p - high) * _twiddles(2 * half, False), p, out=out[:, :, 1])
        a, half = out.reshape(len(rows), n), half // 2
    return a


def intt(rows: np.ndarray) -> np.ndarray:
    """The inverse of ``ntt``: from bit-reversed order back."""
    n, p = rows.shape[1], np.uint64(PRIME)
    a, half = rows, 1
    while half < n:
        b = a.reshape(len(rows), -1, 2, half)
        low, high = b[:, :, 0], b[:, :, 1] * _twiddles(2 * half, True) % p
        out = np.empty_like(b)
        np.remainder(low + high, p, out=out[:, :, 0])
        np.remainder(low + p - high, p, out=out[:, :, 1])
        a, half = out.reshape(len(rows), n), half * 2
    return a * np.uint64(pow(n, PRIME - 2, PRIME)) % p


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences, modulo the prime, of every block with its window at every distance 0 to w - b."""
    b, w, p = blocks.shape[1], windows.shape[1], np.uint64(PRIME)
    size = 1 << (w - 1).bit_length()
    turned = np.zeros((len(blocks), size), np.uint64)
    turned[:, 0] = blocks[:, 0]
    turned[:, size - b + 1:] = blocks[:, :0:-1]  # index -i holds word i
    padded = np.zeros((len(blocks), size), np.uint64)
    padded[:, :w] = windows
    cross = intt(ntt(turned) * ntt(padded) % p)[:, :w - b + 1]
    squares = np.concatenate([np.zeros((len(blocks), 1), np.uint64), np.cumsum(windows * windows % p, axis=1)], axis=1)
    own = (blocks * blocks % p).sum(axis=1, dtype=np.uint64)[:, None]
    return (own + squares[:, b:] - squares[:, :w - b + 1] + (p - cross) * np.uint64(2)) % p


def scales(most: int) -> Iterator[tuple[int, int, int]]:
    """(block size, least distance, distances) that cover every period up to ``most``; blocks stop growing at ``MOST_BLOCK``."""
    b, low, count = 2, 1, 7
    while low <= most:
        yield b, low, count
        low += count
        b = min(2 * b, MOST_BLOCK)
        count = 2 * b


def seeds(ids: np.ndarray, most: int, settled: Callable[[np.ndarray, int, int], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(block starts, distances, block size) of all blocks that stand again at a distance of their scale; by rising scale,
    then by start, then by distance.

    A block is passed over without a transform if one of its first words does not come again at any distance of the scale, or if
    all its distances are ``settled`` (block starts, block size, words up to the end of the window).
    """
    n = len(ids)
    keys = np.append(np.sort(ids * n + np.arange(n)), np.iinfo(np.int64).max)

    def again(at: np.ndarray, low: int, count: int) -> np.ndarray:
        """Whether the word at a place comes again, from ``low`` to before ``low + count`` words on."""
        least = ids[at] * n + np.minimum(at + low, n)
        return keys[np.searchsorted(keys, least)] < ids[at] * n + np.minimum(at + low + count, n)

    values = (ids % PRIME).astype(np.uint64)
    for b, low, count in scales(most):
        starts = np.arange(0, n - b - low + 1, b)
        looks = min(b, LOOKS)
        for i in range(looks):
            place = starts + i * (b - 1) // (looks - 1)
            starts = starts[again(place, low, count)]
        starts = starts[~settled(starts, b, low + count - 1 + b)]
        width = count + b - 1
        each = max(1, CELLS // (4 * b))
        padded = np.concatenate([values, np.zeros(width + low, np.uint64)]) if len(starts) else values
        for i in range(0, len(starts), each):
            s = starts[i:i + each]
            zero = squared_differences(padded[s[:, None] + np.arange(b)], padded[s[:, None] + np.arange(low, low + width)]) == 0
            row, lag = np.nonzero(zero)
            real = s[row] + lag + low + b <= n
            yield s[row][real], (lag + low)[real], b


def _match_right(ids: np.ndarray, i: int, j: int) -> int:
    """How many words from i and j on (i < j) are equal."""
    done, step, n = 0, 32, len(ids) - j
    while done < n:
        take = min(step, n - done)
        diff = ids[i + done:i + done + take] != ids[j + done:j + done + take]
        if diff.any():
            return done + int(diff.argmax())
        done, step = done + take, step * 2
    return done


def _match_left(ids: np.ndarray, i: int, j: int) -> int:
    """How many words up to before i and j (i < j) are equal."""
    done, step = 0, 32
    while done < i:
        take = min(step, i - done)
        diff = (ids[i - done - take:i - done] != ids[j - done - take:j - done])[::-1]
        if diff.any():
            return done + int(diff.argmax())
        done, step = done + take, step * 2
    return done


def runs(ids: np.ndarray, most: int | None = None, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All (start, length, period) of the runs of a sequence of word numbers, by start, then period.

    Equal words have equal numbers below 2**31. Scales rise, so a stretch of a multiple of a run's period lies in a run that is
    known already: seeds inside a run at a multiple of its period are passed over together.
    """
    n = len(ids)
    if n < least:
        return []
    ids = ids.astype(np.int64)
    known: dict[tuple[int, int], int] = {}

    def within(at: np.ndarray, size: np.ndarray | int, fits: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Whether the stretch lies in a run whose period fits; asked of the two runs that start last at or before it."""
        out = np.zeros(len(at), bool)
        if known and len(at):
            spans = np.array([(x, y, p) for (x, y), p in sorted(known.items())], np.int64)
            spot = np.searchsorted(spans[:, 0], at, side="right") - 1
            for back in range(2):
                _, stop, period = spans[np.maximum(spot - back, 0)].T
                out |= (spot >= back) & (at + size <= stop) & fits(period)
        return out

    def settled(at: np.ndarray, b: int, size: int) -> np.ndarray:
        # a block that holds a whole period meets itself at multiples of the period only, all of them in the run
        return within(at, size, lambda period: period <= b)

    for at, distance, b in seeds(ids, n // 2 if most is None else most, settled):
        inside = within(at, distance + b, lambda period: distance % period == 0)
        at, distance = at[~inside], distance[~inside]
        begin = end = 0
        period, compared = 1, {}  # the run found last; by distance, how far its stretches have been extended
        for s, d in zip(at.tolist(), distance.tolist()):
            if begin <= s and s + d + b <= end and d % period == 0 or s + d + b <= compared.get(d, 0):
                continue
            right = _match_right(ids, s, s + d)
            if right < b:
                continue  # zero modulo the prime only
            first, stop = s - _match_left(ids, s, s + d), s + d + right
            compared[d] = stop
            if stop - first >= max(least, 2 * d):
                begin, end, period = first, stop, min(d, known.get((first, stop), d))
                known[first, stop] = period
    return sorted((x, y - x, p) for (x, y), p in known.items())


def _found(texts: list[list[bytes]], least: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each of a few texts, searched as one sequence in which texts have no word in common."""
    ids, offsets = [], [0]
    words = 0
    for text in texts:
        own = dict(zip(dict.fromkeys(text), range(words, words + len(text))))
        ids.extend(map(own.__getitem__, text))
        words += len(own)
        offsets.append(len(ids))
    longest = max(map(len, texts), default=0)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in runs(np.array(ids, np.int64), longest // 2, least):
        at = bisect_right(offsets, start) - 1
        out[at].append((start - offsets[at], length, period))
    return out


def _collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> str:
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period:start + length] = False
    return b" ".join(compress(words, keep) if found else words).decode()


def _batches(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows, held, size = [], [], 0

        def searched() -> None:
            for words, found in zip(held, _found(held, least)):
                rows.append((len(words), [dict(zip(("start", "length", "period"), r)) for r in found], _collapsed(words, found)))
            held.clear()

        for text in batch["text"]:
            held.append(text.encode().split())
            size += len(held[-1])
            if size >= SLAB:
                searched()
                size = 0
        searched()
        n, found, text = zip(*rows) if rows else ((), (), ())
        yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": np.array(n, np.int64), "runs": list(found), "collapsed": list(text)})


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, n_words, runs (array of start, length, period by start, then period), collapsed.

    A run is a stretch of words with smallest period q and at least max(``least``, 2q) words that no neighbour extends.
    collapsed holds the words that no run repeats, that is all but those after the first q of a run, joined by one space.
    Words are runs of characters other than ASCII white space. A null or empty text has no words, no runs and an empty
    text. Rows are independent: repeated rows give repeated results, null ids stay, extra columns are dropped. Empty in, empty out.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole().alias("text"))
    return rows.mapInPandas(partial(_batches, least=least), "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a period of words planted in one of ten documents as the digest of its id says.

    With h the CRC-32 of the decimal id: if h ends in 0, the n words from a = (h / 10) mod n on repeat the p = 1 + (n - a) / (3 + (h / 10) mod 8)
    words that start there; the words are then joined by one space. A null id plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("bigint").cast("string"))
    words, n = F.col("_words"), F.size("_words").cast("bigint")
    drawn = F.floor(h / 10).cast("bigint")
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole().alias("text"), drawn.alias("_g"), (F.coalesce(h % 10, F.lit(1)) == 0).alias("_plant"))
    split = chosen.withColumn("_words", F.when(F.col("_plant"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    placed = split.withColumn("_a", F.when(n > 0, F.col("_g") % n))
    placed = placed.withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(words, place(i).cast("int"))), " ")
    return placed.select("doc_id", F.when(F.col("_a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def summary(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one (ties: smallest start, then period) and digests of all runs and of the text left over."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    length = -F.col("best.less")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
