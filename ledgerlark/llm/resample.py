"""Importance resampling towards a target distribution of hashed word n-grams.

The hash of an n-gram is the CRC-32 of its words joined by one space. A text is scanned once, keeping the running CRC before and
after every word; the CRC of any n-gram follows from two of them: crc(AB) = crc(A) * x^(8|B|) + crc(B) over GF(2).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import accumulate, chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import running_sum, stored, whole

BUCKETS = 10_000
SLAB = 1 << 18  # words that are hashed together; a longer text is hashed by itself
POLYNOMIAL = 0xEDB88320  # of CRC-32, lowest power in the highest bit
# bytes to bytes: A-Z to lower case, other ASCII but digits and a-z to a space
WORD_BYTES = bytes(b + 32 if chr(b).isupper() else b if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


@lru_cache(maxsize=1)
def zero_byte_tables() -> np.ndarray:
    """Tables [k, byte, value] of the linear map that 2**k zero bytes make of a CRC: four lookups, combined by exclusive or."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1).astype(np.uint32)
    value = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    tables = [(value >> np.uint32(8)) ^ step[value & 255]]
    while len(tables) < 32:
        tables.append(_mapped(tables[-1], tables[-1]))
    return np.stack(tables)


def _mapped(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Every CRC multiplied by x**(8 * zeros) modulo the polynomial."""
    out, tables = crc.copy(), zero_byte_tables()
    for k in range(int(zeros.max(initial=0)).bit_length()):
        at = np.flatnonzero(zeros >> k & 1)
        out[at] = _mapped(tables[k], out[at])
    return out


def words_of(text: str) -> list[bytes]:
    """Words with A-Z in lower case; a separator is any ASCII character but digits and letters."""
    return text.encode().translate(WORD_BYTES).split()


def _scan(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Running CRCs of the words joined by spaces: before and after each word in turn; and the lengths of the words."""
    parts = chain.from_iterable(zip(words, repeat(b" ")))
    crcs = accumulate(parts, lambda crc, part: zlib.crc32(part, crc), initial=0)
    return np.fromiter(islice(crcs, 2 * len(words)), np.uint32, 2 * len(words)), np.fromiter(map(len, words), np.int64, len(words))


def ngram_crcs(crcs: np.ndarray, lengths: np.ndarray, first: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n up to ``most``: (word numbers, CRC-32 of the n words from there) of texts that lie behind each other.

    ``first`` is the number of the first word of the text that a word belongs to; n-grams do not cross texts.
    """
    before, after = crcs[0::2], crcs[1::2]
    ends = np.cumsum(lengths + 1)  # the space after a word counts
    out = []
    for n in range(1, most + 1):
        at = np.arange(max(len(lengths) - n + 1, 0))
        at = at[first[at] == first[at + n - 1]]
        size = ends[at + n - 1] - ends[at] + lengths[at]
        out.append((at, after[at + n - 1] ^ shifted(before[at], size)))
    return out


def _hashed(scans: list[tuple[np.ndarray, np.ndarray]], most: int, buckets: int) -> tuple[pa.Array, pa.Array]:
    """Number of words and the buckets of all features of a few texts."""
    crcs, lengths = (np.concatenate(x) for x in zip(*scans))
    counts = np.array([len(x) for _, x in scans], np.int64)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    found = ngram_crcs(crcs, lengths, first, most)
    text_of = np.repeat(np.arange(len(counts)), counts)
    owner = np.concatenate([text_of[at] for at, _ in found])
    value = (np.concatenate([crc for _, crc in found]) % np.uint32(buckets)).astype(np.int32)
    if most > 1:
        value = value[np.argsort(owner, kind="stable")]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(counts)))]).astype(np.int32)
    return pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(value))


def _features(batches: Iterator[pa.RecordBatch], most: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start, scans, size = 0, [], 0
        for i, text in enumerate(batch["text"]):
            scans.append(_scan(words_of(text.as_py())))
            size += len(scans[-1][1])
            if size >= SLAB or i + 1 == batch.num_rows:
                ids = batch["doc_id"].slice(start, len(scans))
                yield pa.RecordBatch.from_arrays([ids, *_hashed(scans, most, buckets)], ["doc_id", "n_words", "buckets"])
                start, scans, size = i + 1, [], 0


def features(rows: DataFrame, key: str, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """doc_id (the key), n_words and the buckets of the runs of 1 to ``most`` words of each text; a null text has none."""
    texts = rows.select(F.col(key).cast("bigint").alias("doc_id"), whole().alias("text"))
    return texts.mapInArrow(partial(_features, most=most, buckets=buckets), "doc_id bigint, n_words bigint, buckets array<int>")


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of the bucket lists of a batch."""
    column = batch["buckets"]
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0]:offsets[-1]], offsets - offsets[0]


def _tallies(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        total += np.bincount(_lists(batch)[0], minlength=buckets)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])


def tally(found: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): features of all rows by bucket. Every task hands on at most one row per bucket."""
    per = found.select("buckets").mapInArrow(partial(_tallies, buckets=buckets), "bucket bigint, n bigint")
    return per.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed frequencies in target and source, one number per bucket, rounded down."""
    every = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    both = both.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"])
    total_s, total_t = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = ((F.col("t") + 1) * F.lit(total_s + buckets)) / ((F.col("s") + 1) * F.lit(total_t + buckets))
    rows = both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()  # one number per bucket, whatever the data
    out = np.zeros(buckets, np.int64)
    for bucket, gain in rows:
        out[bucket] = gain
    return out


def _weights(batches: Iterator[pa.RecordBatch], gain) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, offsets = _lists(batch)
        upto = np.concatenate([[0], np.cumsum(gain.value[values])])
        n = np.diff(offsets).astype(np.int64)
        weight = (upto[offsets[1:]] - upto[offsets[:-1]]) // np.maximum(n, 1)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_words"], pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel draw that depends on the id and the seed alone, rounded down."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, target_key: str, most: int = 1, buckets: int = BUCKETS, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null if not drawn).

    weight is the mean gain of the document's features, rounded down, and 0 without features; score adds the noise of the id.
    Of the documents with at least ``least_words`` words, ``percent`` of a hundred (rounded down) with the highest scores are
    drawn; ties go to the smaller id, null ids last. Null texts have no words; a null id draws the noise of ``null``. Rows that
    repeat an id tie and are ranked by features and weight. Extra columns are dropped. Without documents there are no rows;
    without target rows all gains come from the smoothing alone.
    """
    found = stored(features(docs, "doc_id", most, buckets))
    gain = docs.sparkSession.sparkContext.broadcast(gains(tally(found, buckets), tally(features(target, target_key, most, buckets), buckets), buckets))
    weighed = found.mapInArrow(partial(_weights, gain=gain), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    scored = stored(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranked = running_sum(able.withColumn("one", F.lit(1).cast("bigint")), [], order, {"rank": "one"})
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*out).union(rest.select(*out))
