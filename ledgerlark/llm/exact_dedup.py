"""Exact duplicates by a sharded cuckoo-filter index over text digests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, free_name, id_key, whole

SLOTS, KICKS = 4, 500
ENTRY = "shard int, digest binary, n bigint, points bigint, doc_id bigint"


class CuckooFilter:
    """Partial-key cuckoo filter: 16-bit fingerprints, two candidate buckets of four slots, deletion of inserted keys."""

    def __init__(self, buckets: int = 64):
        self.buckets, self.slots, self.used = buckets, [0] * (buckets * SLOTS), 0

    @staticmethod
    def mark(digest: bytes) -> int:
        return 1 + int.from_bytes(digest[8:12], "big") % 65535

    def first(self, digest: bytes) -> int:
        return int.from_bytes(digest[:8], "big") & (self.buckets - 1)

    def other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995 >> 7) & (self.buckets - 1))

    def __contains__(self, digest: bytes) -> bool:
        mark, a = self.mark(digest), self.first(digest)
        b = self.other(a, mark)
        return mark in self.slots[a * SLOTS:(a + 1) * SLOTS] or mark in self.slots[b * SLOTS:(b + 1) * SLOTS]

    def _put(self, bucket: int, mark: int) -> bool:
        for i in range(bucket * SLOTS, (bucket + 1) * SLOTS):
            if not self.slots[i]:
                self.slots[i] = mark
                self.used += 1
                return True
        return False

    def add(self, digest: bytes) -> bool:
        """False if no place was found; the filter has then lost a mark and must be built anew from stored keys."""
        mark, bucket = self.mark(digest), self.first(digest)
        if self._put(bucket, mark) or self._put(self.other(bucket, mark), mark):
            return True
        bucket = self.other(bucket, mark)
        for kick in range(KICKS):
            i = bucket * SLOTS + (mark + kick) % SLOTS
            mark, self.slots[i] = self.slots[i], mark
            bucket = self.other(bucket, mark)
            if self._put(bucket, mark):
                return True
        return False

    def discard(self, digest: bytes) -> None:
        mark, a = self.mark(digest), self.first(digest)
        for bucket in (a, self.other(a, mark)):
            for i in range(bucket * SLOTS, (bucket + 1) * SLOTS):
                if self.slots[i] == mark:
                    self.slots[i] = 0
                    self.used -= 1
                    return


class CuckooIndex:
    """Live digests with a reference count and the best row: a filter in front of content kept by first bucket."""

    def __init__(self, buckets: int = 64):
        self.filter, self.content, self.checked = CuckooFilter(buckets), {}, 0

    def find(self, digest: bytes) -> list | None:
        """The entry of a digest. A miss of the filter is final; a hit is verified against the bucket's whole digests."""
        if digest not in self.filter:
            return None
        self.checked += 1
        return next((e for e in self.content.get(self.filter.first(digest), ()) if e[0] == digest), None)

    def _resize(self) -> None:
        entries = [e for bucket in self.content.values() for e in bucket]
        buckets = self.filter.buckets
        while True:
            buckets *= 2
            self.filter, self.content = CuckooFilter(buckets), {}
            if all(self.filter.add(e[0]) for e in entries):
                break
        for e in entries:
            self.content.setdefault(self.filter.first(e[0]), []).append(e)

    def insert(self, digest: bytes, n: int, best: tuple) -> bool:
        """Adds n rows of a digest; True if it was live before. Smaller ``best`` wins."""
        if entry := self.find(digest):
            entry[1] += n
            entry[2] = min(entry[2], best)
            return True
        self.content.setdefault(self.filter.first(digest), []).append([digest, n, best])
        if not self.filter.add(digest):
            self._resize()
        return False

    def delete(self, digest: bytes, n: int) -> bool:
        """Takes n rows off a live digest, and the digest itself with its last row; False if it is not live."""
        entry = self.find(digest)
        if entry is None:
            return False
        entry[1] -= n
        if entry[1] <= 0:
            bucket = self.filter.first(digest)
            self.content[bucket].remove(entry)
            self.filter.discard(digest)
        return True

    def entries(self) -> Iterator[list]:
        for bucket in self.content.values():
            yield from bucket


def _best(points, doc_id) -> tuple:
    return (-int(points), doc_id is None, 0 if doc_id is None else int(doc_id))


def _rows(part: pd.DataFrame) -> Iterator[tuple]:
    ids = part["doc_id"].astype(object).where(part["doc_id"].notna(), None)
    yield from zip(part["shard"], part["digest"], part["n"], part["points"], ids, strict=True)


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["shard", "digest", "n", "points", "doc_id"])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per digest and batch, so a digest of a third of all rows sends one row per batch to its shard."""
    for batch in batches:
        seen: dict = {}
        for shard, digest, n, points, doc_id in _rows(batch):
            key, best = (shard, bytes(digest)), _best(points, doc_id)
            old = seen.get(key)
            seen[key] = (n, best) if old is None else (old[0] + n, min(old[1], best))
        yield _frame([(s, d, n, -b[0], None if b[1] else b[2]) for (s, d), (n, b) in seen.items()])


def _indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Feeds the rows of a partition to the index of their shard; negative n deletes. Memory: the shard's live digests."""
    indexes: dict[int, CuckooIndex] = {}
    later = []
    for batch in batches:
        for shard, digest, n, points, doc_id in _rows(batch):
            index = indexes.setdefault(shard, CuckooIndex())
            if n > 0:
                index.insert(bytes(digest), int(n), _best(points, doc_id))
            else:
                later.append((shard, bytes(digest), -int(n)))
    for shard, digest, n in later:
        indexes[shard].delete(digest, n)
    for shard, index in indexes.items():
        entries = list(index.entries())
        for at in range(0, len(entries), 10_000):
            yield _frame([(shard, d, n, -b[0], None if b[1] else b[2]) for d, n, b in entries[at:at + 10_000]])


def text_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text without ASCII white space."""
    return F.unhex(F.sha2(F.regexp_replace(text, f"[{SPACE}]+", ""), 256))


def shards_for(rows: int, keys_per_shard: int = 100_000) -> int:
    return max(1, -(-rows // keys_per_shard))


def update_index(index: DataFrame | None, inserted: DataFrame, deleted: DataFrame | None, shards: int) -> DataFrame:
    """The index after inserting and deleting rows: (shard, digest, n, points, doc_id), one row per live digest.

    ``inserted`` and ``deleted`` have doc_id, points and digest. Deleting a digest that is not live does nothing. points and
    doc_id name the best row ever inserted for a digest while it is live. The number of shards of an index is fixed.
    """
    def entries(df: DataFrame, n: int) -> DataFrame:
        shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")
        return df.select(shard.alias("shard"), "digest", F.lit(n).cast("bigint").alias("n"), F.col("points").cast("bigint").alias("points"), F.col("doc_id").cast("bigint").alias("doc_id"))

    changes = entries(inserted, 1).mapInPandas(_combined, ENTRY)
    if deleted is not None:
        changes = changes.union(entries(deleted, -1))
    if index is not None:
        changes = index.select("shard", "digest", "n", "points", "doc_id").union(changes)
    return changes.repartition(shards, "shard").mapInPandas(_indexed, ENTRY)


def digests(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.char_length(whole()).cast("bigint").alias("points"), text_digest(whole()).alias("digest"))


def find_duplicates(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, points.

    Texts that are equal without white space form a group; the row with most code points, then smallest doc_id stays. Null
    texts count as empty and null ids sort last. Of rows that repeat id and text, one is marked as kept. Empty in, empty out.
    """
    rows = digests(docs)
    groups = update_index(None, rows, None, shards or shards_for(docs.count()))
    groups = groups.select("digest", F.col("n").alias("group_size"), F.col("points").alias("keep_points"), F.col("doc_id").alias("keep_id"))
    # rows that are alike in id, length and digest travel as one
    alike = rows.groupBy("doc_id", "points", "digest").agg(F.count("*").cast("int").alias("copies"))
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
    out = alike.join(groups, "digest").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select("doc_id", "keep_id", "group_size", (best & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "points")


def drop_duplicates(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The documents that stay, with all their columns. Of rows that repeat id and text, the one whose columns sort first stays."""
    key, sha, points, nth = (free_name(docs, c) for c in ("_id_key", "_sha", "_points", "_nth"))
    kept = find_duplicates(docs, shards).filter("kept").select(id_key(F.col("doc_id")).alias(key), F.unhex("text_sha256").alias(sha), F.col("points").alias(points))
    rows = docs.withColumns({key: id_key(F.col("doc_id")), sha: text_digest(whole()), points: F.char_length(whole()).cast("bigint")})
    first = Window.partitionBy(key, sha, points).orderBy(*[F.col(f"`{c}`").cast("string") for c in docs.columns if c != "text"])
    chosen = rows.join(kept, [key, sha, points], "left_semi").withColumn(nth, F.row_number().over(first)).filter(F.col(nth) == 1)
    return chosen.select(*[F.col(f"`{c}`") for c in docs.columns])
