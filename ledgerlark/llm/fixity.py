"""Fixity audit of WARC replicas by Merkle trees over offset ranges.

A record's leaf hashes its bytes, place and length. Above the leaves, a node of level l covers a fixed range of offsets of its
file, SPAN * FANOUT**(l-1) bytes, and hashes the nodes below it in order of offset. Ranges do not depend on the number of
records, so no rank is needed, a node has a bounded number of children, and records that were added or lost change only the
nodes above them. An audit compares roots and goes down only below nodes that differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import id_key, running_sum, stored

SPAN = 1 << 16  # bytes that a node above the records covers
FANOUT = 16
FILE_BYTES = 1 << 26  # planned size of a file
NODE = ["file", "level", "node"]


def warc_records(pages: DataFrame) -> DataFrame:
    """(page_id, record): one WARC/1.1 response record in UTF-8 per page. Null urls and pages are empty, null ids are written as ``null``."""
    body = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), id_key(F.col("page_id")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col("url"), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", F.concat(head, body, F.lit("\r\n\r\n")).cast("binary").alias("record"))


def laid_out(records: DataFrame) -> DataFrame:
    """Adds ``file`` and ``offset`` to rows with page_id, length and digest: records one after another in files of about
    FILE_BYTES, by page_id, null last, then digest. A record belongs to the file in which it starts; offsets are those in the file."""
    placed = running_sum(records, [], [F.col("page_id").asc_nulls_last(), F.col("digest")], {"stop": "length"})
    placed = stored(placed.withColumn("at", F.col("stop") - F.col("length")).withColumn("file", F.floor(F.col("at") / FILE_BYTES).cast("bigint")).drop("stop"))
    # the first record of a file starts a little after the multiple of FILE_BYTES
    first = placed.groupBy("file").agg(F.min("at").alias("first"))
    return placed.join(first, "file").withColumn("offset", F.col("at") - F.col("first")).drop("at", "first")


def leaves(records: DataFrame) -> DataFrame:
    """(file, offset, length, page_id, hash) of records with file, offset, length and the SHA-256 ``digest`` of their bytes."""
    hashed = F.sha2(F.concat_ws(":", "offset", "length", "digest"), 256)
    return records.select("file", "offset", "length", "page_id", hashed.alias("hash"))


def tree(leaf: DataFrame, levels: int) -> DataFrame:
    """(file, level, node, hash) of all nodes above the leaves; the root of a file is its node of the highest level."""
    level = leaf.select("file", F.floor(F.col("offset") / SPAN).cast("bigint").alias("node"), F.col("offset").alias("at"), "hash")
    nodes = None
    for n in range(1, levels + 1):
        # an ordered list of at most FANOUT nodes, or of the records that start in one SPAN
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda c: c["hash"]), "")
        made = level.groupBy("file", "node").agg(F.sha2(joined, 256).alias("hash")).select("file", F.lit(n).alias("level"), "node", "hash")
        nodes = made if nodes is None else nodes.union(made)
        level = made.select("file", F.floor(F.col("node") / FANOUT).cast("bigint").alias("node"), F.col("node").alias("at"), "hash")
    return nodes


def levels_for(leaf: DataFrame) -> int:
    """Levels until one node covers the longest file."""
    longest = leaf.agg(F.max(F.col("offset") + F.col("length")).alias("n")).first()["n"] or 1
    n, covered = 1, SPAN
    while covered < longest:
        n, covered = n + 1, covered * FANOUT
    return n


def _differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    a = left.withColumnRenamed("hash", "left_hash")
    b = right.withColumnRenamed("hash", "right_hash")
    return a.join(b, keys, "full_outer").filter(~F.col("left_hash").eqNullSafe(F.col("right_hash")))


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records in which two replicas differ: file, offset, length, page_id, finding (changed, missing or added in the right one).

    ``left`` and ``right`` are leaves. Records that repeat an offset of a file are compared as a multiset. The trees are stored by
    level; below the roots only children of differing nodes are read and compared, level by level. A page_id names a record but
    is no part of its hash. Two empty replicas agree.
    """
    levels = max(levels_for(left), levels_for(right))
    left, right = stored(left), stored(right)
    trees = [stored(tree(side, levels)) for side in (left, right)]
    suspects = _differing(*[t.filter(F.col("level") == levels) for t in trees], NODE).select("file", "node")
    for level in range(levels - 1, 0, -1):
        parent = suspects.withColumnRenamed("node", "parent")
        below = [t.filter(F.col("level") == level).withColumn("parent", F.floor(F.col("node") / FANOUT).cast("bigint")).join(parent, ["file", "parent"], "left_semi").drop("parent") for t in trees]
        suspects = stored(_differing(*below, NODE).select("file", "node"))
    spot = F.floor(F.col("offset") / SPAN).cast("bigint").alias("node")
    sides = [side.select("*", spot).join(suspects, ["file", "node"], "left_semi").groupBy("file", "offset", "length", "hash").agg(F.count("*").alias("n"), F.min("page_id").alias("page_id")) for side in (left, right)]
    both = sides[0].withColumnsRenamed({"n": "ln", "page_id": "lp"}).join(sides[1].withColumnsRenamed({"n": "rn", "page_id": "rp"}), ["file", "offset", "length", "hash"], "full_outer")
    odd = both.filter(F.coalesce("ln", F.lit(0)) != F.coalesce("rn", F.lit(0)))
    lost, extra = F.coalesce(F.sum("ln"), F.lit(0)), F.coalesce(F.sum("rn"), F.lit(0))
    found = odd.groupBy("file", "offset").agg(F.max("length").alias("length"), F.coalesce(F.min("lp"), F.min("rp")).alias("page_id"), lost.alias("l"), extra.alias("r"))
    kind = F.when((F.col("l") > 0) & (F.col("r") > 0), "changed").when(F.col("l") > 0, "missing").otherwise("added")
    return found.select("file", "offset", "length", "page_id", kind.alias("finding"))


def with_faults(records: DataFrame, share: int = 97) -> DataFrame:
    """(page_id, length, digest, copy_digest) of records whose copy has planted faults, by a digest of page_id: of every ``share``
    records about one has a changed byte and one is lost (null)."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("fault:"), id_key(F.col("page_id")))), 1, 8), 16, 10).cast("bigint") % share
    copy = F.when(draw == 0, F.sha2(F.overlay("record", F.lit(b"!"), 1), 256)).when(draw != 1, F.sha2("record", 256))
    return records.select("page_id", F.octet_length("record").cast("bigint").alias("length"), F.sha2("record", 256).alias("digest"), copy.alias("copy_digest"))
