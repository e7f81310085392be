"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, scanned by every window of the documents."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import free_name, stored, whole

WIDTH = 10
MAX_BROADCAST = 64 << 20  # bytes of windows that may go to every executor; more are joined by a shuffle
LETTERS = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"  # digits, letters and everything beyond ASCII; ten times as fast as the negated class
PAIR = 64  # bytes a window takes in a hash table besides its text


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(LETTERS), F.lit(0))


def with_windows(df: DataFrame, words: str, lengths: list[int]) -> tuple[DataFrame, dict[int, str]]:
    """Adds one column per length: the hashes of all windows of so many words, and their names by length.

    Hashes of 1, 2, 4 and 8 words are made by doubling, windows of other lengths from those of their binary digits, so
    a word costs a few hashes whatever the length and a text of any length is linear work.
    """
    def ahead(column: str, by: int) -> Column:
        return F.slice(column, by + 1, F.greatest(F.size(column), F.lit(1)))

    def pair(a: Column, b: Column) -> Column:
        return F.xxhash64(a, b)

    power = {1: free_name(df, "_h1")}
    df = df.withColumn(power[1], F.transform(words, lambda w: F.xxhash64(w)))
    size = 1
    while size * 2 <= max(lengths, default=1):
        power[size * 2] = free_name(df, f"_h{size * 2}")
        df = df.withColumn(power[size * 2], F.zip_with(power[size], ahead(power[size], size), pair))
        size *= 2
    named = {}
    for length in lengths:
        digits = [s for s in sorted(power, reverse=True) if s & length]
        made, done = F.col(power[digits[0]]), digits[0]
        for s in digits[1:]:
            made = F.zip_with(made, ahead(power[s], done), pair)
            done += s
        named[length] = free_name(df, f"_w{length}")
        df = df.withColumn(named[length], F.slice(made, 1, F.greatest(F.size(words) - length + 1, F.lit(0))))
    return df, named


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame, list[int]]:
    """(wid, h, length, window), (wid, item) and the lengths in use; an item of fewer words than the width is one window."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(whole()).alias("words"))
    items = items.withColumn("length", F.least(F.size("words"), F.lit(width))).filter("length > 0")
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # at most ``width`` numbers
    hashed, named = with_windows(items, "words", lengths)
    grams = None
    for length, column in named.items():
        rows = hashed.filter(F.col("length") == length).select("item", "length", "words", F.posexplode(column).alias("pos", "h"))
        rows = rows.select("item", "h", "length", F.slice("words", F.col("pos") + 1, F.lit(length)).alias("window"))
        grams = rows if grams is None else grams.unionByName(rows)
    if grams is None:
        grams = hashed.select("item", F.lit(0).cast("bigint").alias("h"), "length", F.col("words").alias("window"))
    grams = stored(grams)
    windows = stored(grams.select("h", "length", "window").distinct().withColumn("wid", F.monotonically_increasing_id()))
    return windows, grams.join(windows, ["h", "length", "window"]).select("wid", "item").distinct(), lengths


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a digest of the text and the text; the two name a row up to repeats, which have equal results."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2(whole(), 256).alias("digest"), whole().alias("text"))


def occurrences(texts: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Verified (doc_id, digest, pos, length, wid) of every window of the benchmark in the texts.

    The scan hashes the windows of a text, joins them with the broadcast windows and compares the words of the hits; only
    hits leave the task. Windows of more than ``MAX_BROADCAST`` bytes are not broadcast: the same join then goes by a shuffle.
    """
    size = windows.agg(F.sum(F.octet_length(F.array_join("window", " ")) + PAIR)).first()[0] or 0
    side = windows.select(F.col("h").alias("hash"), "length", "window", "wid")
    hashed, named = with_windows(texts.withColumn("words", words_of(F.col("text"))), "words", lengths)
    # all lengths lie behind each other in one array; the windows of a length start where those before it end
    before, ahead = F.lit(0), F.lit(0)
    for length, column in named.items():
        before = F.when(F.col("length") == length, ahead).otherwise(before)
        ahead = ahead + F.greatest(F.size("words") - length + 1, F.lit(0))
    scanned = hashed.select("doc_id", "digest", "words", F.posexplode(F.concat(*[F.col(c) for c in named.values()])).alias("at", "h"))
    met = scanned.join(F.broadcast(side) if size <= MAX_BROADCAST else side, F.col("h") == F.col("hash"))
    found = met.withColumn("pos", F.col("at") - before).filter("pos >= 0 AND slice(words, pos + 1, length) = window")
    return found.select("doc_id", "digest", "pos", "length", "wid")


def _hits(docs: DataFrame, benchmark: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    windows, of_item, lengths = benchmark_windows(benchmark, width)
    texts = keyed(docs)
    if not lengths:
        return texts.select("doc_id", "digest", F.lit(0).alias("pos"), F.lit(0).alias("length"), F.lit(0).cast("bigint").alias("wid")).filter("false"), of_item
    return stored(occurrences(texts, windows, lengths).distinct()), of_item


KEY = ["doc_id", "digest"]


def _spans(hits: DataFrame) -> DataFrame:
    """(doc_id, digest, start, stop) of the words each occurrence adds to those of the occurrences that start before it."""
    before = Window.partitionBy(*KEY).orderBy("pos", "stop").rowsBetween(Window.unboundedPreceding, -1)
    rows = hits.select(*KEY, "pos", (F.col("pos") + F.col("length")).alias("stop")).distinct()
    start = F.greatest(F.col("pos"), F.coalesce(F.max("stop").over(before), F.lit(0)))
    return rows.select(*KEY, start.alias("start"), "stop").filter("start < stop")


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["digest"] == right["digest"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``width`` consecutive words of an item, or all of a shorter item; words are runs of digits, letters and
    characters beyond ASCII, A-Z in lower case. A word of a document is hit if an occurrence of a window holds it. Null and
    empty texts have no words. Items with a null id count as one item named ``null``, rows that repeat an id as one item.
    Repeated documents are repeated in the result; rows without hits have the digest of the empty list. Extra columns are
    dropped. Without documents there are no rows, without items no hits.
    """
    hits, of_item = _hits(docs, benchmark, width)
    covered = _spans(hits).groupBy(*KEY).agg(F.sum(F.col("stop") - F.col("start")).cast("bigint").alias("n_hit"))
    found = hits.select(*KEY, "wid").distinct().join(of_item, "wid").select(*KEY, "item").distinct()
    items = found.groupBy(*KEY).agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    marks = covered.join(items, _same(covered, items)).select(covered["doc_id"].alias("_id"), covered["digest"].alias("_digest"), "n_hit", "n_items", "items_sha256")
    rows = keyed(docs).select(*KEY, F.regexp_count("text", F.lit(LETTERS)).cast("bigint").alias("n_words"))
    out = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def _with_key(docs: DataFrame) -> tuple[DataFrame, str, str]:
    id_name, digest = free_name(docs, "_doc"), free_name(docs, "_digest")
    return docs.withColumns({id_name: F.col("doc_id").cast("bigint"), digest: F.sha2(whole(), 256)}), id_name, digest


def drop_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without any hit, with all their columns."""
    hit = _hits(docs, benchmark, width)[0].select(F.col("doc_id").alias("_i"), F.col("digest").alias("_d")).distinct()
    rows, i, d = _with_key(docs)
    return rows.join(hit, F.col(i).eqNullSafe(F.col("_i")) & (F.col(d) == F.col("_d")), "left_anti").drop(i, d)


def drop_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """All documents, hit words cut out of their texts; of a cut run its first and last separators stay, those inside go.

    Only documents with hits are taken apart, word by word, and put together again; all other texts, nulls too, are as they were.
    """
    spans = _spans(_hits(docs, benchmark, width)[0])
    cut_at = spans.select(F.col("doc_id").alias("_i"), F.col("digest").alias("_d"), F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("_at"))
    hit = spans.select(F.col("doc_id").alias("_i"), F.col("digest").alias("_d")).distinct()
    texts = keyed(docs).dropDuplicates(KEY).join(hit, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("digest") == F.col("_d")), "left_semi")
    # one separator more than words
    parts = texts.withColumns({"gap": F.split("text", LETTERS, -1), "word": F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))})
    rows = parts.select(*KEY, F.posexplode(F.arrays_zip("gap", "word")).alias("at", "part")).select(*KEY, "at", "part.gap", "part.word")
    marked = rows.join(cut_at, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("digest") == F.col("_d")) & (F.col("at") == F.col("_at")), "left")
    gone = F.col("_at").isNotNull()
    inside = gone & F.coalesce(F.lag(gone).over(Window.partitionBy(*KEY).orderBy("at")), F.lit(False))
    piece = F.concat(F.when(inside, "").otherwise(F.col("gap")), F.when(gone, "").otherwise(F.coalesce("word", F.lit(""))))
    pieces = marked.select(*KEY, "at", piece.alias("piece")).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"))
    texts = pieces.select(F.col("doc_id").alias("_i"), F.col("digest").alias("_d"), F.array_join(F.col("pieces.piece"), "").alias("_left"))
    rows, i, d = _with_key(docs)
    left = free_name(rows, "_cut_text")
    out = rows.join(texts.withColumnRenamed("_left", left), F.col(i).eqNullSafe(F.col("_i")) & (F.col(d) == F.col("_d")), "left")
    return out.select(*[F.coalesce(left, "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
