"""Registered queries of the text operators and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, decontaminate, exact_dedup, fixity, mixing, periodic, resample, secrets, simhash, sketches, suffixes, toxicity
from .common import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, row_number() OVER w AS nth, first_value(doc_id) OVER w AS keep_id FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, nth = 1 AS kept, text_sha256 FROM r
""")
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.find_duplicates(table(spark, sf_dir, "documents")).drop("points")


@query(r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
f AS (SELECT *, sum(source_size) OVER o - source_size AS ahead, sum(weight) OVER () - (sum(weight) OVER o - weight) AS rest, sum(source_size) OVER () AS total FROM s
  WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, max((total - 3.0::DOUBLE * ahead) / rest) OVER () * weight) AS target FROM f),
e AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
  CASE WHEN t.source_size > 0 THEN CAST(round(t.target / t.source_size * 1048576) AS BIGINT) ELSE 1048576 END AS expected FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, sum(expected) OVER (PARTITION BY source ORDER BY size DESC, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto FROM e),
o AS (SELECT source, target, j, CAST('0x' || substr(md5('42:' || j || ':' || coalesce(source, 'null')), 1, 5) AS BIGINT) AS start FROM t, range(16) AS r(j)),
m AS (SELECT o.source, o.j, o.start, abs(sum(((upto + start) // 1048576 - (upto + start - expected) // 1048576) * size) - any_value(o.target)) AS miss
  FROM p JOIN o ON p.source IS NOT DISTINCT FROM o.source GROUP BY o.source, o.j, o.start),
b AS (SELECT source, arg_min(start, (miss, j)) AS start FROM m GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(((upto + start) // 1048576 - (upto + start - expected) // 1048576) * size AS BIGINT) AS taken
FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
""")
def op2_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(r"""
WITH r AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'null')
  || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
  || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
p AS (SELECT page_id, strlen(record) AS length, sum(strlen(record)) OVER (ORDER BY page_id NULLS LAST, sha256(record) ROWS UNBOUNDED PRECEDING) - strlen(record) AS spot FROM r),
f AS (SELECT page_id, length, spot // 67108864 AS file, spot FROM p),
o AS (SELECT *, spot - min(spot) OVER (PARTITION BY file) AS start, CAST('0x' || substr(md5('fault:' || coalesce(CAST(page_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) % 97 AS draw FROM f)
SELECT CAST(file AS BIGINT) AS file, CAST(start AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length, page_id, CASE draw WHEN 0 THEN 'changed' ELSE 'missing' END AS finding FROM o WHERE draw < 2
""")
def op3_warc_fixity(spark, sf_dir):
    records = fixity.with_faults(fixity.warc_records(table(spark, sf_dir, "pages")))
    placed = stored(fixity.laid_out(records))
    replica = placed.filter("copy_digest is not null").withColumn("digest", F.col("copy_digest"))
    return fixity.audit(fixity.leaves(placed), fixity.leaves(replica))


@query()
def op4_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query()
def op5_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


CONTROL_CASE = '{"conv_id": -1, "messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'


@query(r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<|', '&lt;|'), '<s>', '&lt;s>'), '</s>', '&lt;/s>'), '[INST]', '&lsqb;INST]'), '[/INST]', '&lsqb;/INST]') AS safe FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length('<|turn|>' || role || chr(10) || safe || '<|end|>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""")
def op6_chat_format(spark, sf_dir):
    record = F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"})
    rows = table(spark, sf_dir, "conversations").select("conv_id", record.alias("record"))
    extra = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(CONTROL_CASE).alias("record"))
    return chat.conversation_digests(chat.format_turns(chat.canonical_turns(rows.union(extra))))


@query()
def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query()
def op8_fingerprints(spark, sf_dir):
    return sketches.fingerprints(table(spark, sf_dir, "documents"))


@query()
def op9_secret_scan(spark, sf_dir):
    found = stored(secrets.candidates(table(spark, sf_dir, "documents")))
    scored = secrets.score(found, secrets.fit(secrets.verified(found)))
    return scored.select("doc_id", "start", F.char_length("candidate").cast("bigint").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "secret")


@query()
def op10_suffix_dedup(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query(r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, len(w[i:i + least(len(w), 10) - 1]) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
h AS (SELECT r, i, size, item FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM d) JOIN (SELECT DISTINCT size FROM g) ON i + size - 1 <= len(w)
  JOIN g USING (size) WHERE array_to_string(w[i:i + size - 1], ' ') = gram),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS p FROM h) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN n USING (r)
""")
def op11_decontaminate(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op12_periodic_runs(spark, sf_dir):
    return periodic.summary(periodic.find_runs(periodic.planted(table(spark, sf_dir, "documents"))))


# DuckDB has no CRC-32, so the SQL computes it: a table of 256 entries by rule, then byte by byte for every distinct word.
@query(r"""
WITH tab AS (SELECT list(list_reduce(list_concat([v], range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY v) AS t FROM (SELECT unnest(range(256)) AS v)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS word FROM d), bw AS (SELECT unnest(w) AS word FROM b),
c AS (SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(CAST(strlen(word) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT))),
  lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)])), 4294967295) % 10000 AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw), tab),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN c USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bw JOIN c USING (word) GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0)::DOUBLE + 1) * ((SELECT sum(s) FROM s)::DOUBLE + 10000)) / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT sum(t) FROM t)::DOUBLE + 10000)))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket)),
m AS (SELECT r, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM dw JOIN c USING (word) JOIN g USING (bucket) GROUP BY r),
p AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN m USING (r)),
o AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) END AS place FROM p)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM p WHERE n_features >= 20) THEN place END AS "rank" FROM o
""")
def op13_resample(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "item_id")
