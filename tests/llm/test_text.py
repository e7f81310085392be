"""BPE, mixing, toxicity, chat formatting, fixity and secrets against plain Python, round trips and planted cases."""

import base64
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import bpe, chat, fixity, mixing, secrets, toxicity
from ledgerlark.llm.common import stored

public = pytest.importorskip("public_tokenizers")
RANKS, PATTERN = public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN
PARTS = ["a", "Z", "é", "ß", "1", "٣", "²", " ", "  ", "\n", "\t", "'s", "'", "'ll", "-", "_", "!", "日本", "́", "‍", "Ⅷ", "\x85", "\x1c", "\xa0", "😀"]


# byte-level BPE

def test_pieces_do_not_change_ids():
    enc = bpe.encoding(bpe.read_ranks(RANKS), PATTERN)
    rng = random.Random(3)
    for _ in range(1500):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 40)))
        want = enc.encode_ordinary(t)
        assert all(bpe.encode(enc, t, size) == want for size in (1, 2, 3, 7))
        assert bpe.decode(enc, want) == t.encode()


@pytest.mark.parametrize("text", [" " * 1_200_000 + "b", "x" + "\n " * 200_000, "a" * 300_000 + "1" * 300_000, "word " * 100_000])
def test_long_texts_round_trip(text):
    enc = bpe.encoding(bpe.read_ranks(RANKS), PATTERN)
    assert bpe.decode(enc, bpe.encode(enc, text)) == text.encode()


def test_bpe_rows(spark):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
    rows = [(1, "Hello, wörld!", 5), (1, "Hello, wörld!", 5), (None, None, 6), (2, "", 7), (3, "日本語 <|endoftext|> " * 50, 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = sorted(tuple(r) for r in bpe.round_trip(df, RANKS, PATTERN).fillna(-9).collect())
    want = []
    for i, t, _ in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((-9 if i is None else i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    ids, raw = bpe.encode_column(spark, RANKS, PATTERN), bpe.decode_column(spark, RANKS, PATTERN)
    assert all(bytes(r["b"]) == (r["text"] or "").encode() for r in df.select("text", raw(ids("text")).alias("b")).collect())
    assert bpe.round_trip(df.limit(0), RANKS, PATTERN).count() == 0


# mixing

def filled(sizes, weights, most):
    """Targets by the iteration: stop what is above, share the excess by weight, until none is above."""
    total, stopped = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in stopped]
        left, w = total - sum(stopped.values()), sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] / w > most * sizes[i] + 1e-9]
        if not above:
            return [stopped.get(i, left * weights[i] / w if w else 0) for i in range(len(sizes))]
        for i in above:
            stopped[i] = most * sizes[i]


def mixing_rows(seed):
    rng = random.Random(seed)
    rows = []
    for source, n in (("hot", 400), ("b", 3), ("a", 30), (None, 40), ("ä", 60), ("empty", 4)):
        rows += [(len(rows) + i, None if source == "empty" else "w " * rng.randint(0, 60), source, "extra") for i in range(n)]
    return rows


def test_mix_meets_targets(spark):
    rows = mixing_rows(1)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string").repartition(4)
    got = mixing.mix(df).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(7)).collect()}
    assert len(got) == len(rows) and {r["doc_id"]: r["taken"] for r in got} == again
    order = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r["size"] for r in got if r["source"] == s) for s in order]
    want = dict(zip(order, filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))], 3)))
    for s in order:
        mine = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max(r["size"] for r in mine)
        rate = want[s] / mine[0]["source_size"] if mine[0]["source_size"] else 1
        assert all(r["copies"] in (int(rate), int(rate) + 1) for r in mine)
        assert all(r["taken"] <= 3 * r["size"] for r in mine)


def test_emit(spark):
    rows = mixing_rows(2) + [(0, "w w w", "hot", "first"), (0, "w w w", "hot", "second")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies string")
    out = mixing.emit(df)
    assert out.columns == df.columns
    drawn = mixing.mix(df).agg(F.sum("copies")).first()[0]
    assert out.count() == drawn
    assert mixing.emit(df.limit(0)).count() == 0


# toxicity

def test_product_of_transducers():
    model = toxicity.Model(terms={"zog": 4.0, "blarg*": 2.0})
    score = lambda t: toxicity.score_clause(t.split(), model)
    assert score("the zog thing") == (4.0, 0.0)
    assert score("you zog")[0] > score("a zog")[0] > score("she said zog thing")[0] > score("not a zog")[0] > 0
    assert score("not one two three zog") == score("one two three zog")
    assert score("blargish")[0] == 2.0 and score("ablarg") == (0.0, 0.0)
    assert score("kill time") == (0.0, 0.0) and score("kill you")[1] > 0
    assert score("never kill you")[1] < score("kill you")[1]


def test_features_parse_only_clauses_with_terms():
    model = toxicity.Model(terms={"zog": 4.0})
    machine = toxicity._automaton(model)
    one, two = (toxicity.features(t, model, machine) for t in ("fine here. Zog! all well", "zog one. two zog; " + "x " * 100_000))
    assert one[0] == two[0] == 4.0 and two[1] > one[1] and two[2] > one[2]
    assert toxicity.features("", model, machine) == toxicity.features("prezog zo g", model, machine) == [0.0] * 4


def test_toxicity_held_out(spark):
    from ledgerlark.llm import queries

    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op7_toxicity(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in labels if got[r["doc_id"]]["held_out"]]
    assert sum(p == y for p, y in held) / len(held) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_toxicity_without_labels_and_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (None, "", 0.2), (1, "x " * 200_000, 0.3)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert not model.terms
    assert all(r["predicted"] == 0 and not (r["doc_id"] is None and r["held_out"]) for r in toxicity.score(docs, model).collect())
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 3


# chat formatting

def turns_of(spark, records):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "conv_id bigint, record string")
    out = {}
    for r in chat.canonical_turns(df).orderBy("conv_id", "turn").collect():
        out.setdefault(r["conv_id"], []).append((r["layout"], r["turn"], r["role"], r["text"]))
    return out


def test_layouts_become_turns(spark):
    got = turns_of(spark, [
        '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": null}]}',
        '{"conversations": [{"from": "human", "value": "q"}, {"value": "a", "from": "gpt"}]}',
        '{"completion": "a", "prompt": "q"}', '{"prompt": "q", "response": "a", "system": "s"}',
        '{"instruction": "do", "input": "", "output": "a"}', '{"instruction": "do", "input": "this", "output": "a"}',
        '{"data": {"question": "q", "answer": "a"}, "meta": {"id": 7}}', '{"conv_id": 5, "turn": 3, "role": null, "text": "t"}',
        '{"unknown": 1}', 'not json', '{"messages": []}', None,
    ])
    assert got[0] == [("messages", 0, "user", "q"), ("messages", 1, "assistant", "")]
    assert got[1] == [("speakers", 0, "user", "q"), ("speakers", 1, "assistant", "a")]
    assert [t[2:] for t in got[2]] == [("user", "q"), ("assistant", "a")]
    assert [t[2:] for t in got[3]] == [("system", "s"), ("user", "q"), ("assistant", "a")]
    assert got[4][0][3] == "do" and got[5][0][3] == "do\nthis"
    assert [t[2:] for t in got[6]] == [("user", "q"), ("assistant", "a")]
    assert got[7] == [("turn_row", 3, "", "t")]
    assert all(got[i][0][1:] == (None, None, None) and len(got[i]) == 1 for i in (8, 9, 10, 11))


def test_template_is_reversible(spark):
    rng = random.Random(8)
    bits = ["<|turn|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "&", "&amp;", "&lt;", "&lsqb;", "<", "|", "[", "\n", "é😀", " ok "]
    rows = [(i // 3, i % 3, rng.choice(["user", "assistant", "ro\nle|>", ""]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for i in range(240)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    formatted = chat.format_turns(df)
    back = chat.read_turns(formatted).collect()
    assert sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in back) == sorted(rows)
    assert all(r["loss_text"] == (r["text"] if r["role"] == "assistant" else "") for r in back)
    for r in formatted.collect():
        inner = r["formatted"][len(chat.OPEN):-len(chat.CLOSE)]
        assert not re.search(r"<\||</?s>|\[/?INST\]", inner)
    for r in chat.conversation_digests(formatted).collect():
        mine = sorted(x[1:] for x in rows if x[0] == r["conv_id"])
        said = "".join(t for _, role, t in mine if role == "assistant")
        assert r["n_turns"] == len(mine) and r["loss_chars"] == len(said) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in mine).encode()).hexdigest()
    texts = {r["conv_id"]: r["formatted"] for r in chat.conversation_text(formatted).collect()}
    assert len(texts) == 80 and all(t.startswith(chat.OPEN) for t in texts.values())


# fixity

def records(spark, n, drop=(), change=(), extra=()):
    rows = [(i, i // 40, (i % 40) * 5000, 5000, f"d{i}!" if i in change else f"d{i}") for i in range(n) if i not in drop]
    rows += [(i, i // 40, 40 * 5000, 10, "x") for i in extra]
    return spark.createDataFrame(rows, "page_id bigint, file bigint, offset bigint, length bigint, digest string")


def test_audit_finds_planted_faults(spark):
    left = fixity.leaves(records(spark, 200))
    right = fixity.leaves(records(spark, 200, drop=(7, 150), change=(3, 99, 151), extra=(40,)))
    got = {(r["page_id"], r["finding"]) for r in fixity.audit(left, right).collect()}
    assert got == {(7, "missing"), (150, "missing"), (3, "changed"), (99, "changed"), (151, "changed"), (40, "added")}
    assert fixity.audit(left, left).count() == 0
    none = left.limit(0)
    assert fixity.audit(none, none).count() == 0
    assert {r["finding"] for r in fixity.audit(none, left).collect()} == {"added"}


def test_roots_differ_only_for_damaged_files(spark):
    a, b = (fixity.tree(fixity.leaves(records(spark, 200, change=c)), 3).filter("level = 3") for c in ((), (99,)))
    assert [r["file"] for r in fixity._differing(a, b, fixity.NODE).collect()] == [2]


def test_layout_is_gapless(spark, monkeypatch):
    monkeypatch.setattr(fixity, "FILE_BYTES", 2000)
    pages = spark.createDataFrame([(i, f"http://x/{i}", "é" * (i % 90)) for i in range(60)] + [(None, None, None), (5, "again", "x"), (5, "again", "x")], "page_id bigint, url string, html string")
    placed = fixity.laid_out(fixity.with_faults(fixity.warc_records(pages))).orderBy("file", "offset").collect()
    assert len(placed) == 63
    for a, b in zip(placed, placed[1:]):
        assert b["offset"] == (a["offset"] + a["length"] if a["file"] == b["file"] else 0)
        assert b["file"] > a["file"] or b["page_id"] is None or b["page_id"] >= a["page_id"]


# secrets

def finding(rng):
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    name = rng.choice(["api_key", "token", "password", "SECRET"])
    return rng.choice([
        (f'{name} = "{hexa(40)}" ok', 1), (f"{name}: '{hexa(32)}'", 1), (f"call 4152745565{rng.randint(10**5, 10**6)} now", 0), (f"mail user.{rng.randint(10, 99)}@mail0.example.com", 0),
        (f"see http-page-example-data-{rng.randint(1, 99)}.html", 0), (f"version 20240{rng.randint(1000, 9999)}-release.test1", 0), (f"commit {hexa(40)} merged", 0),
    ])


def test_forest_removes_false_findings(spark):
    rng = random.Random(5)
    cases = [finding(rng) for _ in range(600)]
    df = spark.createDataFrame([(i, "  words ahead " + t, "src/app", y) for i, (t, y) in enumerate(cases)], "doc_id bigint, text string, source string, y int")
    found = stored(secrets.candidates(df).join(df.select("doc_id", F.col("y").alias("label")), "doc_id"))
    text = {i: "  words ahead " + t for i, (t, _) in enumerate(cases)}
    rows = found.collect()
    assert all(text[r["doc_id"]][r["start"]:r["start"] + len(r["candidate"])] == r["candidate"] for r in rows)
    assert {r["doc_id"] for r in rows} == {i for i in text if re.search(r"[A-Za-z0-9_+/=.\-]{12,}", text[i])}
    model = secrets.fit(found.filter("doc_id < 300"))
    held = secrets.score(found.filter("doc_id >= 300"), model).collect()
    assert sum(r["secret"] == bool(r["label"]) for r in held) / len(held) >= 0.97
    a, b = (sorted((r["doc_id"], r["score"]) for r in secrets.score(found, secrets.fit(found)).collect()) for _ in range(2))
    assert a == b


def test_secret_edge_rows(spark):
    df = spark.createDataFrame([(1, None, None, 1), (None, "", "p", 2), (2, "x" * 100_000 + "1", "p", 3), (2, 'a="' + "0123456789ab" * 2 + '";b="0123456789ac"', "p", 4)], "doc_id bigint, text string, source string, score int")
    found = secrets.candidates(df)
    assert sorted((r["doc_id"], r["start"], len(r["candidate"])) for r in found.collect()) == [(2, 0, 100_001), (2, 3, 24), (2, 32, 12)]
    assert secrets.fit(secrets.verified(found.limit(0))) is None
    assert secrets.score(found, None).filter("secret").count() == 3


def test_a_source_named_null_is_not_a_null_source(spark):
    """Rows of both lie in one running sum each; the targets are met as with any other name."""
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(1, 40))), (None, "null", "a")[i % 3]) for i in range(600)]
    frame = lambda named: spark.createDataFrame([(i, t, named if s == "null" else s) for i, t, s in rows], "doc_id long, text string, source string")
    for named in ("null", "b"):
        taken, target = {}, {}
        for r in mixing.mix(frame(named)).collect():
            taken[r.source] = taken.get(r.source, 0) + r.taken
            target[r.source] = r.target
        assert set(taken) == {None, named, "a"} and all(abs(taken[s] - target[s]) <= 40 for s in taken)
    out = mixing.emit(frame("null"))
    assert out.filter("source IS NULL AND doc_id % 3 <> 0").count() == out.filter("source = 'null' AND doc_id % 3 <> 1").count() == 0
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit("w"))).alias("n")).collect()}
    drawn = {}
    for r in mixing.mix(frame("null")).collect():
        drawn[r.source] = drawn.get(r.source, 0) + r.taken
    assert words == drawn
