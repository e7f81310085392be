"""Secret scan: labels, forms of secrets beyond quoted hexadecimal values, and every occurrence of a candidate."""

import random
import string

from ledgerlark.llm import secrets
from ledgerlark.llm.common import stored


def forms(rng):
    made = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n - 2)) + str(rng.randint(10, 99))
    mixed = string.ascii_letters + string.digits
    return rng.choice([
        ("access", f"use AKIA{made(string.ascii_uppercase + string.digits, 16)} there"), ("underscore", f'token = "ab_{made(mixed, 30)}" ok'),
        ("dash", f"api_key: '{made(mixed, 8)}-{made(mixed, 12)}'"), ("unquoted", f"API_KEY={made(mixed, 24)}"), ("unquoted_hex", f"export DB_PASSWORD={made('0123456789abcdef', 40)}"),
        ("dot", f"auth_token: {made(mixed, 12)}.{made(mixed, 16)}"), ("strict", f'secret = "{made("0123456789abcdef", 40)}"'),
        ("harmless", f"call 4152745565{rng.randint(10**5, 10**6)} now"), ("harmless", f"see http-page-example-data-{rng.randint(1, 99)}.html"),
        ("harmless", f"commit {made('0123456789abcdef', 40)} merged"), ("harmless", f"on 2024-01-{rng.randint(10, 28)}/{rng.randint(1000, 9999)} it"),
    ])


def test_forms_of_secrets_are_found(spark):
    rng = random.Random(21)
    cases = [forms(rng) for _ in range(900)]
    df = spark.createDataFrame([(i, "words ahead " + t, "src/app") for i, (_, t) in enumerate(cases)], "doc_id bigint, text string, source string")
    found = stored(secrets.candidates(df))
    assert all(("words ahead " + cases[r["doc_id"]][1])[r["start"]:].startswith(r["candidate"]) for r in found.collect())
    model = secrets.fit(secrets.verified(found.filter("doc_id < 450")))
    held = secrets.score(found.filter("doc_id >= 450"), model).collect()
    for kind in {k for k, _ in cases}:
        said = [r["secret"] for r in held if cases[r["doc_id"]][0] == kind]
        assert sum(x == (kind != "harmless") for x in said) >= 0.9 * len(said) > 0, kind


def test_doubtful_findings_have_no_label(spark):
    rows = [(1, "Zk81mQp20xLw77Rt", ""), (2, "API_KEY=Zk81mQp20xLw77Rt", ""), (3, "2024-01-15/1200", ""), (4, "password=example-config-user1", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: (r["start"], r["candidate"], r["label"]) for r in secrets.verified(secrets.candidates(df)).collect()}
    assert got == {1: (0, "Zk81mQp20xLw77Rt", None), 2: (8, "Zk81mQp20xLw77Rt", 1), 3: (0, "2024-01-15/1200", 0), 4: (9, "example-config-user1", None)}


def test_every_occurrence_has_its_own_start(spark):
    text = '{"a":"x0123456789ab","b":"0123456789ab","c":"0123456789ab"}'
    df = spark.createDataFrame([(1, text, "")], "doc_id bigint, text string, source string")
    got = sorted((r["start"], r["candidate"], r["before"][-1], r["after"][0]) for r in secrets.candidates(df).collect())
    assert got == [(6, "x0123456789ab", '"', '"'), (26, "0123456789ab", '"', '"'), (45, "0123456789ab", '"', '"')]


def _places(text):
    """(start, candidate) by hand: runs of candidate characters with a digit, without those that hold an equals sign."""
    import re

    return [(m.start(), m.group()) for m in re.finditer(r"[A-Za-z0-9_+/.\-]+", text) if len(m.group()) >= secrets.LEAST and re.search("[0-9]", m.group())]


def test_candidates_equal_brute_force(spark):
    rng = random.Random(8)
    made = lambda n: "".join(rng.choice("abcXYZ019_/+.-") for _ in range(n))
    texts = ["", "   ", "\t " + made(30), None, "short 1 words only"]
    for _ in range(60):
        n = rng.choice([1, 5, 255, 256, 257, 600, 900])
        texts.append(rng.choice(["", " ", "\n\t"]) + "".join(made(rng.choice([3, 11, 12, 40])) + rng.choice([" ", "  ", ",", '","', "\n"]) for _ in range(n)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'' AS source")
    got = {}
    for r in secrets.candidates(df).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["candidate"]))
    assert {k: sorted(v) for k, v in got.items()} == {i: _places(t) for i, t in enumerate(texts) if t and _places(t)}


def test_one_text_of_very_many_candidates(spark):
    import time

    seconds = []
    for n in (30_000, 120_000):
        text = " ".join(f"id-{i:012d}" for i in range(n // 2)) + " " + ",".join(f"no-{i:012d}" for i in range(n // 2))
        df = spark.createDataFrame([(1, text, "")], "doc_id bigint, text string, source string")
        began = time.time()
        found = secrets.candidates(df).selectExpr("count(*) AS n", "max(start) AS last").first()
        seconds.append(time.time() - began)
        assert found["n"] == n and found["last"] == len(text) - 15
    assert seconds[1] < 10 * seconds[0]  # four times the text


def test_empty_table_of_texts(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    found = secrets.candidates(df)
    assert found.count() == 0 and secrets.fit(secrets.verified(found)) is None
