"""Near-duplicates by five-word shingles against brute force, and the pipeline's stage on both sides of 0.8."""

import random
import warnings

import pytest
from test_dedup import roots, word

import corpus_pipeline
from ledgerlark.llm import jaccard, simhash


def brute_share(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({" ".join(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def wanted(rows):
    text = [t for _, t in rows]
    root = roots(list(range(len(rows))), lambda a, b: brute_share(text[a], text[b]) >= 0.8)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[root[k]] = min(low.get(root[k], i), i)
    return {i: low[root[k]] for k, (i, _) in enumerate(rows)}


def edited_rows():
    """Copies with changed words on both sides of 0.8, behind one common opening of eight words."""
    rng = random.Random(11)
    opening = [word(rng) for _ in range(8)]
    base = [[word(rng) for _ in range(rng.randint(3, 150))] for _ in range(50)]
    rows = []
    for i in range(300):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(w) // 25))):
            w[rng.randrange(len(w))] = word(rng)
        rows.append((i * 7 % 311, " ".join(opening + w if i % 2 else w)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "!"), (904, "One two"), (905, "one  TWO")]


@pytest.mark.parametrize("params", [{}, {"first": 1}, {"first": 1, "block": 4}])
def test_components_equal_brute_force(spark, params):
    rows = edited_rows()
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), **params).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == wanted(rows)
    assert len({r["component_id"] for r in got}) < len(rows) - 50


def test_pipeline_stage_decides_by_shingles(spark):
    """One word changed in 41 leaves 32 of 42 shingles (below 0.8); two neighbours changed in 61 leave 51 of 63 (above)."""
    rng = random.Random(12)
    rows = []
    for i in range(40):
        near, far = [word(rng) for _ in range(61)], [word(rng) for _ in range(41)]
        for k, (w, at) in enumerate(((near, (30, 31)), (far, (20,)))):
            edited = list(w)
            for j in at:
                edited[j] = f"changed{i}"
            rows += [(4 * i + 2 * k, " ".join(w)), (4 * i + 2 * k + 1, " ".join(edited))]
    assert brute_share(rows[0][1], rows[1][1]) > 0.8 > brute_share(rows[2][1], rows[3][1])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert kept == {i for i, _ in rows if i % 4 != 1}


def test_pipeline_stage_starts_from_fingerprints(spark, monkeypatch):
    """The stage takes operator 5's links as proposals, verifies them, and finds by lists what they miss; its result is that of brute force."""
    rows = edited_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen, made = [], simhash.text_links
    monkeypatch.setattr(simhash, "text_links", lambda texts: seen.append(made(texts).cache()) or seen[0])
    kept = {r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert kept == set(wanted(rows).values())
    assert len(seen) == 1 and seen[0].count() > 0


def test_proposals_are_the_classes_of_fingerprints(spark, monkeypatch):
    """Different texts of one fingerprint link too, over however many branches; unlike texts among the proposals are turned down."""
    from pyspark.sql import functions as F

    rows = [(i, f"{t} {' ' * i}") for i, t in enumerate([" ".join("abcdefgh")] * 9)] + [(i, t) for i, t in edited_rows() if t]
    texts = spark.createDataFrame(rows, "fp bigint, text string").dropDuplicates(["fp"]).cache()
    rows = [(r["fp"], r["text"]) for r in texts.collect()]
    prints = {i: simhash.simhash(t, 5) for i, t in rows}
    want = roots(sorted(prints), lambda a, b: bin((prints[a] ^ prints[b]) & (1 << 64) - 1).count("1") <= 3)
    for branches in (simhash.BRANCHES, 2):
        monkeypatch.setattr(simhash, "BRANCHES", branches)
        pairs = {(r["a"], r["b"]) for r in simhash.text_links(texts).collect()}
        got = roots(sorted(prints), lambda a, b: (a, b) in pairs or (b, a) in pairs)
        assert len(set(want.values())) < len(prints) and len(pairs) < len(prints) * 2
        assert all((want[a] == want[b]) == (got[a] == got[b]) for a in prints for b in prints)
    keyed = spark.createDataFrame(edited_rows(), "doc_id bigint, text string").select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("fp"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["fp"]).cache()
    keys = [(r["fp"], r["text"]) for r in keyed.collect()]
    wrong = spark.createDataFrame([(min(a[0], b[0]), max(a[0], b[0])) for a, b in zip(keys, keys[1:])], "a bigint, b bigint")
    text = dict(keys)
    assert all(brute_share(text[r["a"]], text[r["b"]]) >= 0.8 for r in jaccard.links(keyed, proposed=wrong).collect())


def test_long_texts_of_unlike_sizes(spark):
    """Texts on both sides of 512 and 1024 shingles, whose parities have different numbers of buckets, link just above 0.8 only."""
    rng = random.Random(13)
    rows = []
    for i, (size, cut) in enumerate(((600, 110), (600, 130), (1100, 200), (1100, 240), (520, 20))):
        w = [word(rng) for _ in range(size)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[cut:]))]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == wanted(rows)
    assert {r["component_id"] for r in got} == {0, 2, 3, 4, 6, 7, 8}


def test_keep_one_edges(spark):
    rows = [(5, "a b c d e f g", "x"), (3, "A b c d e f  g", "y"), (None, "null id here", "n"), (8, "other words entirely they are", "x")]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, fp string")).collect()
    assert sorted((str(r["doc_id"]), r["fp"]) for r in got) == [("3", "y"), ("8", "x"), ("None", "n")]
    assert jaccard.keep_one(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_radius_without_guarantee_is_warned_of(spark):
    """Seven bits in seven bytes leave one shared byte: lost with three, found with the guaranteed one; the default radius is silent."""
    a = 0
    b = sum(1 << 8 * p for p in range(7))
    df = spark.createDataFrame([(a,), (b,)], "fp bigint")
    with pytest.warns(UserWarning, match="6 to 7 bits"):
        assert simhash.links(df, 7, 3).count() == 0
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert simhash.links(df, 7, 1).count() == 1
        simhash.links(df)


def crowded_rows():
    """24 texts of one fingerprint: what they repeat outweighs the 40 words in which eight groups of three differ."""
    rng = random.Random(14)
    rows = []
    for group in range(8):
        own = [word(rng) for _ in range(40)]
        rows += [(3 * group + k, " ".join("abcde" * 100) + " " + " ".join([*own, f"end{k}"])) for k in range(3)]
    return rows


def test_all_pairs_of_a_fingerprint_are_verified(spark, monkeypatch):
    """Without the prefix lists: a tree over the texts of one fingerprint links few of them, all its pairs link the groups."""
    def nothing(batches, share, lo, hi):
        import pandas as pd

        for _ in batches:
            yield pd.DataFrame({"a": [], "b": []}).astype("int64")

    rows = crowded_rows()
    assert len({simhash.simhash(t, 5) for _, t in rows}) == 1 and brute_share(rows[0][1], rows[1][1]) > 0.8 > brute_share(rows[0][1], rows[3][1])
    monkeypatch.setattr(jaccard, "_candidates", nothing)
    kept = {r["doc_id"] for r in corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()}
    assert kept == {3 * group for group in range(8)}


@pytest.mark.parametrize("block", [simhash.BLOCK, 4])
def test_text_pairs_are_all_pairs(spark, block):
    """Every pair of fingerprints within the radius whose roots differ, and no other, however the lists are cut."""
    rng = random.Random(15)
    base = [" ".join(word(rng) for _ in range(120)) for _ in range(6)]
    texts = [t for t in base for _ in range(4)]
    texts = [" ".join([*t.split()[:-1], word(rng)]) for t in texts] + [t for _, t in crowded_rows()]
    rows = [(i, t, i % 3) for i, t in enumerate(texts)]
    prints = [simhash.simhash(t, 5) for t in texts]
    want = {(i, j) for j in range(len(rows)) for i in range(j) if i % 3 != j % 3 and bin((prints[i] ^ prints[j]) & (1 << 64) - 1).count("1") <= 3}
    got = [(r["a"], r["b"]) for r in simhash.text_pairs(spark.createDataFrame(rows, "fp bigint, text string, root bigint"), block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 190


def test_an_id_stands_for_each_of_its_components(spark):
    """Unlike texts under one id, or without an id, are kept each; a text that is linked to another id is not kept for its own."""
    one, two, three, four = ("one two three four five six", "alpha beta gamma delta eps", "red green blue cyan pink", "x y z u v w")
    five = "nobody else has any of these"
    rows = [(None, one), (None, two), (None, two), (None, five), (5, three), (5, four), (3, three), (7, one.upper())]
    want = [(3, three), (5, four), (7, one.upper()), (None, five), (None, two)]
    for keep in (corpus_pipeline.near, lambda spark, docs, _: simhash.keep_one(docs)):
        got = keep(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
        assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted((str(i), t) for i, t in want)
