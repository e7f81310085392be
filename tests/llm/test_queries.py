"""Registered text queries next to their SQL; the pipeline next to a plain version of its stages."""

import math
import re

import pytest

import corpus_pipeline
from ledgerlark.llm import queries, toxicity
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]).startswith("ok"), name


def test_one_query_per_operator():
    import __spark_entry__ as entry

    assert [sum(q.startswith(f"op{n}_") for q in entry.queries()) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in entry.queries()


def test_pipeline_stages(spark):
    """Every stage against a plain version of it, fed with what the stage before kept."""
    source = docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
        assert docs.columns == columns
        kept.append([r.asDict() for r in docs.collect()])
    toxic, exact, near, mixed = kept
    model = toxicity.fit(source, spark.read.parquet(f"{SF}/labels.parquet"))
    machine = toxicity._automaton(model)
    chance = lambda t: 1 / (1 + math.exp(-sum(c * x for c, x in zip(model.coefficients, toxicity.features(t, model, machine))) - model.intercept))
    assert sorted(r["doc_id"] for r in toxic) == sorted(r["doc_id"] for r in source.collect() if chance(r["text"]) < 0.5)
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t)
    assert len({norm(r["text"]) for r in toxic}) == len(exact) == len({norm(r["text"]) for r in exact})
    from test_dedup import roots
    from test_text import filled

    def five(text):
        words = (text or "").encode().lower().split()
        return frozenset(tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1)))

    sets = {r["doc_id"]: five(r["text"]) for r in exact}
    root = roots(sorted(sets), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    assert {r["doc_id"] for r in near} == {min(j for j in sets if root[j] == root[i]) for i in sets}
    sources = sorted({r["source"] for r in near}, key=str.encode)
    size = lambda rows, s: sum(len(r["text"].split()) for r in rows if r["source"] == s)
    want = filled([size(near, s) for s in sources], [(5, 2, 1)[i % 3] for i in range(len(sources))], 3)
    for s, target in zip(sources, want):
        assert abs(size(mixed, s) - target) <= max(len(r["text"].split()) for r in near if r["source"] == s)
    out = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert out.count() == len(mixed) and set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
