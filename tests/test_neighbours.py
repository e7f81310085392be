"""The index of near-duplicate lessons against comparison of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import neighbours as N

SCHEMA = "reflection_id string, competition_id string, embedding array<float>, archived boolean"


def _clusters(n=600, dim=16, seed=5):
    """Centres with neighbours at cosines around 0.9, in two competitions."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 6, dim))
    vec = np.repeat(centre, 6, axis=0) + rng.normal(size=(n // 6 * 6, dim)) * 0.22
    return [(f"r{i:04d}", f"c{i % 2}", [float(x) for x in v], i % 13 == 0) for i, v in enumerate(vec.astype("float32"))]


def _brute(rows, threshold=0.9):
    live = [r for r in rows if r[1] is not None and r[2] is not None and not r[3]]
    links = {r[0]: 0 for r in live}
    for i, a in enumerate(live):
        for b in live[i + 1:]:
            norm = np.linalg.norm(a[2]) * np.linalg.norm(b[2])
            if a[1] == b[1] and norm > 0 and np.dot(a[2], b[2]) / norm > threshold:
                links[a[0]] += 1
                links[b[0]] += 1
    return links


@pytest.mark.parametrize("bucket", [4, 32])
def test_links_of_the_index(spark, bucket):
    rows = _clusters()
    want = _brute(rows)
    got = {r.reflection_id: r.links for r in N.duplicate_links(spark.createDataFrame(rows, SCHEMA), bucket=bucket).collect()}
    assert got.keys() == want.keys() and all(got[k] <= want[k] for k in want)
    assert sum(want.values()) > 500 and sum(got.values()) >= 0.99 * sum(want.values())


def test_recall_and_exact_counts(spark):
    rows = _clusters()
    df = spark.createDataFrame(rows, SCHEMA)
    asked = df.filter(F.substring("reflection_id", 2, 4).cast("int") % 20 == 0)
    want = {k: v for k, v in _brute(rows).items() if int(k[1:]) % 20 == 0}
    for block in (7, 2048):
        assert {r.reflection_id: r.links for r in N.exact_links(asked, df, block=block).collect()} == want
    recall = N.index_recall(asked, df, bucket=8).collect()
    assert sum(r.queries for r in recall) == len(want) and sum(r.links for r in recall) == sum(want.values())
    assert all(r.found >= 0.9 * r.links for r in recall)


def test_copies_are_counted_not_compared(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 5)
    rows = _clusters(120)
    rows += [(f"x{i:03d}", "c0", rows[2][2], False) for i in range(300)]
    rows += [("z0", "c0", [0.0] * 16, False), ("z1", "c0", [0.0] * 16, False), ("n0", "c0", None, False), ("s0", "c0", [1.0], False), ("k0", None, rows[2][2], False)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = _brute([r for r in rows if r[0] != "s0"])
    got = {r.reflection_id: r for r in N.duplicate_links(df, bucket=1000).collect()}  # one bucket, cut into blocks: exact
    assert {k: r.links for k, r in got.items()} == want
    assert got["x000"].class_id == rows[2][0] and got["x000"].copies == 300 and got["z0"].links == 0
    members, classes = N.vector_classes(df)
    assert N.indexed_pairs(classes).filter("class_a = class_b").count() == 0
    assert N.duplicate_links(df.limit(0)).count() == 0


def test_tables_follow_the_threshold():
    assert N.tables_of(0, 0.9) == 1 and N.planes_of(64) == 0 and N.planes_of(65) == 1
    planes = N.planes_of(10 ** 9)
    agree = (1 - np.arccos(0.9) / np.pi) ** planes
    assert (1 - agree) ** N.tables_of(planes, 0.9) <= N.MISS
    # four times the rows: two more hyperplanes, about 1.36 times the tables, against 16 times the pairs
    assert N.tables_of(planes + 2, 0.9) / N.tables_of(planes, 0.9) < 1.4
