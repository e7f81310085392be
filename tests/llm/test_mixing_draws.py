"""The offset of a source is the best of several draws."""

from pyspark.sql import functions as F

from ledgerlark.llm import mixing


def test_more_draws_miss_the_target_by_no_more(spark):
    rows = [(i, " ".join(["w"] * (1 + i * i % 17)), None if i % 4 == 3 else "abc"[i % 4]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")

    def misses(draws):
        taken = mixing.mix(df, draws=draws).groupBy("source").agg(F.abs(F.sum("taken") - F.first("target")).alias("miss"))
        return {r["source"]: r["miss"] for r in taken.collect()}

    one, many = misses(1), misses(16)
    assert len(many) == 4 and all(many[s] <= one[s] for s in one) and sum(many.values()) < sum(one.values())
