"""Helpers shared by the text operators: shared storage, hidden names, row keys, running sums, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``; a local one only in local mode where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="ledgerlark-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later steps read stored rows, whatever executor is lost."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The frame written once as Parquet below the shared folder, and the scan of it."""
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def whole(text: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text), F.lit(""))


def id_key(doc_id: Column) -> Column:
    """An id as text with a value of its own for null, so that equi-joins match nulls."""
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def running_sum(df: DataFrame, group: list[str], order: list[Column], values: dict[str, str]) -> DataFrame:
    """Adds inclusive running sums of integer columns within a group, in the given order.

    No group goes to one task: rows are dealt by ranges of (group, order), each range is summed on its own, and one row per
    range and group carries the sums across. Rows that tie in the order are dealt by a row number, stored before it is used.
    ``values`` maps new names to summed columns.
    """
    part, tie = free_name(df, "_part"), free_name(df, "_tie")
    ordered = [F.col(c) for c in group] + order + [F.col(tie)]
    ranged = cut(df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*ordered).withColumn(part, F.spark_partition_id()))
    keys = {c: f"_k{i}{part}" for i, c in enumerate(group)}
    for c, k in keys.items():
        ranged = ranged.withColumn(k, id_key(F.col(c)))
    by = [part, *keys.values()]
    within = Window.partitionBy(*by).orderBy(*order, F.col(tie)).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys.values()).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*by).agg(*[F.sum(v).alias(f"{part}{i}") for i, v in enumerate(values.values())])
    before = sums.select(*by, *[F.coalesce(F.sum(f"{part}{i}").over(across), F.lit(0)).alias(f"{part}b{i}") for i in range(len(values))])
    local = ranged.withColumns({name: F.sum(v).over(within) for name, v in values.items()})
    joined = local.join(before, by)
    return joined.select(*df.columns, *[(F.col(name) + F.col(f"{part}b{i}")).alias(name) for i, name in enumerate(values)])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root being the smallest node that can be reached.

    Alternates large-star and small-star steps; minima are partial aggregates and stars are joins, so no neighbourhood is
    collected. Every step is checkpointed; a step that changes no edge ends the loop.
    """
    def star(e: DataFrame, both: bool) -> DataFrame:
        arcs = e.union(e.select("b", "a").toDF("a", "b")) if both else e
        low = arcs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "c")
        kept = arcs.filter("b > a") if both else arcs
        out = kept.join(low, F.col("a") == F.col("c")).select(F.col("b").alias("x"), "m")
        if not both:
            out = out.union(low.select(F.col("c").alias("x"), "m"))
        return out.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()

    current, mark = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()), None
    while True:
        # the large star needs both directions; the small star has a > b and gives every node its smallest neighbour
        current = cut(star(star(current, True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False))
        now = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (now["n"], now["h"]):
            break
        mark = (now["n"], now["h"])
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
