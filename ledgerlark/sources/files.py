"""Text sources and file sinks: training tables, leaderboards, submission listings, prediction files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV with header; pass a schema on large inputs, inference reads the file twice."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_snapshot(df: DataFrame, path: str) -> DataFrame:
    """Store a frame as Parquet and return the scan of it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def leaderboard_scores(df: DataFrame, score: str = "Score") -> DataFrame:
    """Leaderboard rows whose score parses as a number; one row per team, so no leaderboard has to fit into one value."""
    return df.withColumn("score", F.expr(f"try_cast(`{score}` AS double)")).filter("score IS NOT NULL")


def leaderboard_rows(snapshots: DataFrame) -> DataFrame:
    """(competition_id, score): the newest snapshot of every competition, one row per team; null scores are left out."""
    newest = snapshots.groupBy("competition_id").agg(F.max("fetched_at").alias("fetched_at"))
    return snapshots.join(newest, ["competition_id", "fetched_at"]).select("competition_id", F.explode("scores").alias("score")).filter("score IS NOT NULL")


def parse_submission_listing(lines: DataFrame, line: str = "value") -> DataFrame:
    """Listing lines ``description,status,publicScore`` without the warnings the tool prints before them.

    The status keeps its last dotted part in lower case: complete, error and invalid are final, all others pending.
    Only a complete row has a score, and only if it parses.
    """
    rows = lines.filter(~F.startswith(F.col(line), F.lit("Warning:")))
    parsed = rows.withColumn("_r", F.from_csv(F.col(line), "description string, status string, publicScore string"))
    raw = F.lower(F.coalesce("_r.status", F.lit("")))
    status = (
        F.when(raw.endswith("complete"), "complete")
        .when(raw.endswith("error") | raw.endswith("invalid"), F.element_at(F.split(raw, r"\."), -1))
        .otherwise("pending")
    )
    out = parsed.withColumn("description", F.trim("_r.description")).withColumn("state", status)
    score = F.when(F.col("state") == "complete", F.expr("try_cast(_r.publicScore AS double)"))
    return out.withColumn("score", score).drop("_r")


def listing_state(listing: DataFrame, message: str) -> DataFrame:
    """The rows of a parsed listing whose description equals the submitted message."""
    return listing.filter(F.col("description") == message)


def write_predictions(predictions: DataFrame, id_col: str, value_col: str, target: str, path: str,
                      sample_columns: list[str] | None = None) -> DataFrame:
    """Write the id and the value column; the value is named like the sample's second column, else the target."""
    name = sample_columns[1] if sample_columns and len(sample_columns) > 1 else target
    out = predictions.select(F.col(id_col), F.col(value_col).alias(name))
    out.write.mode("overwrite").option("header", True).csv(path)
    return out


def strip_header(text: Column, separator: str) -> Column:
    """Text after the first separator line, trimmed; the whole text where there is none."""
    at = F.instr(text, separator + "\n")
    body = F.when(at > 0, F.substr(text, at + F.lit(len(separator) + 1))).otherwise(text)
    return F.regexp_replace(body, r"^\s+|\s+$", "")
