"""The corpus pipeline: toxicity, exact and near duplicates, mixing and tokenizing, each stage stored before the next reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlark.llm import bpe, exact_dedup, jaccard, mixing, simhash, toxicity
from ledgerlark.llm.common import stored


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, fitted on the given documents and their labels, does not reject."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are linked by sharing at least 0.8 of their five-word shingles.

    Operator 5's fingerprints and their byte-position index propose pairs, which the shingles of both texts verify: a tree of each class
    of fingerprints, and where a link of it is turned down, all pairs of the class that are not connected yet. Fingerprints alone
    do not decide: pairs of that share lie up to 18 bits apart, so prefix lists find those that the verified pairs leave unconnected.
    """
    return jaccard.keep_one(docs, propose=simhash.text_links, rest=simhash.text_pairs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources draws them."""
    return mixing.emit(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of each document, and the digest of the bytes that they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", clean), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("byte_bpe", tokens)]

# The first stage learns a model and the last calls a tokenizer library; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
