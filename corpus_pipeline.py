"""Corpus pipeline: documents go through the stages in order, each written and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from panelloom.llm import bpe, mixing, ngram_join, pii, quality_rules
from panelloom.llm.common import shared_dir, table
from panelloom.llm.queries import vocabulary


#: Shares of the mixing stage. Quality rules have taken out what is "poor", of which hardly a token is left: it has no target here, as a share of it
#: would be made of a few documents dealt some ten thousand times.
TARGETS = {"good": 0.97, "toxic": 0.03}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram similarity."""
    return ngram_join.keep_one(docs)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents dealt out at the rates that bring the domains to their target shares."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), TARGETS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the texts left."""
    return bpe.digests(docs, vocabulary())


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("PII", redaction), ("mixing sources to target weights", mixture), ("BPE encoding and decoding", tokens)]

#: None: boosted trees, fitted rates and byte pairs have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
