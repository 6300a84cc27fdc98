"""A training-data pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before has
kept, and returns a DataFrame that is written as Parquet and read again for the
next one. All but the last return the columns of documents. Rows that repeat are
each judged; further columns of any name stay as they are; an empty table gives an
empty result; texts are read whole at any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import bpe, mixing, neardup, quality, secrets
from fieldloom.llm.common import table
from fieldloom.llm.queries import vocabulary
from fieldloom.runtime import new_path

#: Domains of the mixture and their shares of its tokens. Toxic tokens come down to the share that texts without a
#: sign of a domain are expected to have (labels are noisy, so it isn't 0); clean documents stay as often as they are.
DOMAINS = {"toxic": "toxic = 1", "clean": "toxic = 0"}
TARGETS = {"clean": 1.0, "toxic": None}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, those with a null or blank text among them."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity of 0.8 or more. Null ids and blank texts stay."""
    return neardup.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced in the text; n_chars follows. A null text stays null."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay with the probability of their rate, so that the domains' tokens meet the targets. Rows that repeat
    an id and a text stay or go together; without labels or without documents all stay."""
    return mixing.sample(docs, mixing.fit_mixture(docs, table(spark, sf_dir, "labels"), DOMAINS, TARGETS, "clean", most=1.0, weak=0.0, slack=None)[0])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token digests of every document left; a null text is empty."""
    return bpe.round_trip(docs, vocabulary())


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("mixture", mixture), ("tokens", tokens)]

#: SQL cannot express hashed n-gram ratios, fitted rates or byte-level merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
