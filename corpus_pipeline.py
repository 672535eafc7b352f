"""The corpus pipeline: five operators in a row over the documents."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import bpe, exact_dedup, mixing, quality_classifier, simhash
from newsloom.storage import materialize, table


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.draw(docs)


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_classifier", _quality),
    ("exact_dedup", _exact),
    ("simhash_near_dedup", _near),
    ("mixing", _mix),
    ("bpe", _encode),
]

#: A trained classifier, fingerprints and drawn weights are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
