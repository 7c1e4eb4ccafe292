"""A corpus, from raw documents to token ids: quality, language, near duplicates, benchmark leaks, pieces.

Every stage takes all documents that the one before kept, as rows of a Parquet table in the shared folder.  Nulls, empty texts,
repeated rows and extra columns are treated as each stage's operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rostrum.llm import decontam, langid, pieces, quality, simhash
from rostrum.llm.storage import written

#: Least score of a document's language.
CONFIDENT = 0.5


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are near enough to the trusted ones."""
    return quality.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the model is sure of."""
    return langid.confident(docs, langid.learn(docs), CONFIDENT)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.one_of_each(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def in_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their sampled pieces."""
    return pieces.encode(docs)


STAGES = [("quality", good), ("language", in_a_language), ("near_duplicates", distinct), ("decontamination", unseen), ("sentencepiece", in_pieces)]
#: SQL has neither the hashes nor the models of these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
