"""A training-data pipeline of five stages over the table documents, each written as Parquet and read as the next
stage's input. Counted as part of the subpackage llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm.language import known_languages, train
from twinfold.llm.near_copies import without_near_copies
from twinfold.llm.packing import pack
from twinfold.llm.quality import good_documents
from twinfold.llm.shared import written
from twinfold.llm.surrogates import surrogate_key, surrogates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of known n-grams below which the language of a document counts as unknown.
LEAST_LANGUAGE_SCORE = 0.2
#: Percent of common word shingles from which on two documents are near copies.
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; null and letterless texts go."""
    docs = docs.select(COLUMNS)
    return known_languages(docs, train(docs), LEAST_LANGUAGE_SCORE)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are like some language's reference."""
    return good_documents(docs.select(COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, one row of equal ones."""
    return without_near_copies(docs.select(COLUMNS), NEAR_PERCENT)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and secrets; n_chars is counted anew."""
    return surrogates(docs.select(COLUMNS), surrogate_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens."""
    import public_tokenizers as vocabularies

    return pack(docs, vocabularies.path("word_bpe_49k.json"), end_id=1)


STAGES = [("language ID", language_id), ("quality rules", quality_rules), ("MinHash near-dedup", near_duplicates), ("PII surrogates", private_data), ("packing", packing)]
#: Language ID, near copies, surrogates and packing have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
