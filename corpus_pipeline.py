"""The corpus pipeline over ``documents``: language ID, exact and near dedup, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``, and any others that there are, as they came and whatever
their names. Texts are read whole, however long; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import exact_dedup, jaccard_join, langid, packing, pii
from palimpsest.llm.common import materialize, table

#: A text goes when less than this part of its n-grams is known to its best language; texts of sf0.1 have 0.5 and more.
LEAST_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language that was learned from the labelled ones stay; null and empty texts and those without a letter go.
    Repeated rows are judged each for itself; null ids and languages do no harm."""
    return langid.identified(docs, LEAST_LANGUAGE_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the one with the largest doc_id stays; where all ids
    are null, the smallest text by bytes. Null text counts as empty, repeated rows of one id collapse into one."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by a Jaccard similarity of 0.8 on five-word shingles, the one with the smallest doc_id stays."""
    return jaccard_join.dedup(docs, size=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows the text."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of at most 2048 tokens."""
    return packing.op1_query(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("jaccard_join", near), ("pii", personal_data), ("packing", pack)]

#: Language ID, shingle sets of whole texts, span scans and packing have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
