"""The training-data pipeline: its stages over documents, each written and read again.

Texts that are null, empty or without a letter go in the first stage, so that later ones don't see
them; nulls in other columns are kept. Of a group of near copies the rows of the smallest id stay:
rows without an id all stay, rows that share an id are one document, which goes if one of them is
linked to a smaller id. Ids that repeat across sources are mixed by their own source's budget. Columns of any
other name pass through all stages but the last unchanged. An empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyscope.llm.common import table
from tallyscope.llm.jaccard_join import one_of_each
from tallyscope.llm.langid import in_a_language
from tallyscope.llm.mixing import mixed_documents
from tallyscope.llm.pii import masked
from tallyscope.llm.queries import PIECES
from tallyscope.llm.sentencepiece_codec import encoded_documents
from tallyscope.session import scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no mixture of learned languages explains."""
    return in_a_language(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return one_of_each(docs, words=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind."""
    return masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, cuts and leaves out documents so that sources have their target weights."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix."""
    return encoded_documents(docs, PIECES)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Learned language models and tokenisers have no SQL form; tests compare small corpora instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
