"""From raw documents to packed sequences: quality, near-duplicates, personal data, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterscope.llm.common import materialize, table
from meterscope.llm.jaccard import drop_near_duplicates
from meterscope.llm.mixing import mix
from meterscope.llm.packing import pack_documents
from meterscope.llm.pii import redact
from meterscope.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and whose posterior to be good is at least one half. Null and empty
    texts go; rows that repeat are judged alike; all columns stay."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five words, similarity 0.8), the one with the least doc_id, null
    last. Rows that share an id but not a text are judged apart; rows without words all stay; all columns stay."""
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its spans of personal data replaced by their kind, and n_chars counted anew where something
    was replaced. Null texts stay null; all rows and columns stay."""
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for, none to twice; a null source is one of its own.
    Copies are equal rows; all columns stay."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece of at most 2048 tokens: where it lies in its document and in its sequence. Null and empty texts
    are their end token; copies are packed each. No other columns."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packing),
]

#: The quality stage's expectation-maximisation and the tokenizer are beyond SQL; tests check the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each on what the one before it has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
