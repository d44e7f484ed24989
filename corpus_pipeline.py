"""The corpus pipeline: each stage calls one operator of ``lodestone.llm`` on all that its predecessor kept.

Every stage but the last returns the columns of its input, and takes empty tables, tables of nulls, repeated rows and further columns (but
those whose names begin in two underscores, which operators keep for themselves and refuse).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import langid, mixing, pii, sentencepieces, simhash
from lodestone.llm.common import materialize, table
from lodestone.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Null, empty and letterless texts go; equal texts are judged alike, whatever their ids; where nothing is labelled, all go. Texts may have any length.
    """
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id, of rows that share it or have none a fixed one.

    Null and empty texts are copies of one another; of equal rows one stays; rows with equal ids and different texts are judged apart.
    """
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked: every row stays, and n_chars follows the text.

    Null texts stay null; overlapping spans become one tag; time is linear in a text's length.
    """
    return pii.mask(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each copy at its own training position and sorted by it.

    Null, empty and blank texts have no words and go; a null source is a source of its own; repeated rows count each.
    """
    return mixing.mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is written for training: ids described per document, checked by decoding.

    Null and empty texts have no ids; repeated rows get equal results; text without spaces is as good as any.
    """
    return sentencepieces.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixing_weights),
    ("sentencepiece", sentencepiece),
]
#: Trained models and tokenizers are beyond SQL; tests hold every stage against rows planted in a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
