"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, license_scan, mixing, pii, repetition, sentencepieces, simhash, tool_calls, topk, wavelet
from .common import table

try:
    import public_tokenizers
except ImportError:  # paths are parameters; the queries need the files
    public_tokenizers = None


def tokenizer_path(name: str) -> str:
    if public_tokenizers is None:
        raise FileNotFoundError(f"no folder of tokenizers holds {name}")
    return public_tokenizers.path(name)


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link_conversations(table(spark, sf_dir, "conversations"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_file(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), special_as_text=False, lookups=True)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_repetition, op2_license_scan, op3_sentencepiece, op4_tool_calls, op5_mixing, op6_topk, op7_pii, op8_langid, op9_wavelet, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.SQL
