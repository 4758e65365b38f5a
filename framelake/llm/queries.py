"""The queries of this subpackage: (spark, sf_dir) -> DataFrame, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chat import format_chats
from .common import table
from .fingerprint import fingerprints
from .mixing import replicated
from .neardup import near_duplicates
from .pieces import encode_documents
from .pii import surrogate_key, with_surrogates
from .quality import quality_scores
from .topk import top_k_inner
from .vocab import token_counts
from .warc import warc_revisits

#: Where vocabulary files of public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"


def op1_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisits(spark, table(spark, sf_dir, "pages")).drop("target_uri")


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(spark, table(spark, sf_dir, "documents"), surrogate_key(spark))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_inner(spark, table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark, table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op7_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, table(spark, sf_dir, "documents"))


def op9_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicated(spark, table(spark, sf_dir, "documents"))


def op10_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_revisit, op2_pii_surrogates, op3_exact_topk, op4_token_counts, op5_minhash_neardup, op6_sentencepiece, op7_quality_attention, op8_chunk_fingerprints, op9_poisson_mixing, op10_chat_repair,
    )
}
