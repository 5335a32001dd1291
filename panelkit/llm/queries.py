"""Queries of the training-data operators, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._common import table
from .byte_bpe import round_trip_digests
from .chat_format import CONVERSATIONS_SQL, preference_segments, swapped_responses
from .chat_repair import REPAIR_SQL, repair_of_damaged
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .hard_negatives import MINED_SQL, mined
from .html_extract import extract_main_text
from .jaccard_join import jaccard_components
from .langid import language_id
from .licenses import scan_licenses
from .packing import pack_documents
from .pii import find_pii
from .substring_dedup import substring_repeats

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file, installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_repeats(table(spark, sf_dir, "documents"))


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_segments(*swapped_responses(table(spark, sf_dir, "conversations")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_of_damaged(table(spark, sf_dir, "conversations"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (
    op1_exact_dedup, op2_jaccard_join, op3_substring_dedup, op4_preference_format, op5_decontaminate, op6_pii,
    op7_language_id, op8_licenses, op9_html_extract, op10_packing, op11_conversation_repair, op12_byte_bpe,
    op13_hard_negatives)}

ORACLE: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op4_preference_format": CONVERSATIONS_SQL,
    "op11_conversation_repair": REPAIR_SQL,
    "op13_hard_negatives": MINED_SQL,
}
