"""Pipeline over documents: language ID, exact dedup, n-gram Jaccard join,
benchmark decontamination, best-fit packing. Each stage works on all rows that
the one before kept; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import decontaminate, exact_dedup, jaccard_join, langid, packing
from panelkit.llm._common import materialise, table
from panelkit.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: rejects texts without a letter
    (null and empty ones too) and those of which the model is unsure."""
    return langid.keep_identified(docs, langid.train(langid.fold_rows(docs)))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the smallest id."""
    kept = exact_dedup.exact_dedup(docs).where("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    same = docs["doc_id"].eqNullSafe(kept["_id"]) & (digest == kept["_sha"])
    # rows that repeat whole are one document; equal ids are in one partition here
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect, that with the smallest
    id; documents without an id stay."""
    gone = jaccard_join.jaccard_components(docs).where("component_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of a benchmark item stands."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, tokenised and packed into sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("exact_dedup", exact_duplicates), ("jaccard_join", near_duplicates),
          ("decontamination", clean_of_benchmark), ("packing", packed)]

#: A trained classifier and a tokenizer have no SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
