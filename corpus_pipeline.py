"""The corpus pipeline: quality rules, near duplicates, secrets, packing, each over all the one before kept.

Defined results: a document without text fails the quality rules; rows that repeat an id are rows of their
own, of which exact repeats stay once; a null id stays null; further columns, whatever their names, pass
through all stages but the last; n_chars is counted again where it is a column; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import jaccard, packing, quality, secrets
from skylattice.llm import textkit as tk

NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality_filter(docs, tk.table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return jaccard.near_filter(spark, docs, NEAR_WORDS, NEAR_PERCENT)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted again."""
    clean = secrets.redact_secrets(spark, docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place."""
    return packing.pack(spark, docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("secret_scans", secret_stage),
    ("best_fit_packing", packing_stage),
]
#: The likelihood ratio hashes n-grams as SQL cannot; tests/llm holds a brute-force version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; what a stage wrote goes when the next has been written."""
    docs = tk.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = tk.materialize(spark, stage(spark, docs, sf_dir), name)
        tk.discard(spark, docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
