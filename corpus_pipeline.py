"""The corpus pipeline: five of the numbered operators in a row, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Tables written between the stages are the caller's: run() writes them to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestry.llm import decontaminate, exact_dedup, ngram_join, packing, toxicity
from attestry.llm.common import table, written
from attestry.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the lexicon is learned from all labelled rows of documents."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at a Jaccard similarity of 0.8 the smallest doc_id stays."""
    return ngram_join.keep_one(docs, width=5, share=(80, 100))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of a benchmark item's 5-word shingles go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), threshold=0.8, width=5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents left, as packed pieces of at most 2048 tokens a sequence."""
    return packing.pack_documents(docs, tokenizer_path(), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("best_fit_packing", pack),
]

#: Language-model restoration, shingle links and vector packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
