"""A training corpus from documents: quality rules, language identification, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a
DataFrame that is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bidscreen.llm import language, near_duplicates, packing, quality
from bidscreen.llm.common import materialize
from bidscreen.llm.queries import table, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the threshold table go."""
    return quality.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't recognised go: those without a letter, with a posterior under one half, or whose
    n-grams are far less likely than the texts that the likeliest language was learned from."""
    return language.keep_known(docs, language.train(docs))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    return near_duplicates.keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("n-gram Jaccard join", jaccard_join), ("best-fit packing", best_fit_packing)]

#: The language classifier and the tokenizer have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, "stage")
    return docs
