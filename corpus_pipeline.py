"""From documents to packed sequences: quality classifier, quality rules, near-dedup, packing.

Defined cases, for every stage: an empty table gives an empty one; repeated rows and ids are rows of
their own until near-dedup, which keeps one of each group; other columns than doc_id and text,
whatever their names, pass through the first three stages as they were (n_chars follows the text).
Null texts, and texts without a word, go with the classifier; alone, the rules drop them too,
near-dedup keeps one of them, and packing gives them the end id. Long texts are read as a whole.
Rows with a null id are judged like others; near-dedup prefers rows with an id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandline.llm import packing, quality, rules, simhash
from strandline.llm.common import Scratch, read_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps."""
    return quality.keep_documents(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without their failing lines."""
    return rules.clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    return simhash.deduplicate(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1).drop("row_id")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: DuckDB can't express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written and read again as the next one's input.

    A stage's table is dropped when the next one's is written; the last one's stays, as the result.
    """
    scratch = Scratch(spark, "pipeline")
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
