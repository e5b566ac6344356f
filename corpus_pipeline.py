"""A corpus in five stages: quality rules, near duplicates, repeated passages, benchmark passages, token ids.

Each stage is written as Parquet and read again as the next one's documents.  All but the last return the columns of
``documents``; the last returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document that is left.

* quality_rules drops documents that fail the base rules or lie above their group's adaptive thresholds;
* near_duplicates keeps the least id of each component of word-shingle links (five words, similarity 0.8 or more);
* repeated_passages cuts every string of 50 bytes that an earlier document has, by whole characters;
* benchmark_passages drops documents that hold a passage of the benchmark;
* token_ids encodes the texts byte by byte and decodes them again.

The operators' modules state what they do with nulls, empty and long texts, ties, repeated rows, empty tables and
further columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scoremart.llm import bpe, decontaminate, jaccard_join, quality_rules, queries, suffix_dedup
from scoremart.llm.common import one_thread_each, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # As benchmark_passages asks for: executors keep idle Python workers of each environment, so all stages have one.
    one_thread_each(spark)
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, jaccard_join.Rule(words=5, percent=80))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(docs, queries.RANKS, queries.vocabularies.PATTERN)
    return bpe.with_decoded(encoded, queries.RANKS, digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("token_ids", token_ids),
]

#: The stages are beyond SQL; tests compare them with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
