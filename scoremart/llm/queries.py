"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoremart.session import scratch_path

from . import bpe, decontaminate, filter_audit, html_text, jaccard_join, merkle, mixing, quality_model, quality_rules, sql, suffix_dedup, token_file, token_lengths, warc
from .common import stage

RANKS = vocabularies.path("byte_bpe_multi_50k.tiktoken")
WORD_TOKENIZER = vocabularies.path("word_bpe_49k.json")
END_ID = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    warc.write_archives(pages, f"{path}/archive")
    archives = warc.read_archives(spark, f"{path}/archive")
    warc.write_index(stage(warc.index_entries(archives), "warc-entries"), f"{path}/index")
    index = warc.read_index(spark, f"{path}/index")
    keys = pages.select("url").distinct().mapInArrow(warc.url_keys, "surt string")
    found = stage(warc.look_up(index, keys), "warc-found")
    return warc.resolve(stage(warc.read_records(found, archives).drop("payload"), "warc-records"))


def op2_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_lengths.encoded_lengths(table(spark, sf_dir, "documents"), RANKS, vocabularies.PATTERN)
    return token_lengths.suffix_sums(stage(token_lengths.length_histogram(lengths), "length-histogram"))


def op3_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), RANKS, vocabularies.PATTERN)
    return bpe.with_decoded(encoded, RANKS, digests=True)


def op6_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


def op7_universe_partition_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), jaccard_join.Rule(words=4, percent=85))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(table(spark, sf_dir, "documents"))


def op9_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op10_huffman_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-file")
    ids = token_file.staged_ids(table(spark, sf_dir, "documents"), WORD_TOKENIZER, END_ID)
    token_file.write_token_file(ids, path)
    return token_file.read_token_file(spark, path, digest=True)


def op11_block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(*mixing.mix_sources(table(spark, sf_dir, "documents")))


def op12_merkle_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(merkle.manifest(table(spark, sf_dir, "documents")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_index,
        op2_token_lengths,
        op3_latent_decontamination,
        op4_random_indexing_quality,
        op5_byte_bpe,
        op6_adaptive_rules,
        op7_universe_partition_join,
        op8_suffix_array_dedup,
        op9_tag_path_text,
        op10_huffman_file,
        op11_block_mix,
        op12_merkle_windows,
        op13_filter_audit,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op6_adaptive_rules": sql.ADAPTIVE_RULES,
    "op7_universe_partition_join": sql.jaccard_components(words=4, percent=85),
    "op12_merkle_windows": sql.MERKLE,
    "op13_filter_audit": sql.FILTER_AUDIT,
}
