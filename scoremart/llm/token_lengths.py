"""Exact token-length histogram with suffix sums.

Documents are aggregated by encoded length; sums over all greater lengths then answer totals, quantiles and truncated
totals for any context limit without touching the documents again.

Null and empty texts have length 0; repeated rows count each; an empty table gives an empty histogram, totals of 0 and
null quantiles; columns other than the text are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lengths per bucket of the first summation level.
BUCKET = 1024


def rank_encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """An encoding from a file of base64 token and rank pairs."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """Column ``n_tokens``: the encoded length of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(ranks, pattern)
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(x)) if x else 0 for x in (v.as_py() for v in batch.column(0))]
            yield pa.record_batch([pa.array(sizes, pa.int64())], ["n_tokens"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """``n_tokens, n_docs``: counts are combined in each task before the exchange."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Adds to each length L: documents and tokens of length L or more, documents of length L or less, and
    ``truncated_tokens``, the corpus total when every document is cut to L tokens.

    Sums run inside buckets of lengths and over the few bucket totals, so no task sorts all lengths.
    """
    keyed = histogram.withColumn("bucket", F.floor(F.col("n_tokens") / BUCKET)).withColumn(
        "tokens", F.col("n_tokens") * F.col("n_docs")
    )
    totals = keyed.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    both = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "bucket",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.sum("d").over(both).alias("d_all"),
        F.sum("t").over(both).alias("t_all"),
    )
    inside = Window.partitionBy("bucket").orderBy(F.col("n_tokens").desc())
    out = (
        keyed.withColumn("d_in", F.sum("n_docs").over(inside))
        .withColumn("t_in", F.sum("tokens").over(inside))
        .join(totals, "bucket")
        .withColumn("docs_at_least", F.col("d_above") + F.col("d_in"))
        .withColumn("tokens_at_least", F.col("t_above") + F.col("t_in"))
    )
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("d_all") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
        (F.col("t_all") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
    )


def total_tokens(sums: DataFrame) -> int:
    """Tokens of the whole corpus."""
    return sums.agg(F.max("tokens_at_least")).first()[0] or 0


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Corpus tokens when each document is cut to ``limit``; the limit need not occur as a length."""
    longer = sums.where(F.col("n_tokens") > limit).agg(F.max("tokens_at_least"), F.max("docs_at_least")).first()
    return total_tokens(sums) - (longer[0] or 0) + limit * (longer[1] or 0)


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that at least the fraction ``q`` of all documents does not exceed."""
    docs = sums.agg(F.max("docs_at_least")).first()[0]
    if docs is None:
        return None
    return sums.where(F.col("docs_at_most") >= F.lit(q) * docs).agg(F.min("n_tokens")).first()[0]
