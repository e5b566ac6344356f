"""Quality rules with thresholds that follow the data.

Base measures are taken from the whole text.  Ratios of them feed quantile sketches, one per language and source: a
sketch is a histogram over log-linear buckets of whole numbers, so sketches merge by adding counts, in any order and with
the same result.  A document is rejected by the base rules, or when a ratio lies above the fence of its group; fences
replace fixed cut-offs.  A group's sketch is merged with its language's, which counts as much as ``PRIOR`` documents:
the larger a group, the more it decides itself, without a size at which the rule changes.  Centre and spread are taken
at and below the lower quartile, where junk does not reach while it is less than three quarters of a group, and no
fence lies above ``REACH`` times its language's.

Null text counts as empty and fails the base rules; null languages and sources form groups of their own; equal rows get
equal verdicts; an empty table gives an empty result; further columns are kept by ``keep_good`` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name, pieces, stage
from .words import chain, mix, solid_bytes, split_words, word_hashes

SYMBOLS = b"#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"
#: Ratio in hundredths of a percent, and how far above the lower quartile a document may always be.
RATIOS = {"symbols": 1500, "dup_lines": 3000, "repeats": 4000, "upper": 2500}
#: Documents that the language's sketch counts for in each group, the width of the fence in spreads, and the most that
#: a group's fence may be of its language's.
PRIOR, WIDTH, REACH = 50, 6, 4


def measure(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The measures of each text of a piece, in the order of ``MEASURES``."""
    rows = len(bounds) - 1
    starts, ends, row = split_words(data, bounds)
    n_words = np.bincount(row, minlength=rows)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[bounds[1:]] - total[bounds[:-1]]

    points = ((data & 0xC0) != 0x80) & solid_bytes(data)
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    repeated = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        key = chain(word_hashes(data, starts, ends), 3) ^ mix(row[2:].astype(np.uint64) + np.uint64(7))
        key = np.where(row[2:] == row[:-2], key, np.uint64(0))
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        again = (count[back] >= 2) & (row[2:] == row[:-2])
        for k in range(3):
            repeated[k : len(repeated) - 2 + k] |= again
    lines, copies = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    raw = data.tobytes()
    for i in range(rows):
        own = [x for x in raw[bounds[i] : bounds[i + 1]].split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        lines[i], copies[i] = len(own), len(own) - len(set(own))
    return [
        n_words,
        per_row(points),
        per_row(table[data]),
        copies,
        np.bincount(row, weights=repeated, minlength=rows).astype(np.int64),
        lines,
        per_row((data >= 65) & (data <= 90)),
    ]


def with_measures(docs: DataFrame, text: str = "text", into: str = "measures") -> DataFrame:
    """``docs`` with a struct column of measures; every other column stays as it is."""
    source = docs.columns.index(text)
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in pieces(batch.column(source)):
                found = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in measure(data, bounds)], names)
                part = batch.slice(low, high - low)
                yield pa.record_batch([*part.columns, found], [*part.schema.names, into])

    found = T.StructType([T.StructField(x, T.LongType()) for x in names])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, found)]))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def ratios(m: Column) -> dict[str, Column]:
    """Whole numbers, so that buckets do not depend on rounding."""
    per = lambda a, b: F.when(m[b] > 0, F.expr("bigint(10000)") * m[a]).otherwise(0).cast("long")
    over = lambda a, b: F.floor(per(a, b) / F.greatest(m[b], F.lit(1))).cast("long")
    return {
        "symbols": over("n_symbols", "n_words"),
        "dup_lines": over("n_dup_lines", "n_lines"),
        "repeats": over("n_repeat_words", "n_words"),
        "upper": over("n_upper", "word_chars"),
    }


def bucket(value: Column) -> Column:
    """Log-linear bucket, named by its least value: exact below 64, then 32 buckets for each doubling."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    width = F.pow(F.lit(2.0), drop).cast("long")
    return (F.floor(value / width) * width).cast("long")


def sketch(measured: DataFrame, keys: list[str], m: str) -> DataFrame:
    """``keys, ratio, bucket, n``: mergeable by adding ``n``."""
    values = F.array(*(F.struct(F.lit(k).alias("ratio"), bucket(v).alias("bucket")) for k, v in ratios(F.col(m)).items()))
    return (
        measured.where(~base_failed(F.col(m)))
        .select(*keys, F.explode(values).alias("v"))
        .groupBy(*keys, "v.ratio", "v.bucket")
        .agg(F.count("*").alias("n"))
    )


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))


def blended(own: DataFrame, wide: DataFrame) -> DataFrame:
    """``lang, source, ratio, bucket, n``: each group's sketch merged with its language's in the weight of ``PRIOR``
    documents.  Counts are multiplied by the language's documents, so that weights stay whole numbers."""
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    docs = wide.groupBy(F.col("lang").alias("of"), F.col("ratio").alias("r")).agg(F.sum("n").alias("docs"))
    scaled = own.join(docs, F.col("lang").eqNullSafe(F.col("of")) & (F.col("ratio") == F.col("r")))
    scaled = scaled.select("lang", "source", "ratio", "bucket", (exact("n") * exact("docs")).alias("n"))
    groups = own.select("lang", "source").distinct()
    prior = groups.join(wide.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")))
    prior = prior.select("lang", "source", "ratio", "bucket", (exact("n") * F.lit(PRIOR)).alias("n"))
    return merged(scaled.unionByName(prior), ["lang", "source"])


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, ratio, quartile, fence``.  A group has at most some 350 buckets for each ratio, whatever its documents."""
    group = [*keys, "ratio"]
    running = Window.partitionBy(*group).orderBy("bucket")
    whole = Window.partitionBy(*group)
    ranked = sketches.withColumn("upto", F.sum("n").over(running)).withColumn("docs", F.sum("n").over(whole))
    at = lambda percent: F.min(F.when(100 * F.col("upto") >= percent * F.col("docs"), F.col("bucket")))
    slack = F.create_map(*(F.lit(x) for pair in RATIOS.items() for x in pair))[F.col("ratio")]
    return (
        ranked.groupBy(*group)
        .agg(at(25).alias("quartile"), at(5).alias("low"))
        .select(*group, "quartile", (F.col("quartile") + WIDTH * (F.col("quartile") - F.col("low")) + slack).alias("fence"))
    )


def thresholds(measured: DataFrame, lang: str, source: str, m: str) -> DataFrame:
    """``lang, source, limits``: one map from ratio to fence for each group that occurs."""
    own_sketch = sketch(measured.select(F.col(lang).alias("lang"), F.col(source).alias("source"), m), ["lang", "source"], m)
    own_sketch = stage(own_sketch, "quality-sketch")
    wide_sketch = merged(own_sketch, ["lang"])
    own = fences(blended(own_sketch, wide_sketch), ["lang", "source"]).alias("own")
    wide = fences(wide_sketch, ["lang"]).alias("wide")
    same = F.col("own.lang").eqNullSafe(F.col("wide.lang")) & (F.col("own.ratio") == F.col("wide.ratio"))
    return (
        own.join(wide, same)
        .select("own.lang", "own.source", "own.ratio", F.least(F.col("own.fence"), REACH * F.col("wide.fence")).alias("fence"))
        .groupBy("lang", "source")
        .agg(F.map_from_entries(F.collect_list(F.struct("ratio", "fence"))).alias("limits"))
    )


def judge(measured: DataFrame, limits: DataFrame, lang: str, source: str, m: str, into: str) -> DataFrame:
    """Adds ``into``: whether the row passes the base rules and its group's fences.  Groups without a fence have only
    rows that fail the base rules."""
    g, s, lim = (fresh_name(measured, x) for x in ("lang", "source", "limits"))
    renamed = limits.select(F.col("lang").alias(g), F.col("source").alias(s), F.col("limits").alias(lim))
    joined = measured.join(
        renamed, measured[lang].eqNullSafe(F.col(g)) & measured[source].eqNullSafe(F.col(s)), "left"
    )
    within = F.lit(True)
    for name, value in ratios(F.col(m)).items():
        within = within & (value <= F.col(lim)[name])
    return joined.withColumn(into, ~base_failed(F.col(m)) & F.coalesce(within, F.lit(True))).drop(g, s, lim)


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base measures, ``base_failed`` and ``kept`` of every document."""
    m = "measures"
    narrow = with_measures(docs.select("doc_id", "lang", "source", "text"), into=m)
    narrow = stage(narrow.select("doc_id", "lang", "source", m), "quality-measures")
    judged = judge(narrow, thresholds(narrow, "lang", "source", m), "lang", "source", m, "kept")
    base = [F.col(f"{m}.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *base, base_failed(F.col(m)).alias("base_failed"), "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged.  Texts are measured twice rather than written twice."""
    m, kept = fresh_name(docs, "measures"), fresh_name(docs, "kept")
    narrow = with_measures(docs.select("lang", "source", "text"), into=m).select("lang", "source", m)
    limits = thresholds(narrow, "lang", "source", m)
    judged = judge(with_measures(docs, into=m), limits, "lang", "source", m, kept)
    return judged.where(F.col(kept)).select(*(F.col(f"`{c}`") for c in docs.columns))
