"""Mixing sources to target weights, as shards of fixed-length blocks of words.

Each source's words stand in one row, documents in the order of a hash, and are cut into blocks of ``BLOCK_WORDS``, of
which only the last is shorter.  A source's target in words fixes how many slots it fills: whole passes over its blocks,
then part of a pass, whose last slot is cut so that the words taken are the target, rounded.  Every output shard draws
the sources of its slots from a multinomial of the targets; slots that a source drew beyond its number stay empty, and
closing shards hold those that it drew too few.  The slots of a source, in the order of shards, run through its blocks in
the order of a pseudorandom permutation of their indexes, another one in each pass, and are joined with the blocks by
index.  The mix is a table of pieces, parts of documents: texts need not move until :func:`mixed_texts` cuts them.

Words are longest runs of characters other than space and the control characters 9 to 13; null text has none.  Sources in
the order of code points, null last, weigh 5, 2, 1, 5, ... and share 150 % of all words; a target stops at twice its
source's words and the excess is shared again by weight.  All depends on the rows alone, not on how they are dealt out,
so runs agree; equal rows are told apart by a number only, and each of them has its own place.  Empty documents and
sources have targets and take nothing.  Null ids are ids like others.  An empty table gives an empty result.  Other
columns are ignored.

One row per source goes through the driver, at most ``MOST_SOURCES``; more are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_column, pieces, stage
from .words import mix, solid_bytes, split_words

WEIGHTS = (5, 2, 1)
#: The mix in hundredths of all words, and how often a word may be taken.
PERCENT, PASSES = 150, 2
BLOCK_WORDS = 1024
SHARD_SLOTS = 1024
#: Groups of equal documents whose places one window counts.
BUCKET_DOCS = 1 << 14
MOST_SOURCES = 100_000
SEED = 20_240_917


# ── the plan: one row per source ─────────────────────────────────────────────────────


@dataclass
class Plan:
    """Sources in order with their words and targets, and the slots that reach them."""

    names: list[str | None]
    words: np.ndarray
    targets: np.ndarray
    slots: np.ndarray
    last_words: np.ndarray

    @property
    def blocks(self) -> np.ndarray:
        return -(-self.words // BLOCK_WORDS)

    @property
    def shards(self) -> int:
        return int(-(-self.slots.sum() // SHARD_SLOTS))


def targets(words: np.ndarray) -> np.ndarray:
    """Words to take from each source: shares by weight, none above its limit."""
    weight = np.array([WEIGHTS[i % len(WEIGHTS)] for i in range(len(words))], float)
    limit = PASSES * words.astype(float)
    found, open_, left = np.zeros(len(words)), np.ones(len(words), bool), PERCENT * float(words.sum()) / 100
    while open_.any():
        found[open_] = left * weight[open_] / weight[open_].sum()
        above = open_ & (found > limit)
        if not above.any():
            break
        found[above] = limit[above]
        open_ &= ~above
        left = max(0.0, PERCENT * float(words.sum()) / 100 - found[~open_].sum())
    return found


def slots_for(source: int, words: int, take: int) -> tuple[int, int]:
    """How many slots take ``take`` of a source's words, and how many words of the last of them."""
    if not take:
        return 0, 0
    blocks = -(-words // BLOCK_WORDS)
    passes, rest = divmod(take, words)
    if not rest:
        return passes * blocks, BLOCK_WORDS
    tail = words - (blocks - 1) * BLOCK_WORDS
    # Where in the last pass the short block stands decides how many slots reach the rest.
    short = int(inverse(np.array([blocks - 1]), blocks, source, passes)[0])
    if rest <= short * BLOCK_WORDS:
        n = -(-rest // BLOCK_WORDS)
        return passes * blocks + n, rest - (n - 1) * BLOCK_WORDS
    rest -= short * BLOCK_WORDS
    if rest <= tail:
        return passes * blocks + short + 1, rest
    rest -= tail
    n = -(-rest // BLOCK_WORDS)
    return passes * blocks + short + 1 + n, rest - (n - 1) * BLOCK_WORDS


def plan(documents: DataFrame) -> Plan:
    """From ``source, size, copies`` of :func:`measured`."""
    found = documents.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    rows = found.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"a mix takes at most {MOST_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    words = np.array([r["words"] for r in rows], np.int64)
    wanted = targets(words)
    slots = [slots_for(i, int(n), int(np.floor(t + 0.5))) for i, (n, t) in enumerate(zip(words, wanted, strict=True))]
    counts, last = (np.array([x[k] for x in slots], np.int64) for k in (0, 1))
    return Plan([r["source"] for r in rows], words, wanted, counts, last)


# ── permutations ─────────────────────────────────────────────────────────────────────


def _keys(source: int, turn: int) -> np.ndarray:
    return mix(np.arange(1, 5, dtype=np.uint64) + np.uint64(SEED) * np.uint64(8) + np.uint64(turn * 8) + (np.uint64(source) << np.uint64(32)))


def _rounds(x: np.ndarray, n: int, keys: np.ndarray, back: bool) -> np.ndarray:
    """A Feistel network over the least even number of bits that holds ``n`` values."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    high, low = x >> half, x & mask
    for key in keys[::-1] if back else keys:
        if back:
            high, low = (low ^ mix(high + key)) & mask, high
        else:
            high, low = low, (high ^ mix(low + key)) & mask
    return (high << half) | low


def _walk(index: np.ndarray, n: int, source: int, turn: int, back: bool) -> np.ndarray:
    """Steps through the network until the value is below ``n`` again, which keeps the map one to one."""
    keys, out = _keys(source, turn), index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = _rounds(out[todo], n, keys, back)
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def permuted(index: np.ndarray, n: int, source: int, turn: int) -> np.ndarray:
    """Block of each place in a pass over ``n`` blocks."""
    return _walk(index, n, source, turn, False)


def inverse(index: np.ndarray, n: int, source: int, turn: int) -> np.ndarray:
    """Place of each block."""
    return _walk(index, n, source, turn, True)


# ── documents and blocks ─────────────────────────────────────────────────────────────


def _content(doc_id: Column, source: Column, text: Column) -> Column:
    """Rows of one id are taken as equal where this hash is; null text is empty text."""
    return F.xxhash64(doc_id, _named(source), F.coalesce(text, F.lit("")))


def _named(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, source, content, size, copies``: equal documents as one row, with their words and their number."""
    narrow = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        _content(F.col("doc_id"), F.col("source"), F.col("text")).alias("content"),
        F.col("text").cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for _, _, data, bounds in pieces(batch.column(3)):
                solid = solid_bytes(data)
                begin = solid.copy()
                begin[1:] &= ~solid[:-1]
                edge = bounds[:-1][bounds[:-1] < len(data)]
                begin[edge] = solid[edge]
                total = np.concatenate([[0], np.cumsum(begin, dtype=np.int64)])
                sizes.append(total[bounds[1:]] - total[bounds[:-1]])
            sizes = pa.array(np.concatenate(sizes) if sizes else [], pa.int64())
            yield pa.record_batch([*batch.columns[:3], sizes], ["doc_id", "source", "content", "size"])

    schema = T.StructType([*narrow.schema.fields[:3], T.StructField("size", T.LongType())])
    sized = narrow.mapInArrow(run, schema)
    return stage(sized.groupBy("doc_id", "source", "content", "size").agg(F.count("*").alias("copies")), "mix-documents")


def running_sum(rows: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column, into: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows of their keys that come before, in two steps: buckets, and rows
    within a bucket.  Keys must not be null."""
    inner = Window.partitionBy(*keys, bucket).orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(bucket)
    rows = rows.withColumn(into, value)
    sums = rows.groupBy(*keys, bucket).agg(F.sum(into).alias("whole"))
    sums = sums.select(*keys, bucket, (F.sum("whole").over(outer) - F.col("whole")).alias("ahead"))
    rows = rows.withColumn(into, F.sum(into).over(inner) - F.col(into))
    return rows.join(sums, [*keys, bucket]).withColumn(into, F.col(into) + F.col("ahead")).drop("ahead")


def with_source_number(documents: DataFrame, found: Plan) -> DataFrame:
    """Adds ``number`` (the source's), ``source_size`` and ``target``."""
    spark = documents.sparkSession
    schema = "number int, key string, source_size long, target double"
    rows = [(i, _key(n), int(w), float(t)) for i, (n, w, t) in enumerate(zip(found.names, found.words, found.targets, strict=True))]
    return documents.withColumn("key", _named(F.col("source"))).join(spark.createDataFrame(rows, schema), "key").drop("key")


def _key(name: str | None) -> str:
    return "" if name is None else f"s{name}"


def each_copy(documents: DataFrame) -> DataFrame:
    return documents.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))


def document_pieces(documents: DataFrame) -> DataFrame:
    """``doc_id, number, content, copy, size, block, at, first, words``: parts of documents by the block of their source.

    ``at`` is the place in the block, ``first`` that in the document, of the first word.  Documents without words have
    no piece.
    """
    buckets = max(1, -(-documents.count() // BUCKET_DOCS))
    full = documents.where("size > 0").withColumn("bucket", F.pmod(F.xxhash64("content"), F.lit(buckets)))
    full = running_sum(full, ["number"], "bucket", ["content", "doc_id"], F.col("size") * F.col("copies"), "begin")
    copies = each_copy(full)
    copies = copies.withColumn("begin", F.col("begin") + (F.col("copy") - 1) * F.col("size"))
    block = lambda word: F.expr(f"({word}) div {BLOCK_WORDS}")
    parts = copies.withColumn("block", F.explode(F.sequence(block("begin"), block("begin + size - 1"))))
    first = F.greatest(F.lit(0).cast("long"), F.col("block") * BLOCK_WORDS - F.col("begin"))
    parts = parts.withColumn("first", first).withColumn("at", F.col("begin") + F.col("first") - F.col("block") * BLOCK_WORDS)
    parts = parts.withColumn("words", F.least(F.lit(BLOCK_WORDS) - F.col("at"), F.col("size") - F.col("first")))
    return parts.select("doc_id", "number", "content", "copy", "size", "block", "at", "first", "words")


# ── slots ────────────────────────────────────────────────────────────────────────────


def draws(spark: SparkSession, found: Plan) -> DataFrame:
    """``shard, number, n, begin``: the slots of each source in each shard; ``begin`` counts those of earlier shards."""
    chance = np.cumsum(found.slots / max(found.slots.sum(), 1))
    total = int(found.slots.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                rng = np.random.default_rng([SEED, shard])
                slots = min(SHARD_SLOTS, total - shard * SHARD_SLOTS)
                drawn = np.minimum(np.searchsorted(chance, rng.random(slots), side="right"), len(chance) - 1)
                number, n = np.unique(drawn, return_counts=True)
                columns = [pa.array(np.full(len(n), shard), pa.int64()), pa.array(number, pa.int32()), pa.array(n, pa.int64())]
                yield pa.record_batch(columns, ["shard", "number", "n"])

    drawn = spark.range(found.shards).mapInArrow(run, "shard long, number int, n long")
    drawn = stage(drawn, "mix-draws").withColumn("bucket", F.expr(f"shard div {BUCKET_DOCS}"))
    drawn = running_sum(drawn, ["number"], "bucket", ["shard"], F.col("n"), "begin")
    schema = "number int, slots long"
    limits = spark.createDataFrame([(i, int(n)) for i, n in enumerate(found.slots)], schema)
    within = drawn.join(limits, "number").withColumn("n", F.least("n", F.col("slots") - F.col("begin"))).where("n > 0")
    # What a source drew too few of goes to closing shards.
    reached = drawn.groupBy("number").agg(F.sum("n").alias("reached"))
    short = limits.join(reached, "number", "left").withColumn("begin", F.coalesce("reached", F.lit(0).cast("long")))
    short = short.where("begin < slots").withColumn(
        "begin", F.explode(F.sequence(F.col("begin"), F.col("slots") - 1, F.lit(SHARD_SLOTS).cast("long")))
    )
    order = Window.partitionBy("number").orderBy("begin")
    short = short.withColumn("shard", F.lit(found.shards) + F.row_number().over(order) - 1)
    short = short.withColumn("n", F.least(F.lit(SHARD_SLOTS), F.col("slots") - F.col("begin")))
    names = ["shard", "number", "n", "begin"]
    return within.select(*names).unionByName(short.select(*names))


def slots(spark: SparkSession, found: Plan) -> DataFrame:
    """``shard, slot, number, block, most``: the block of every slot of the mix, and the words it may give.

    ``slot`` orders the slots of a shard, sources mixed.
    """
    blocks, counts, last = found.blocks, found.slots, found.last_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, n, begin in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                turn, place = np.divmod(np.arange(begin, begin + n, dtype=np.int64), blocks[number])
                block = np.empty(n, np.int64)
                for t in np.unique(turn):
                    block[turn == t] = permuted(place[turn == t], int(blocks[number]), number, int(t))
                most = np.full(n, BLOCK_WORDS)
                if begin + n == counts[number]:
                    most[-1] = last[number]
                slot = mix(np.arange(begin, begin + n, dtype=np.uint64) + (np.uint64(number) << np.uint64(40))).view(np.int64)
                columns = [np.full(n, shard), slot, np.full(n, number, np.int32), block, most]
                yield pa.record_batch([pa.array(c) for c in columns], ["shard", "slot", "number", "block", "most"])

    return draws(spark, found).mapInArrow(run, "shard long, slot long, number int, block long, most long")


def mixed(parts: DataFrame, taken: DataFrame) -> DataFrame:
    """The mix: every piece once for each slot that takes its block, with the words that it gives.

    Pieces that no slot takes stay, with null ``shard`` and no ``given`` words.
    """
    joined = parts.join(taken, ["number", "block"], "left")
    given = F.greatest(F.lit(0).cast("long"), F.least("words", F.col("most") - F.col("at")))
    return joined.withColumn("given", F.when(F.col("shard").isNotNull(), given).otherwise(0).cast("long"))


def mixed_texts(docs: DataFrame, mix_pieces: DataFrame) -> DataFrame:
    """``shard, slot, at, doc_id, words, text``: the mix's texts, word for word as in the documents, in the order of its
    first three columns.  White space within a piece stays; that between pieces is the reader's."""
    content = _content(F.col("doc_id"), F.col("source"), F.col("text"))
    texts = docs.select(F.col("doc_id").alias("of"), content.alias("content"), "text").dropDuplicates(["of", "content"])
    wanted = mix_pieces.where("given > 0").select("content", "shard", "slot", "at", "doc_id", "first", "given")
    wanted = wanted.withColumnRenamed("content", "wanted")
    same = (F.col("wanted") == F.col("content")) & F.col("doc_id").eqNullSafe(F.col("of"))
    joined = wanted.join(texts, same).select("shard", "slot", "at", "doc_id", "given", "first", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = binary_column(batch.column(6))
            raw, cut = data.tobytes(), []
            begin, given = batch.column(5).to_numpy(), batch.column(4).to_numpy()
            for i in range(batch.num_rows):
                own = np.array([0, bounds[i + 1] - bounds[i]])
                start, end, _ = split_words(data[bounds[i] : bounds[i + 1]], own)
                low, high = bounds[i] + start[begin[i]], bounds[i] + end[begin[i] + given[i] - 1]
                cut.append(raw[low:high].decode())
            yield pa.record_batch([*batch.columns[:5], pa.array(cut, pa.string())], [*names[:5], "text"])

    names = ["shard", "slot", "at", "doc_id", "words"]
    fields = [T.StructField(n, f.dataType) for n, f in zip(names, joined.schema.fields, strict=False)]
    return joined.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType())]))


def mix_sources(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents with their sources' targets (``doc_id, content, size, source_size, target, ...``), and the mix."""
    documents = measured(docs)
    found = plan(documents)
    numbered = with_source_number(documents, found)
    return numbered, mixed(document_pieces(numbered), slots(docs.sparkSession, found))


def taken_words(numbered: DataFrame, mix_pieces: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    taken = mix_pieces.groupBy("number", "doc_id", "content", "copy", "size").agg(F.sum("given").alias("taken"))
    sources = numbered.select("number", "source_size", "target").distinct()
    names = ["doc_id", "size", "source_size", "target", "taken"]
    none = each_copy(numbered.where("size = 0")).withColumn("taken", F.lit(0).cast("long"))
    return taken.join(sources, "number").select(*names).unionByName(none.select(*names))
