"""How filters interact: what every step of every order of the filters removes.

A document's failures form a mask of five bits.  Each mask has a code, an integer whose 600 fields of 64 bits say for
every order of the filters and every step whether a document with this mask is removed there.  Tasks add the codes of
their documents into one integer per part, integers are added per part, and the fields of the sum are the counts.  The
other figures follow from those fields: what fails a filter is what it removes as the first, what fails it alone is what
it removes as the last.

Filter E compares texts over the whole table, by their SHA-256.  Rows with one text are counted per part and labels
before they meet, so a text with very many copies sends a few rows per task.

Null text counts as empty.  A null ``doc_id`` is neither smaller nor larger than another: such a row never fails E, nor
makes others fail it, and has no label.  Rows with one ``doc_id`` and text are no copies of each other.  Null and empty
sources are one part, the empty string.  Several labels of one id count as 1 where any is 1.  An empty table has no
parts.  Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, stage
from .words import split_words, word_hashes

FILTERS = "ABCDE"
ORDERS = ["".join(x) for x in permutations(FILTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(1, len(FILTERS) + 1)]
_DUPLICATE = 1 << FILTERS.index("E")
_MARKS = b"#$%&*|"
#: Bytes of a field; a field holds counts below 2^64.
_FIELD = 8
_WIDE = len(STEPS) * _FIELD
#: Parts that a task adds up at a time.
PARTS_HELD = 512
#: Tasks whose sums of one part are added in one go.
FAN_IN = 64


def text_mask(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Failures of filters A to D of each text of a piece, as bits."""
    rows = len(bounds) - 1
    starts, ends, row = split_words(data, bounds)
    words = np.bincount(row, minlength=rows)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[bounds[1:]] - total[bounds[:-1]]

    hashes = word_hashes(data, starts, ends)
    order = np.lexsort((hashes, row))
    hashes, of = hashes[order], row[order]
    first = np.ones(len(order), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    distinct = np.bincount(of[first], minlength=rows)
    marks = np.zeros(256, bool)
    marks[list(_MARKS)] = True
    fails = [
        words < 50,
        100 * distinct < 65 * words,
        100 * per_row((data >= 65) & (data <= 90)) > 5 * per_row((data & 0xC0) != 0x80),
        per_row(marks[data]) > 0,
    ]
    return sum(x.astype(np.int64) << i for i, x in enumerate(fails))


def with_text_mask(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest, mask`` of every row, without filter E."""
    narrow = docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
        "text",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = [text_mask(data, bounds) for _, _, data, bounds in pieces(batch.column(3))]
            masks = pa.array(np.concatenate(masks) if masks else [], pa.int64())
            yield pa.record_batch([*batch.columns[:3], masks], ["doc_id", "part", "digest", "mask"])

    return narrow.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, digest binary, mask long")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic, n``: documents by failures of all five filters, not yet added up over texts."""
    rows = with_text_mask(docs).groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    rows = stage(rows, "audit-masks")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    known = rows.where("doc_id is not null").join(marks, "doc_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    known = known.select("doc_id", "digest", "part", "mask", "n", flag("good"), flag("toxic"))
    nameless = rows.where("doc_id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n")
    # Of the rows with one text, part and labels only the least id may be the first of its text.
    alike = known.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("least")
    )
    first = F.col("least.doc_id") == F.min("least.doc_id").over(Window.partitionBy("digest"))
    alike = alike.withColumn("firsts", F.when(first, F.col("least.n")).otherwise(0))
    cases = F.array(
        F.struct(F.col("mask"), F.col("firsts").alias("n")),
        F.struct(F.col("mask").bitwiseOR(_DUPLICATE).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")),
    )
    alike = alike.select("part", "good", "toxic", F.explode(cases).alias("c")).select("part", "c.mask", "good", "toxic", "c.n")
    return alike.where("n > 0").unionByName(nameless)


def mask_codes() -> list[int]:
    """For each mask the integer with a 1 in the field of every step that removes it."""
    codes = []
    for mask in range(1 << len(FILTERS)):
        code = 0
        for place, (order, step) in enumerate(STEPS):
            bits = [1 << FILTERS.index(x) for x in order[:step]]
            if mask & bits[-1] and not mask & sum(bits[:-1]):
                code |= 1 << (8 * _FIELD * place)
        codes.append(code)
    return codes


def _wide(value: int) -> bytes:
    return value.to_bytes(_WIDE, "little")


_SUMS = "part string, docs long, removed binary, good binary, toxic binary"
_NAMES = [x.split()[0] for x in _SUMS.split(", ")]


def _batch(sums: dict[str, list[int]]) -> pa.RecordBatch:
    columns = [pa.array(list(sums), pa.string()), pa.array([x[0] for x in sums.values()], pa.int64())]
    columns += [pa.array([_wide(x[k]) for x in sums.values()], pa.binary()) for k in (1, 2, 3)]
    return pa.record_batch(columns, _NAMES)


def packed(counts: DataFrame) -> DataFrame:
    """Wide sums of ``part, mask, good, toxic, n``, one or more rows per task and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sums = mask_codes(), {}
        for batch in batches:
            for part, mask, good, toxic, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if part not in sums and len(sums) == PARTS_HELD:
                    yield _batch(sums)
                    sums = {}
                held = sums.setdefault(part, [0, 0, 0, 0])
                held[0] += n
                held[1] += n * codes[mask]
                if good:
                    held[2] += n * codes[mask]
                if toxic:
                    held[3] += n * codes[mask]
        if sums:
            yield _batch(sums)

    return counts.select("part", "mask", "good", "toxic", "n").mapInArrow(run, _SUMS)


def added(sums: DataFrame) -> DataFrame:
    """One wide sum for each part: partial sums of some tasks first, then those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            columns = [batch.column(name) for name in _NAMES]
            for i in range(batch.num_rows):
                part, docs = columns[0][i].as_py(), columns[1][i].as_py()
                wide = [int.from_bytes(c[i].as_py(), "little") for c in columns[2:]]
                if held and held[0] != part:
                    yield _batch({held[0]: held[1]})
                    held = None
                held = (part, [a + b for a, b in zip(held[1] if held else [0] * 4, [docs, *wide], strict=True)])
        if held:
            yield _batch({held[0]: held[1]})

    some = sums.withColumn("some", F.floor(F.spark_partition_id() / FAN_IN))
    some = some.repartition("part", "some").sortWithinPartitions("part").mapInArrow(run, _SUMS)
    return some.repartition("part").sortWithinPartitions("part").mapInArrow(run, _SUMS)


_REPORT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def unpacked(sums: DataFrame) -> DataFrame:
    """The report from one wide sum per part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = np.array([FILTERS.index(order[step - 1]) for order, step in STEPS])
        place = np.array([step for _, step in STEPS])
        orders = pa.array([order for order, _ in STEPS])
        names = [x.split()[0] for x in _REPORT.split(", ")]
        for batch in batches:
            for part, docs, *wide in zip(*(batch.column(name).to_pylist() for name in _NAMES), strict=True):
                removed, good, toxic = (np.frombuffer(x, "<u8").astype(np.int64) for x in wide)
                fails, alone, shapley = (np.zeros(len(FILTERS), np.int64) for _ in range(3))
                fails[letter[place == 1]] = removed[place == 1]
                alone[letter[place == len(FILTERS)]] = removed[place == len(FILTERS)]
                np.add.at(shapley, letter, removed)
                gone = removed.reshape(len(ORDERS), -1).cumsum(1).ravel()
                earlier = fails[letter] - removed
                columns = [docs - gone, removed, earlier, alone[letter], good, toxic, shapley[letter]]
                yield pa.record_batch(
                    [pa.array([part] * len(STEPS)), orders, pa.array(place, pa.int32()), *(pa.array(c, pa.int64()) for c in columns)],
                    names,
                )

    return sums.mapInArrow(run, _REPORT)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order and step of the filters: what is kept, removed, redundant and lost.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``; ``redundant``
    documents fail the step's filter, but were removed earlier; ``shapley`` adds what the filter removes over all orders.
    """
    return unpacked(stage(added(packed(failures(docs, labels))), "audit-sums"))
