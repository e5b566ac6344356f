"""Removal of byte strings that an earlier document has, by suffix arrays over shards.

Every window of ``LENGTH`` bytes has an anchor: the least hash among its grams of ``GRAM`` bytes, which depends on the
window alone.  Equal windows of any documents thus meet where their anchor is sent.

1. Documents are packed into blocks (whole rows, compressed), written once with the block's distinct anchors by bucket.
2. Buckets of anchors find those that two documents have; a block gets two bits back for each anchor that it sent.
3. Blocks cut the runs of windows with such an anchor, once per block and content, and send them to the anchor's shard.
   Anchors of very many runs are cut into single windows, sent by their content, so that no shard gets them all.
4. A shard sorts the suffixes of its distinct runs by induced sorting, some parts of its anchors at a time; permuted
   common prefixes tell equal windows; each window belongs to the least document id of its class and is covered in all others.
5. Blocks collect the covered windows of their documents and cut the bytes under them.

Null text is empty.  A row with a null id is left as it is and covers nothing; rows that share an id are one document and
never cover each other; equal texts of different ids go but for the least id; documents shorter than ``LENGTH`` bytes
neither cover nor lose anything; an empty table gives an empty result; other columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import join_words, loosen, part_words, squeeze
from .common import binaries, binary_column, parts_for, pieces, stage, task_block_id, text_bytes
from .suffix_sort import eight_bytes, permuted_match, suffix_array
from .words import mix

LENGTH, GRAM = 50, 24
REACH = LENGTH - GRAM + 1
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 96 << 20
#: Anchors of a bucket that are compared at a time.
BUCKET_ANCHORS = 1 << 19
SHARD_BYTES = 8 << 20
#: Parts of a shard by anchor, or by content where the anchor is frequent; equal windows are in the same one.
PARTS = 64
#: Bytes of a shard's distinct runs whose suffixes are sorted at a time, in whole parts; sorting takes some 50 times as much.
SORT_BYTES = 1 << 20
#: Bytes of text whose anchors are computed at a time.
ANCHOR_BYTES = 1 << 19
#: Runs with one anchor beyond which they are dealt by window.
HOT_RUNS = 4096
ONE, SHARED, HOT = 0, 1, 2


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and anchor of each run of windows with the same anchor; runs do not cross texts."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none.astype(np.uint64)
    eight = eight_bytes(data)
    n = len(data) - GRAM + 1
    gram = mix(eight[:n] + np.uint64(0x632BE59BD9B4E019))
    for k in range(8, GRAM, 8):
        gram = mix(gram ^ mix(eight[k : n + k]))
    least = (gram & np.uint64(0xFFFFFFFFFFFF0000)) | (np.arange(n, dtype=np.uint64) & np.uint64(0xFFFF))
    size = 1
    while size * 2 <= REACH:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if size < REACH:
        least = np.minimum(least[: len(least) - (REACH - size)], least[REACH - size :])
    inside = np.zeros(len(least) + 1, bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        inside[a : max(a, b - LENGTH + 1)] = True
    inside = inside[:-1]
    change = np.ones(len(least) + 1, bool)
    change[1:-1] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    change[bounds[(bounds > 0) & (bounds < len(least))]] = True
    cut = np.flatnonzero(change)
    own = inside[cut[:-1]]
    start = cut[:-1][own]
    return start, (cut[1:] - cut[:-1])[own], least[start] >> np.uint64(16)


class Runs:
    """The runs of a piece of a block: row in the block, place in the piece's bytes and in the text, windows, anchor."""

    def __init__(self, low: int, data: np.ndarray, bounds: np.ndarray, has_id: np.ndarray):
        place, count, anchor = anchors(data, bounds)
        row = np.searchsorted(bounds, place, side="right") - 1
        own = has_id[low + row]
        self.data = data
        self.row, self.place, self.count, self.anchor = row[own] + low, place[own], count[own], anchor[own]
        self.start = self.place - bounds[row[own]]


def block_runs(text: pa.Array, has_id: np.ndarray) -> list[Runs]:
    """Runs of the rows that have an id."""
    return [Runs(low, data, bounds, has_id) for low, _, data, bounds in pieces(text, ANCHOR_BYTES)]


def write_batch(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return squeeze(sink.getvalue().to_pybytes(), 4)


def read_batch(raw: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(loosen(raw)).read_all().combine_chunks()
    return table.to_batches()[0]


def pack_numbers(*arrays: np.ndarray) -> bytes:
    """Whole numbers of 64 bits, compressed byte by byte, as most of their bytes are alike."""
    planes = [x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in arrays]
    return squeeze(b"".join(len(x).to_bytes(8, "little") + p for x, p in zip(arrays, planes, strict=True)), 3)


def unpack_numbers(raw: bytes) -> list[np.ndarray]:
    raw, out, at = loosen(raw), [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, np.uint8, 8 * n, at + 8).reshape(8, n).T.copy().view("<u8").reshape(n))
        at += 8 + 8 * n
    return out


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return (anchor % np.uint64(buckets)).astype(np.int64)


def block_anchors(runs: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors of a block by (bucket, anchor), their numbers of runs, and whether several documents have them."""
    anchor = np.concatenate([a for a, _ in runs]) if runs else np.zeros(0, np.uint64)
    doc = np.concatenate([d for _, d in runs]) if runs else np.zeros(0, np.int64)
    order = np.argsort(anchor, kind="stable")
    anchor, doc = anchor[order], doc[order]
    first = np.ones(len(anchor), bool)
    first[1:] = anchor[1:] != anchor[:-1]
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(anchor)))
    several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at) if len(at) else np.zeros(0, bool)
    order = np.lexsort((anchor[at], bucket_of(anchor[at], buckets)))
    return anchor[at][order], count[order], several[order]


def blocks_of(rows: DataFrame, buckets: int) -> DataFrame:
    """``block, rows, anchors``: compressed rows, and anchors by bucket."""
    names = ["block", "rows", "anchors"]
    anchors_type = pa.list_(pa.struct([("bucket", pa.int32()), ("packed", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for low, high, _, _ in pieces(batch.column(0), BLOCK_BYTES):
                part = batch.slice(low, high - low)
                ids = part.column(1)
                doc = ids.fill_null(0).to_numpy(zero_copy_only=False)
                has = np.asarray(ids.is_valid())
                found = [(x.anchor, doc[x.row]) for x in block_runs(part.column(0), has)]
                anchor, count, several = block_anchors(found, buckets)
                cut = np.searchsorted(bucket_of(anchor, buckets), np.arange(buckets + 1))
                packed = [
                    {"bucket": b, "packed": pack_numbers(np.diff(anchor[x:y], prepend=np.uint64(0)), count[x:y], several[x:y])}
                    for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True))
                    if x < y
                ]
                values = [pa.array([task_block_id(number)]), binaries([write_batch(part)]), pa.array([packed], anchors_type)]
                yield pa.record_batch(values, names)
                number += 1

    return rows.mapInArrow(run, "block long, rows binary, anchors array<struct<bucket:int,packed:binary>>")


def sent_anchors(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's anchors of a bucket in order, their numbers of runs, and whether several documents have them."""
    step, count, several = unpack_numbers(packed)
    return np.cumsum(step, dtype=np.uint64), count.astype(np.uint32), several > 0


def shared_anchors(sent: DataFrame, buckets: int) -> DataFrame:
    """``block, bucket, codes, runs``: for each anchor that a block sent, whether documents share it; ``runs`` counts the
    runs of those, a frequent anchor's by windows.  A task holds one bucket at a time."""
    names = ["block", "bucket", "codes", "runs"]

    def solve(rows: list[tuple[int, bytes]], bucket: int) -> pa.RecordBatch:
        parts = [sent_anchors(x) for _, x in rows]
        codes, wanted = [np.zeros(len(p[0]), np.uint8) for p in parts], [0] * len(rows)
        largest = max((p[0] for p in parts), key=len)
        steps = sum(map(len, codes)) // BUCKET_ANCHORS + 1
        edge = largest[np.arange(1, steps) * len(largest) // steps]
        cuts = [[0, *np.searchsorted(p[0], edge).tolist(), len(p[0])] for p in parts]
        for k in range(steps):  # a range of anchors at a time
            own = [slice(c[k], c[k + 1]) for c in cuts]
            anchor, count, several = (np.concatenate([p[i][x] for p, x in zip(parts, own, strict=True)]) for i in range(3))
            _, back = np.unique(anchor, return_inverse=True)
            runs = np.bincount(back, count)
            shared = (np.bincount(back) > 1) | (np.bincount(back, several) > 0)
            code = np.where(shared, np.where(runs > HOT_RUNS, HOT, SHARED), ONE).astype(np.uint8)[back]
            count = count * np.array([0, 1, REACH // 2])[code]
            end = np.cumsum([0, *(x.stop - x.start for x in own)])
            for i, (x, low, high) in enumerate(zip(own, end[:-1], end[1:], strict=True)):
                codes[i][x] = code[low:high]
                wanted[i] += int(count[low:high].sum())
        values = [[b for b, _ in rows], [bucket] * len(rows), [squeeze(x.tobytes()) for x in codes]]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64()]
        return pa.record_batch([pa.array(v, k) for v, k in zip([*values, wanted], kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        bucket = -1
        for batch in batches:
            for b, own, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if own != bucket and held:
                    yield solve(held, bucket)
                    held = []
                bucket = own
                held.append((b, raw))
        if held:
            yield solve(held, bucket)

    dealt = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.select("block", "bucket", "packed").mapInArrow(run, "block long, bucket int, codes binary, runs long")


def cut_runs(blocks: DataFrame, buckets: int, shards: int) -> DataFrame:
    """``shard, block, contents, places``: distinct contents of a block for a shard, and for each occurrence its content,
    row, start, number of windows, document id and part of the shard."""
    names = ["shard", "block", "contents", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in ("block", "rows", "codes")}
                part = read_batch(row["rows"])
                ids = part.column(1)
                doc = ids.fill_null(0).to_numpy(zero_copy_only=False)
                found = block_runs(part.column(0), np.asarray(ids.is_valid()))
                line, start, n, anchor = (np.concatenate([getattr(x, k) for x in found]) for k in ("row", "start", "count", "anchor"))
                data = b"".join(x.data.tobytes() for x in found)
                begin = np.cumsum([0, *(len(x.data) for x in found)])
                place = np.concatenate([x.place + low for x, low in zip(found, begin[:-1].tolist(), strict=True)])
                known, back = np.unique(anchor, return_inverse=True)
                code = np.zeros(len(known), np.uint8)  # codes come in the order the block sent its anchors in
                sent = np.frombuffer(b"".join(loosen(x["codes"]) for x in row["codes"] or []), np.uint8)
                code[np.argsort(bucket_of(known, buckets), kind="stable")] = sent
                kind = code[back]
                use, hot = np.flatnonzero(kind == SHARED), np.flatnonzero(kind == HOT)
                # Runs of frequent anchors become single windows.
                each = n[hot]
                step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                hot = np.repeat(hot, each)
                windows = (xxhash.xxh64_intdigest(data[a : a + LENGTH]) for a in (place[hot] + step).tolist())
                deal, shard = np.divmod(np.concatenate([mix(anchor[use]), np.fromiter(windows, np.uint64, len(hot))]), np.uint64(shards))
                shard, group = shard.astype(np.int64), (deal % np.uint64(PARTS)).astype(np.int64)
                place, start = (np.concatenate([x[use], x[hot] + step]) for x in (place, start))
                line, n = np.concatenate([line[use], line[hot]]), np.concatenate([n[use], np.ones(len(hot), np.int64)])
                order = np.argsort(shard, kind="stable")
                cut = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
                for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    own = order[x:y]
                    ends = (place[own] + n[own] + LENGTH - 1).tolist()
                    contents: dict[bytes, int] = {}
                    number = [contents.setdefault(data[a:b], len(contents)) for a, b in zip(place[own].tolist(), ends, strict=True)]
                    columns = (np.array(number, np.int64), line[own], start[own], n[own], doc[line[own]], group[own])
                    numbers = pack_numbers(*(c.astype(np.int64).astype(np.uint64) for c in columns))
                    values = [pa.array([shard[own[0]]], pa.int32()), pa.array([row["block"]], pa.int64()), binaries([join_words(list(contents))]), binaries([numbers])]
                    yield pa.record_batch(values, names)

    return blocks.select("block", "rows", "codes").mapInArrow(run, "shard int, block long, contents binary, places binary")


def covered_windows(contents: list[bytes], owner: np.ndarray) -> list[np.ndarray]:
    """For each distinct content (document of least id: ``owner``), which of its windows an earlier document has."""
    size = np.array([len(x) for x in contents], np.int64)
    text = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    windows = size - LENGTH + 1
    at = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    valid = np.zeros(len(text), bool)
    valid[at] = True
    order = suffix_array(text, LENGTH)
    order = order[valid[order]]
    first = ~permuted_match(text, order, LENGTH)[order]
    doc = np.zeros(len(text), np.int64)
    doc[at] = np.repeat(owner, windows)
    own = doc[order]
    least = np.minimum.reduceat(own, np.flatnonzero(first)) if len(order) else own
    covered = np.zeros(len(text), bool)
    covered[order] = least[np.cumsum(first) - 1] < own
    return np.split(covered[at], np.cumsum(windows)[:-1])


def covered_in_pieces(contents: list[bytes], owner: np.ndarray, part: np.ndarray) -> list[np.ndarray]:
    """``covered_windows`` of a shard, whose parts have no window in common: some parts at a time."""
    size = np.bincount(part, [len(x) for x in contents], PARTS)
    piece = ((np.cumsum(size) - size) // SORT_BYTES)[part]
    order = np.argsort(piece, kind="stable")
    covered: list[np.ndarray] = [np.zeros(0, bool)] * len(contents)
    for own in np.split(order, np.flatnonzero(np.diff(piece[order])) + 1):
        for k, found in zip(own.tolist(), covered_windows([contents[k] for k in own.tolist()], owner[own]), strict=True):
            covered[k] = found
    return covered


def solve_shard(rows: list[tuple[int, bytes, bytes]]) -> list[tuple[int, bytes]]:
    """Covered windows ``row, start, windows`` of each block that sent runs to a shard."""
    number: dict[bytes, int] = {}
    parts = []
    for block, packed, places in rows:
        own = np.array([number.setdefault(x, len(number)) for x in part_words(packed)], np.int64)
        content, line, start, n, doc, group = (x.astype(np.int64) for x in unpack_numbers(places))
        parts.append((block, own[content], line, start, n, doc, group))
    content, doc, group = (np.concatenate([p[i] for p in parts]) for i in (1, 5, 6))
    owner = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(owner, content, doc)
    part = np.zeros(len(number), np.int64)
    part[content] = group
    covered = covered_in_pieces(list(number), owner, part)
    partial = np.array([x.any() for x in covered])
    out = []
    for block, own, line, start, n, doc, _ in parts:
        whole = doc > owner[own]
        found = [(line[whole], start[whole], n[whole])]
        for k in np.flatnonzero(~whole & partial[own]).tolist():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], covered[own[k]].astype(np.int8), [0]])))
            begin, end = edge[::2], edge[1::2]
            found.append((np.full(len(begin), line[k]), start[k] + begin, end - begin))
        columns = [np.concatenate([f[i] for f in found]) for i in range(3)]
        if len(columns[0]):
            out.append((block, pack_numbers(*columns)))
    return out


def match_runs(runs: DataFrame, shards: int) -> DataFrame:
    """``block, spans`` from ``shard, block, contents, places``; a task holds one shard at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes]] = []
        shard = -1

        def rows() -> pa.RecordBatch:
            found = solve_shard(held)
            return pa.record_batch([pa.array([b for b, _ in found], pa.int64()), binaries([x for _, x in found])], ["block", "spans"])

        for batch in batches:
            for own, *rest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if own != shard and held:
                    yield rows()
                    held = []
                shard = own
                held.append(tuple(rest))
        if held:
            yield rows()

    dealt = runs.repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.select("shard", "block", "contents", "places").mapInArrow(run, "block long, spans binary")


def keep_mask(size: int, start: np.ndarray, windows: np.ndarray, text: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Bytes of a text that stay, and the number of removed spans.  With the text's bytes, a character that is only partly
    covered stays whole."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + windows + LENGTH - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    if text is not None and gone.any():
        lead = np.flatnonzero((text & 0xC0) != 0x80)
        gone = np.repeat(np.minimum.reduceat(gone, lead), np.diff(np.append(lead, size)))
    spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
    return ~gone, spans


def covered_blocks(rows: DataFrame) -> DataFrame:
    """``rows, spans``: blocks of rows with the covered windows of all shards.  ``rows`` has text and id in front."""
    spark, total = rows.sparkSession, text_bytes(rows, rows.columns[0])
    buckets = parts_for(spark, total, BUCKET_BYTES)
    blocks = stage(blocks_of(rows, buckets), "suffix-blocks", "none")
    sent = blocks.select("block", F.explode("anchors").alias("a")).select("block", "a.bucket", "a.packed")
    codes = stage(shared_anchors(sent, buckets), "suffix-anchors")
    wanted = codes.agg(F.sum("runs")).first()[0] or 0
    shards = parts_for(spark, wanted * (LENGTH + REACH // 2), SHARD_BYTES)
    by_block = codes.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "codes"))).alias("codes"))
    data = blocks.select("block", "rows")
    runs = cut_runs(data.join(by_block, "block"), buckets, shards)
    spans = match_runs(runs, shards).groupBy("block").agg(F.collect_list("spans").alias("spans"))  # one block's windows
    return data.join(spans, "block", "left").select("rows", "spans")


def block_spans(spans: list[bytes] | None, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and number of covered windows for each of a block's ``n`` rows."""
    parts = [unpack_numbers(x) for x in spans or []]
    line, start, windows = (np.concatenate([p[i] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for i in range(3))
    order = np.argsort(line, kind="stable")
    cut = np.searchsorted(line[order], np.arange(n + 1))
    return [(start[order[a:b]], windows[order[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def removal_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document, to the byte."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = read_batch(batch.column(0)[i].as_py())
                data, bounds = binary_column(part.column(0))
                out = []
                for k, (start, windows) in enumerate(block_spans(batch.column(1)[i].as_py(), part.num_rows)):
                    own = data[bounds[k] : bounds[k + 1]]
                    keep, spans = keep_mask(len(own), start, windows)
                    out.append((len(own), int((~keep).sum()), spans, hashlib.sha256(own[keep].tobytes()).hexdigest()))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)]
                yield pa.record_batch([part.column(1), *columns], names)

    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"))
    return covered_blocks(rows).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated strings cut from ``text``; characters that are only partly covered stay whole.  Where
    there is a column ``n_chars``, it follows the text; all other columns are unchanged."""
    rest = [c for c in docs.columns if c not in ("text", "doc_id")]
    rows = docs.select("text", "doc_id", *(F.col(f"`{c}`") for c in rest))
    n_chars = rows.columns.index("n_chars") if "n_chars" in rest and isinstance(docs.schema["n_chars"].dataType, (T.LongType, T.IntegerType)) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = read_batch(batch.column(0)[i].as_py())
                data, bounds = binary_column(part.column(0))
                text, columns = part.column(0).to_pylist(), list(part.columns)
                for k, (start, windows) in enumerate(block_spans(batch.column(1)[i].as_py(), part.num_rows)):
                    if len(start):
                        own = data[bounds[k] : bounds[k + 1]]
                        text[k] = own[keep_mask(len(own), start, windows, own)[0]].tobytes().decode()
                columns[0] = pa.array(text, part.column(0).type)
                if n_chars is not None:
                    old = columns[n_chars].to_pylist()
                    new = [v if x is None else len(x) for v, x in zip(old, text, strict=True)]
                    columns[n_chars] = pa.array(new, columns[n_chars].type)
                yield pa.record_batch(columns, part.schema.names)

    return covered_blocks(rows).mapInArrow(run, rows.schema).select(*(F.col(f"`{c}`") for c in docs.columns))
