"""Byte-level BPE encoding and decoding through a global exchange of distinct words.

Documents are cut into pre-tokens block by block: a block keeps its documents' sequences of word positions, compressed,
and its own distinct words.  The words of all blocks are dealt by hash, every distinct word is encoded once where it
lands, and the ids return to the blocks, which put the documents together by position.  A word thus crosses the network
once per block, however often it occurs.  Decoding joins ids to the token-byte table of the rank file.

Null and empty texts have no ids and decode to nothing; null document ids and repeated rows are kept as they are; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, parts_for, stage, task_block_id, text_bytes
from .token_lengths import rank_encoding

#: Bytes of text in a block, and of text for each bucket of words.
BLOCK_BYTES = 16 << 20
BUCKET_BYTES = 32 << 20


def squeeze(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def loosen(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def join_words(words: list[bytes]) -> bytes:
    """Sizes and bytes of words in one compressed value."""
    sizes = planes(np.array([len(w) for w in words], "<u4"))
    return squeeze(len(words).to_bytes(4, "little") + sizes + b"".join(words), 6)


def part_words(packed: bytes) -> list[bytes]:
    raw = loosen(packed)
    n = int.from_bytes(raw[:4], "little")
    end = np.cumsum(from_planes(raw[4 : 4 + 4 * n])) + 4 + 4 * n
    return [raw[a:b] for a, b in zip([4 + 4 * n, *end[:-1].tolist()], end.tolist(), strict=True)] if n else []


def planes(numbers: np.ndarray) -> bytes:
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1)


def pack_places(places: np.ndarray) -> bytes:
    """Places, of which frequent words have small ones: two bytes each, so that repeated phrases are found, and byte by
    byte what goes beyond 65534."""
    short = np.minimum(places, 65535).astype("<u2")
    return squeeze(len(short).to_bytes(8, "little") + short.tobytes() + planes(places[places >= 65535] - 65535), 6)


def unpack_places(packed: bytes) -> np.ndarray:
    raw = loosen(packed)
    n = int.from_bytes(raw[:8], "little")
    out = np.frombuffer(raw, "<u2", n, 8).astype(np.uint32)
    out[out == 65535] += from_planes(raw[8 + 2 * n :])
    return out


def pack_ids(words: list[bytes], kind: np.dtype) -> bytes:
    """Number and ids of the tokens of each word, byte by byte."""
    size = np.array([len(w) for w in words], np.uint32) // kind.itemsize
    return squeeze(len(size).to_bytes(8, "little") + planes(size) + planes(np.frombuffer(b"".join(words), kind)), 6)


def unpack_ids(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = loosen(packed)
    n = int.from_bytes(raw[:8], "little")
    return from_planes(raw[8 : 8 + 4 * n]), from_planes(raw[8 + 4 * n :])


def word_blocks(docs: DataFrame, pattern: str, buckets: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``block, doc_ids, sizes, places, buckets, words``: words of a block by bucket, the bucket of each word by falling
    frequency, and per document the places of its words in that order."""
    names = ["block", "doc_ids", "sizes", "places", "buckets", "words"]
    words_type = pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())]))
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), words_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, number = regex.compile(pattern).findall, 0
        ids, sizes, places, known, held = [], [], [], {}, 0

        def block() -> pa.RecordBatch:
            at = np.concatenate(places)
            frequent = np.argsort(-np.bincount(at, minlength=len(known)), kind="stable")
            place = np.empty(len(known), np.uint32)
            place[frequent] = np.arange(len(known), dtype=np.uint32)
            listed = [w.encode() for w in known]
            listed = [listed[i] for i in frequent.tolist()]
            bucket = np.array([xxhash.xxh64_intdigest(w) % buckets for w in listed], np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            words = [
                {"bucket": b, "words": join_words([listed[i] for i in order[cut[b] : cut[b + 1]]])}
                for b in range(buckets)
                if cut[b] < cut[b + 1]
            ]
            packed = (pack_places(place[at]), squeeze(bucket.astype("<u4").tobytes()))
            values = [[task_block_id(number)], [ids], [sizes], [packed[0]], [packed[1]], [words]]
            return pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                for doc, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = find(value) if value else []
                    for w in found:
                        if w not in known:
                            known[w] = len(known)
                    ids.append(doc)
                    sizes.append(len(found))
                    places.append(np.fromiter(map(known.__getitem__, found), np.uint32, len(found)))
                    held += len(value or "")
                    if held >= BLOCK_BYTES:
                        yield block()
                        number, ids, sizes, places, known, held = number + 1, [], [], [], {}, 0
        if ids:
            yield block()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run,
        "block long, doc_ids array<long>, sizes array<int>, places binary, buckets binary,"
        " words array<struct<bucket:int,words:binary>>",
    )


def encode_words(words: DataFrame, ranks: str, pattern: str, buckets: int) -> DataFrame:
    """``block, bucket, ids`` from ``block, bucket, words``; a bucket lands in one task, which encodes a word once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, known, bucket = rank_encoding(ranks, pattern), {}, None
        kind = np.dtype(np.uint16 if encoding.max_token_value < 1 << 16 else np.uint32)
        for batch in batches:
            for b, own, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if own != bucket:
                    known, bucket = {}, own
                found = part_words(packed)
                for w in found:
                    if w not in known:
                        known[w] = np.array(encoding.encode_ordinary(w.decode()), kind).tobytes()
                value = pack_ids([known[w] for w in found], kind)
                yield pa.record_batch([pa.array([b], pa.int64()), pa.array([own], pa.int32()), binaries([value])], ["block", "bucket", "ids"])

    dealt = words.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.select("block", "bucket", "words").mapInArrow(run, "block long, bucket int, ids binary")


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` with the ids as little-endian unsigned 32-bit integers."""
    buckets = parts_for(docs.sparkSession, text_bytes(docs), BUCKET_BYTES)
    blocks = stage(word_blocks(docs, pattern, buckets), "word-blocks")
    words = blocks.select("block", F.explode("words").alias("w")).select("block", "w.bucket", "w.words")
    ids = encode_words(words, ranks, pattern, buckets)
    whole = ids.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "ids"))).alias("ids"))  # one block's words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a row is a block: one at a time
                row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                table = [unpack_ids(x["ids"]) for x in row["ids"] or []] or [(np.zeros(0, np.uint32),) * 2]
                at = unpack_places(row["places"])
                order = np.argsort(np.frombuffer(loosen(row["buckets"]), "<u4"), kind="stable")
                size = np.concatenate([x for x, _ in table]).astype(np.int64)
                flat = np.concatenate([x for _, x in table]).astype("<u4")
                width, first = np.empty_like(size), np.empty_like(size)
                width[order], first[order] = size, np.cumsum(size) - size
                end = np.cumsum(np.array(row["sizes"], np.int64))
                low = 0
                while low < len(end):  # documents of some 260,000 words at a time
                    begin = int(end[low - 1]) if low else 0
                    high = max(low + 1, int(np.searchsorted(end, begin + (1 << 18))))
                    own = at[begin : end[high - 1]]
                    n = width[own]
                    to = np.cumsum(n)
                    index = np.arange(to[-1] if len(to) else 0) - np.repeat(to - n, n) + np.repeat(first[own], n)
                    made = flat[index]
                    cut = np.concatenate([[0], to])[end[low:high] - begin]
                    values = [made[a:b].tobytes() for a, b in zip(np.concatenate([[0], cut[:-1]]), cut, strict=True)]
                    yield pa.record_batch([pa.array(row["doc_ids"][low:high], pa.int64()), binaries(values)], ["doc_id", "ids"])
                    low = high

    joined = blocks.select("block", "doc_ids", "sizes", "places", "buckets").join(whole, "block", "left")
    return joined.select("doc_ids", "sizes", "places", "buckets", "ids").mapInArrow(run, "doc_id long, ids binary")


def token_bytes(ranks: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes, and where each token begins."""
    with open(ranks, "rb") as f:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f)]
    table = [b""] * (max(r for r, _ in pairs) + 1)
    for rank, token in pairs:
        table[rank] = token
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum([0, *map(len, table)])


def decode(ids: bytes, table: tuple[np.ndarray, np.ndarray]) -> bytes:
    flat, start = table
    own = np.frombuffer(ids, "<u4")
    n = start[own + 1] - start[own]
    to = np.cumsum(n)
    return flat[np.arange(to[-1] if len(to) else 0) - np.repeat(to - n, n) + np.repeat(start[own], n)].tobytes()


def with_decoded(encoded: DataFrame, ranks: str, digests: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``; with ``digests`` hexadecimal SHA-256 sums in place of the two."""
    import hashlib

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kind = "string" if digests else "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                raw = part.column(1).to_pylist()
                text = [decode(x, table) for x in raw]
                if digests:
                    pair = [pa.array([hashlib.sha256(x).hexdigest() for x in v]) for v in (raw, text)]
                else:
                    pair = [binaries(raw), binaries(text)]
                yield pa.record_batch([part.column(0), pa.array([len(x) // 4 for x in raw], pa.int64()), *pair], names)

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id long, n_tokens long, {names[2]} {kind}, {names[3]} {kind}")
