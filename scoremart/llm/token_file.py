"""Token ids in a compact file format: canonical length-limited Huffman codes from global counts.

Texts are tokenized once and written as ids.  Global counts (one row per id and task, then summed) give code lengths of
at most ``MAX_BITS`` by package-merge; only lengths are stored, the canonical codes follow from them.  Documents are
dealt in ascending id order into ranges, and each range writes independent blocks: the bit stream, each document's
token count, and the bit offset of every ``STRIDE``-th token.  A reader decodes all strides of a block side by side with
one table lookup per token.

File format, a Parquet table with a row per block, ordered by (part, block): ``part int, block int, doc_ids
array<long>, sizes array<int>, checkpoints binary (little-endian unsigned 32-bit bit offsets), bits binary (most
significant bit first, padded by 8 zero bytes)``; beside it ``codes``: ``id int, length int``.

A literal special token in a text gets its id, as by the library.  Null and empty texts give only the end id; repeated rows are written each; null document ids come first; an empty table
gives an empty file; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import binaries, binary_column, parts_for, pieces, stage
from .words import split_runs, word_hashes

MAX_BITS = 16
#: Ids between the steps; codes of ``MAX_BITS`` bits cannot tell more apart.
IDS = "<u2"
STRIDE = 256
BLOCK_TOKENS = 1 << 19
PART_BYTES = 64 << 20
#: Characters of text that are tokenized together, and words whose ids a task remembers.
GROUP_CHARS = 3 << 20
MEMORY = 300_000
_BLANKS = re.compile(r"[ \t\n\r\x0b\x0c]+")


class WordEncoder:
    """Encodes texts word by word, each distinct word of a group of texts once.

    For the tokenizer whose rules are stated below: it drops white space, so that no token, merge or normal form reaches
    across it.  Text of Latin-1 characters, which lower-casing and composition leave as many as they are, is cut into
    words here; any other white-space separated chunk is left to the tokenizer as it is.
    """

    #: How the tokenizer's file cuts lower-case text, and its mark for a word's last token.
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0\p{L}\p{N}]+"
    SUFFIX = "</w>"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(self.SUFFIX)]] = True
        self.cut = regex.compile(self.WORDS).findall
        #: Kinds of Latin-1 characters: white space 0, letters 1, digits (words by themselves) 2, others 3.
        kind = {w: 1 if w.isalpha() else 2 if regex.fullmatch(r"\p{N}", w) else 3 for w in self.cut("".join(map(chr, range(256))))}
        self.kinds = np.array([max((k for w, k in kind.items() if chr(i) in w), default=0) for i in range(256)], np.uint8)
        self.known: dict[str, bytes] = {}
        #: Latin-1 words by ascending hash: where the ids of each begin, and how many it has.
        self.hashes, self.flat = np.zeros(0, np.uint64), np.zeros(0, IDS)
        self.first, self.width = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def words(self, text: str) -> list[str]:
        """Parts of a text that can be encoded by themselves."""
        if is_latin(text):
            return self.cut(text.lower())
        out: list[str] = []
        for chunk in _BLANKS.split(text):
            if is_latin(chunk):
                out += self.cut(chunk.lower())
            else:
                out.append(chunk)
        return out

    def encode_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of Latin-1 words one after the other, and how many each has.  The words are tokenized as one text, whose
        tokens are dealt out at word ends."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, IDS)
        end = np.flatnonzero(self.last[ids]) + 1
        if len(end) == len(words) and end[-1] == len(ids):
            return ids, np.diff(end, prepend=0)
        made = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(made)), IDS), np.array([len(x) for x in made], np.int64)

    def encode_new(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words."""
        out: dict[str, bytes] = {}
        plain = [w for w in words if is_latin(w)]
        if plain:
            ids, width = self.encode_plain(plain)
            raw, end = ids.tobytes(), np.cumsum(width).tolist()
            out = {w: raw[2 * a : 2 * b] for w, a, b in zip(plain, [0, *end[:-1]], end, strict=True)}
        rest = [w for w in words if w not in out]
        for w, made in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            out[w] = np.array(made.ids, IDS).tobytes()
        return out

    def places(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, joined: bytes) -> np.ndarray:
        """The row in the table of each of the distinct words of a group; words that are new to it are added.  When they
        are too many, only those of the group stay."""
        at = np.searchsorted(self.hashes, hashes)
        old = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        old[inside] = self.hashes[at[inside]] == hashes[inside]
        if len(self.hashes) > MEMORY:
            keep = at[old]
            self.hashes, self.flat = self.hashes[keep], gather(self.flat, self.first[keep], self.width[keep])
            self.width = self.width[keep]
            self.first = np.cumsum(self.width) - self.width
        fresh = np.flatnonzero(~old)
        words = [joined[a:b].decode("latin-1") for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)]
        made = [self.encode_plain(words[low : low + 2_000]) for low in range(0, len(words), 2_000)]
        if made:
            width = np.concatenate([w for _, w in made])
            first = len(self.flat) + np.cumsum(width) - width
            self.flat = np.concatenate([self.flat, *(ids for ids, _ in made)])
            order = np.argsort(np.concatenate([self.hashes, hashes[fresh]]), kind="stable")
            self.hashes = np.concatenate([self.hashes, hashes[fresh]])[order]
            self.first, self.width = np.concatenate([self.first, first])[order], np.concatenate([self.width, width])[order]
        return np.searchsorted(self.hashes, hashes)

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """Little-endian ids of 16 bits of each text, the end id last.

        Words are remembered for the next groups; when they are too many, only those of the last group stay.  Latin-1
        texts without apostrophes are cut and looked up as arrays, each distinct word of the group once.  Texts that hold
        a special token are left to the tokenizer whole.
        """
        tail = end.to_bytes(2, "little")
        out = [b""] * len(texts)
        marked = {i for i, x in enumerate(texts) if x and any(t in x for t in self.special)}
        for i in sorted(marked):
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, IDS).tobytes() + tail
        fast = [i for i, x in enumerate(texts) if x and i not in marked and "'" not in x and is_latin(x)]
        slow = sorted(set(range(len(texts))) - set(fast) - marked)
        split = [self.words(texts[i]) if texts[i] else [] for i in slow]
        met = set(chain.from_iterable(split))
        if len(self.known) > MEMORY:
            self.known = {w: x for w, x in self.known.items() if w in met}
        known = self.known
        new = list(met - known.keys())
        for low in range(0, len(new), 2_000):
            known |= self.encode_new(new[low : low + 2_000])
        for i, words in zip(slow, split, strict=True):
            out[i] = b"".join(map(known.__getitem__, words)) + tail

        raw = [texts[i].lower().encode("latin-1") for i in fast]
        joined = b"".join(raw)
        data, bounds = np.frombuffer(joined, np.uint8), np.cumsum([0, *map(len, raw)])
        starts, ends, row = split_runs(data, bounds, self.kinds, single=2)
        hashes, one, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        own = self.places(hashes, starts[one], ends[one], joined)[back]
        made = gather(self.flat, self.first[own], self.width[own])
        to = np.concatenate([[0], np.cumsum(self.width[own])])
        cut = to[np.searchsorted(row, np.arange(len(fast) + 1))].tolist()
        for k, i in enumerate(fast):
            out[i] = made[cut[k] : cut[k + 1]].tobytes() + tail
        return out


def gather(flat: np.ndarray, first: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` that begin at ``first``, one after the other."""
    to = np.cumsum(width)
    return flat[np.arange(to[-1] if len(to) else 0) - np.repeat(to - width - first, width)]


def is_latin(text: str) -> bool:
    """Whether all characters are below U+0100."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def token_ids(docs: DataFrame, tokenizer: str, end: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids`` with the ids as little-endian unsigned integers of 16 bits (``IDS``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        for batch in batches:
            for low, high, _, _ in pieces(batch.column(1), GROUP_CHARS):
                part = batch.slice(low, high - low)
                ids = encoder.encode(part.column(1).to_pylist(), end)
                yield pa.record_batch([part.column(0), binaries(ids)], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, ids binary"
    )


def id_counts(ids: DataFrame) -> DataFrame:
    """``id, n``: how often each id occurs; every task sends at most one row per id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(binary_column(batch.column(0))[0].tobytes(), IDS))
            total = np.pad(total, (0, max(0, len(found) - len(total))))
            total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["id", "n"])

    return ids.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    levels, merged = [], weight
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(weight))
        merged = both[rank]
    take, found = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        found[:leaves] += 1
        take = 2 * (take - leaves)
    found[:take] += 1
    lengths[order] = found
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order of (length, id), and the code of each id."""
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    size = lengths[order]
    top = np.cumsum(1 << (MAX_BITS - size)) - (1 << (MAX_BITS - size))
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = top >> (MAX_BITS - size)
    return order, codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """Checkpoints and bit stream of one block."""
    size = lengths[ids]
    end = np.cumsum(size)
    start = end - size
    code, space = codes[ids], 32 - (start & 31) - size  # bits left in the 32-bit word that the code starts in
    over = np.maximum(-space, 0)
    head = (code >> over) << np.maximum(space, 0)
    rest = np.where(over > 0, (code & ((1 << over) - 1)) << (32 - over), 0)
    words = int(end[-1] + 31) // 32 if len(ids) else 0
    first = start >> 5
    total = np.bincount(first, head, words) + np.bincount(first + 1, rest, words + 1)[:words] if words else np.zeros(0)
    return start[::STRIDE].astype("<u4").tobytes(), total.astype(np.int64).astype(">u4").tobytes() + b"\0" * 8


def decode_tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for each value of the next ``MAX_BITS`` bits."""
    order, _ = canonical(lengths)
    spans = 1 << (MAX_BITS - lengths[order])
    ids = np.repeat(order, spans)
    return np.pad(ids, (0, (1 << MAX_BITS) - len(ids))), np.pad(np.repeat(lengths[order], spans), (0, (1 << MAX_BITS) - len(ids)))


def unpack(n: int, checkpoints: bytes, bits: bytes, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ``n`` ids of one block, all strides in step."""
    ids, size = tables
    raw = np.frombuffer(bits, np.uint8).astype(np.int64)
    window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
    out = np.zeros((STRIDE, len(at)), np.int64)
    for k in range(min(STRIDE, n)):
        peek = (window[np.minimum(at >> 3, len(window) - 1)] >> (8 - (at & 7))) & 0xFFFF
        out[k] = ids[peek]
        at = at + size[peek]
    return out.T.reshape(-1)[:n]


def write_token_file(ids: DataFrame, path: str) -> None:
    """Writes ``path/codes`` and ``path/blocks`` from ``doc_id, ids``."""
    spark = ids.sparkSession
    counts = id_counts(ids).toPandas()  # bounded by the vocabulary
    table = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    table[counts["id"]] = counts["n"]
    lengths = code_lengths(table)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, length int").coalesce(1).write.parquet(f"{path}/codes")
    _, codes = canonical(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, docs, parts, held = 0, [], [], 0

        def block() -> pa.RecordBatch:
            checkpoints, bits = pack(np.concatenate(parts), lengths, codes)
            columns = [[part], [number], [docs], [[len(x) for x in parts]], [checkpoints], [bits]]
            return pa.record_batch([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names)

        names = ["part", "block", "doc_ids", "sizes", "checkpoints", "bits"]
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        part = 0
        for batch in batches:
            for p, doc, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                part = p
                docs.append(doc)
                parts.append(np.frombuffer(raw, IDS).astype(np.int64))
                held += len(parts[-1])
                if held >= BLOCK_TOKENS:
                    yield block()
                    number, docs, parts, held = number + 1, [], [], 0
        if docs:
            yield block()

    n = parts_for(spark, int(table.sum()) * 4, PART_BYTES)
    ordered = ids.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("ids"))
    ordered.select(F.spark_partition_id().alias("part"), "doc_id", "ids").mapInArrow(
        run, "part int, block int, doc_ids array<long>, sizes array<int>, checkpoints binary, bits binary"
    ).write.option("compression", "none").parquet(f"{path}/blocks")


def read_token_file(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (or ``ids_crc32`` instead of the ids) of each document, from the file."""
    found = spark.read.parquet(f"{path}/codes").toPandas()  # bounded by the vocabulary
    lengths = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    lengths[found["id"]] = found["length"]
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.select("part", "block", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))  # one row per written part
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    start = F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    starts = sizes.join(base, "part").select("part", "block", start.alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = decode_tables(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                size = np.array(row["sizes"], np.int64)
                ids = unpack(int(size.sum()), row["checkpoints"], row["bits"], tables).astype("<u4")
                end = np.cumsum(size)
                raw = [ids[a:b].tobytes() for a, b in zip(end - size, end, strict=True)]
                last = pa.array([zlib.crc32(x) for x in raw], pa.int64()) if digest else binaries(raw)
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + end - size), pa.array(size), last]
                yield pa.record_batch(columns, ["doc_id", "start", "n_tokens", name])

    name = "ids_crc32" if digest else "ids"
    return blocks.join(starts, ["part", "block"]).select("doc_ids", "sizes", "checkpoints", "bits", "start").mapInArrow(
        run, f"doc_id long, start long, n_tokens long, {name} {'long' if digest else 'binary'}"
    )


def staged_ids(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    return stage(token_ids(docs, tokenizer, end), "token-ids")
