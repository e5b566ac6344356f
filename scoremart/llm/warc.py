"""WARC archives of pages with a two-level capture index.

Writing: payload digests find equal payloads; the record of the least page id is a response, the others revisit it.  Each
record is a gzip member whose extra field ``sl`` holds its compressed and full length, as the WARC standard proposes, so
that a reader steps over members without unpacking them.  Spark's text writer puts the members into files of about
``ARCHIVE_BYTES`` through its own commit protocol; the separator that it demands is an empty gzip member.

Index: one line per capture, ``reversed-host key, page id, type, file, offset, length``, sorted by key.  Runs of
``BLOCK_LINES`` lines are compressed into blocks; a sparse directory keeps the first and last key of each block.  A
look-up finds the shard among the shard bounds, binary-searches the shard's directory, unpacks only the blocks that can
hold the key, binary-searches their lines, and reads the named byte range of the archive.

A null html is an empty payload.  A null url has the key "" and no target URI.  A url with line breaks or outer
white space has them escaped or stripped in its target URI and key, and is kept as it is in a header of its own.  A null page id is always a response and
never referred to.  Rows equal in page id and payload are of the same type.  An empty table writes no record and gives empty results.  Other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts_for

ARCHIVE_BYTES = 64 << 20
SHARD_BYTES = 64 << 20
BLOCK_LINES = 1000
#: An empty gzip member, as Latin-1 text.
SEPARATOR = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00".decode("latin-1")
INDEX = "shard long, block long, first string, last string, n long, lines binary"
ENTRY = "surt string, page_id long, record_type string, file string, offset long, length long"


def header_url(url: str) -> str:
    """A URL as it stands in a header: on one line, without outer white space."""
    return url.strip().replace("\r", "%0D").replace("\n", "%0A")


def surt(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then port, path and query; scheme, user and fragment do not count.  Taken
    from the URL's form in a header, so that the index and a look-up have the same key."""
    url = header_url(url or "")
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url
    if not host:
        return url
    default = {"http": 80, "https": 443}.get(parts.scheme)
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port != default else "") + f"){tail}"


def url_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of a column of URLs, for ``mapInArrow``."""
    for batch in batches:
        yield pa.record_batch([pa.array([surt(x) for x in batch.column(0).to_pylist()], pa.string())], ["surt"])


def record_urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(content: bytes) -> bytes:
    """One gzip member with its lengths in the extra field."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(content) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + (12).to_bytes(2, "little") + b"sl" + (8).to_bytes(2, "little")
    sizes = total.to_bytes(4, "little") + (len(content) & 0xFFFFFFFF).to_bytes(4, "little")
    tail = zlib.crc32(content).to_bytes(4, "little") + (len(content) & 0xFFFFFFFF).to_bytes(4, "little")
    return head + sizes + body + tail


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A WARC record; ``refers_to`` makes it a revisit."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_urn(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {json.dumps(page_id)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + header_url(url))
        if header_url(url) != url:
            lines.append("X-Page-Url: " + json.dumps(url))
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_urn(refers_to)}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of an unpacked record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    _, _, payload = rest[: int(headers["content-length"])].partition(b"\r\n\r\n")
    return headers, payload


def members(data: bytes) -> Iterator[tuple[int, int]]:
    """Offset and length of each record in an archive, found from the extra fields alone."""
    at = 0
    while at < len(data):
        if data[at + 3] & 4:
            length = int.from_bytes(data[at + 16 : at + 20], "little")
            yield at, length
            at += length
        else:
            at += len(SEPARATOR)


def unpack(data: bytes, most: int = 0) -> bytes:
    """Content of one member written by ``member``; with ``most``, its first bytes only."""
    return zlib.decompressobj(-15).decompress(data[24:-8], most)


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, sha, refers_to`` of the pages whose payload a page of smaller id has too; narrow rows only."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    narrow = pages.select("page_id", F.unhex(F.sha1(payload)).alias("sha"), F.octet_length(payload).alias("n"))
    narrow = narrow.where(F.col("n") >= least_bytes)
    firsts = narrow.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    repeated = firsts.where((F.col("copies") > 1) & F.col("first").isNotNull()).select("sha", "first")
    later = narrow.join(repeated, "sha").where(F.col("page_id") > F.col("first"))
    return later.select("page_id", "sha", F.col("first").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """One record per row of ``pages`` into archives below ``path``."""
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    n = parts_for(pages.sparkSession, size, ARCHIVE_BYTES)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    # Dealt by the join's keys, so that the join moves only the narrow side.
    rows = keyed.repartition(n, "page_id", "sha").join(revisits(pages, least_bytes), ["page_id", "sha"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                rows = zip(*(part.column(i).to_pylist() for i in range(4)), strict=True)
                yield pa.record_batch([pa.array([member(record(*row, date)) for row in rows], pa.binary())], ["value"])

    made = rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "value binary")
    made.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``file, content`` of each archive; a file has some ``ARCHIVE_BYTES`` of pages."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def index_entries(archives: DataFrame) -> DataFrame:
    """One entry per record, from the archives alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ENTRY.split(", ")]
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                name, data = file.as_py(), content.as_buffer()
                data = memoryview(data)
                out = []
                for at, length in members(data):
                    raw = unpack(data[at : at + length], 4096)
                    while b"\r\n\r\n" not in raw and len(raw) % 4096 == 0 and raw:  # very long headers
                        raw = unpack(data[at : at + length], len(raw) + 4096)
                    head = raw.partition(b"\r\n\r\n")[0].decode("utf-8", "replace").split("\r\n")[1:]
                    h = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head)}
                    out.append((surt(h.get("warc-target-uri")), json.loads(h["x-page-id"]), h["warc-type"], name, at, length))
                columns = zip(*out, strict=True) if out else [[]] * 6
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return archives.select("file", "content").mapInArrow(run, ENTRY)


def write_index(entries: DataFrame, path: str) -> None:
    """Sorted, compressed blocks: ``shard, block, first, last, n, lines``.  A key of many captures spreads over shards."""
    names = ["shard", "block", "first", "last", "n", "lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, shard = [], 0, 0

        def block() -> pa.RecordBatch:
            lines = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in held).encode())
            values = [shard, number, held[0][0], held[-1][0], len(held), lines]
            return pa.record_batch([pa.array([v]) for v in values], names)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                shard = row[6]
                held.append(row[:6])
                if len(held) == BLOCK_LINES:
                    yield block()
                    held, number = [], number + 1
        if held:
            yield block()

    size = entries.agg(F.sum(F.octet_length("surt") + 60)).first()[0] or 0
    n = parts_for(entries.sparkSession, size, SHARD_BYTES)
    ordered = entries.repartitionByRange(n, "surt", "page_id", "file", "offset").sortWithinPartitions("surt", "page_id", "file", "offset")
    fields = [x.split()[0] for x in ENTRY.split(", ")]
    ordered.select(*fields, F.spark_partition_id().cast("long").alias("shard")).mapInArrow(
        run, INDEX
    ).write.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def search_block(lines: list[list], key: str) -> list[list]:
    """The lines of one unpacked block whose key is ``key``."""
    low = bisect.bisect_left(lines, key, key=lambda x: x[0])
    return lines[low : bisect.bisect_right(lines, key, low, key=lambda x: x[0])]


def look_up(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries of every key in column ``surt`` of ``keys``."""
    # One row per shard, at most some thousands: their number is the index size by SHARD_BYTES.
    bounds = index.groupBy("shard").agg(F.min("first").alias("first"), F.max("last").alias("last")).orderBy("shard").collect()
    firsts, lasts, shards = ([r[k] for r in bounds] for k in ("first", "last", "shard"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (shard, key)
                for key in batch.column(0).to_pylist()
                for shard in shards[bisect.bisect_left(lasts, key) : bisect.bisect_right(firsts, key)]
            ]
            yield pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], ["shard", "surt"])

    def search(wanted: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        first, last, packed = (blocks[k].tolist() for k in ("first", "last", "lines"))
        out, held, lines = [], -1, []
        for key in sorted(wanted["surt"]):
            for b in range(bisect.bisect_left(last, key), bisect.bisect_right(first, key)):
                if b != held:
                    held, lines = b, [json.loads(x) for x in zlib.decompress(packed[b]).decode().split("\n")]
                out += search_block(lines, key)
        found = pd.DataFrame(out, columns=[x.split()[0] for x in ENTRY.split(", ")], dtype=object)
        return found.astype({"page_id": "Int64", "offset": "int64", "length": "int64"})

    routed = keys.select("surt").distinct().mapInArrow(route, "shard long, surt string")
    return routed.groupBy("shard").cogroup(index.select("shard", "block", "first", "last", "lines").groupBy("shard")).applyInPandas(search, ENTRY)


def read_records(entries: DataFrame, archives: DataFrame) -> DataFrame:
    """The records at the byte ranges of ``entries``: ``page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload``; a revisit has the payload of the record that it refers to only by that reference."""
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"

    def read(wanted: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        out = []
        for content in files["content"]:
            data = memoryview(content)
            for at, length in sorted(zip(wanted["offset"].tolist(), wanted["length"].tolist(), strict=True)):
                h, payload = parse_record(unpack(data[at : at + length]))
                response = h["warc-type"] == "response"
                refers = None if response else int(h["x-refers-to-page-id"])
                stated = h["warc-payload-digest"].removeprefix("sha1:")
                own = digest(payload) if response else stated
                if own != stated:
                    raise ValueError(f"record at {at} does not have the payload of its digest")
                size = len(payload) if response else None
                url = json.loads(h["x-page-url"]) if "x-page-url" in h else h.get("warc-target-uri")
                out.append((json.loads(h["x-page-id"]), url, h["warc-type"], refers, size, own, payload if response else None))
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")], dtype=object)
        return frame.astype({k: "Int64" for k in ("page_id", "refers_to", "payload_bytes")})

    return entries.select("file", "offset", "length").groupBy("file").cogroup(archives.groupBy("file")).applyInPandas(read, schema)


def resolve(records: DataFrame) -> DataFrame:
    """Payload sizes of revisits, taken from the responses that they name."""
    narrow = records.select("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest")
    sizes = narrow.where(F.col("record_type") == "response").groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("sum")).agg(F.max("payload_bytes").alias("size"))
    joined = narrow.join(sizes, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("sum")), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url")
