"""WARC archives: writing with duplicates as revisits, and reading back with segment reassembly.

Writing: one logical record per page. Payloads are framed as HTTP messages with chunked transfer
encoding; a block above ``segment_bytes`` is written as a first record and continuation records.
Of equal payloads of at least ``least`` bytes the one with the smallest id is a response, the
others revisit it. Spark's text writer lays the records out as gzip files in the shared folder
(a record ends in CR LF CR LF; the second pair is the writer's line separator).

Reading: files are parsed as streams; continuation records are grouped by their origin, put in
order of their segment numbers, checked against the stated total length, and the chunked framing
is decoded.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platwork.llm.common import slices, table
from platwork.operators.skew import salted_join
from platwork.session import shared_dir

LEAST_SHARED = 100
CHUNK = 8192
SEGMENT = 16 << 10
# Records per file: with segments of SEGMENT bytes a file stays below 64 MB uncompressed.
FILE_RECORDS = 4096
READ = 1 << 20
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PARSED = (
    "record_id string, warc_type string, origin string, segment int, total_length long, page_id long, url string,"
    " refers_to long, payload_bytes long, payload_digest string, block binary"
)
READ_BACK = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
)


class BrokenArchive(ValueError):
    """A record, segment or chunk that does not agree with what its headers say."""


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0:
            raise BrokenArchive("A chunk without a size")
        if size == 0:
            return b"".join(out)
        piece = body[end + 2 : end + 2 + size]
        if len(piece) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise BrokenArchive("A chunk of another length than stated")
        out.append(piece)
        at = end + 4 + size


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its last CR LF."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n"


def _header_text(value: str | None) -> str | None:
    """A header value on one line: percent-encoded where it holds controls or blanks at its ends."""
    return None if value is None else "".join(f"%{ord(c):02X}" if c < "!" or c in "%\x7f" else c for c in value)


def _plain_text(value: str | None) -> str | None:
    if value is None or "%" not in value:
        return value
    head, *rest = value.split("%")
    return head + "".join(chr(int(r[:2], 16)) + r[2:] for r in rest)


def records_of(page_id, url, payload: bytes, digest: str, refers_to, name: str, segment_bytes: int) -> list[bytes]:
    """The records of one page; ``name`` tells this row from every other row."""
    own = f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"
    about = [("X-Page-Id", page_id), ("WARC-Target-URI", _header_text(url)), ("X-Payload-Length", len(payload)), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *about, ("X-Refers-To-Page", refers_to)], b"")]
    block = HTTP + chunked(payload)
    if len(block) <= segment_bytes:
        return [_record([("WARC-Type", "response"), ("WARC-Record-ID", own), *about], block)]
    parts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", own), *about, ("WARC-Segment-Number", 1)], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        out.append(
            _record(
                [
                    ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{name}/{k}')}>"),
                    ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total),
                ],
                part,
            )
        )
    return out


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip file that comes in pieces."""
    unzip, held = zlib.decompressobj(31), bytearray()
    source, over = iter(pieces), False

    def more() -> bool:
        nonlocal unzip, over
        while not over:
            data = unzip.unconsumed_tail or (unzip.unused_data if unzip.eof else b"") or next(source, None)
            if data is None:
                over = True
                break
            if unzip.eof:
                unzip = zlib.decompressobj(31)
            got = unzip.decompress(data, READ)
            if got:
                held.extend(got)
                return True
        return False

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held:
                    raise BrokenArchive("A file that ends within a record's headers")
                return
        first, *lines = held[:end].decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines)
        if not first.startswith("WARC/") or "Content-Length" not in headers:
            raise BrokenArchive("Not a WARC record")
        size = int(headers["Content-Length"])
        while len(held) < end + 4 + size + 4:
            if not more():
                raise BrokenArchive("A file that ends within a record's block")
        block = bytes(held[end + 4 : end + 4 + size])
        if held[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise BrokenArchive("A block of another length than stated")
        del held[: end + 8 + size]
        yield headers, block


def mark_revisits(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """Rows (page_id, url, payload, payload_digest) with the ``refers_to`` of revisits.

    Rows equal in id and payload to the response count as responses too; a null id is smaller than
    no other id, so a payload with null ids only has responses only.
    """
    rows = pages.withColumn("payload", F.coalesce(F.col("payload"), F.lit("").cast("binary"))).withColumn(
        "payload_digest", F.sha2("payload", 256)
    )
    keyed = rows.withColumn("_key", F.when(F.length("payload") >= least, F.col("payload_digest")))
    groups = keyed.filter("_key IS NOT NULL").groupBy("_key").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    shared = groups.filter("_n > 1")
    joined = salted_join(keyed, shared.select("_key", "_first"), ["_key"], shared.select("_key", "_n"), "_n", "left")
    other = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.withColumn("refers_to", F.when(other, F.col("_first"))).drop("_first", "_key")


def write_warc(
    pages: DataFrame, path: str, least: int = LEAST_SHARED, segment_bytes: int = SEGMENT, file_records: int = FILE_RECORDS
) -> None:
    """Write rows (page_id long, url string, payload binary) as ``path``/*.txt.gz WARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for small in slices(batch, "payload"):
                out = []
                for r in small.to_pylist():
                    name = f"{part}/{row}/{r['page_id']}/{r['payload_digest']}"
                    out += records_of(r["page_id"], r["url"], r["payload"], r["payload_digest"], r["refers_to"], name, segment_bytes)
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    rows = mark_revisits(pages.select("page_id", "url", "payload"), least)
    records = rows.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n").option(
        "compression", "gzip"
    ).option("maxRecordsPerFile", file_records).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The raw records of the archives below ``path``, blocks undecoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("record_id", pa.string()), ("warc_type", pa.string()), ("origin", pa.string()), ("segment", pa.int32()),
                ("total_length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()),
                ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block", pa.binary()),
            ]
        )
        number = lambda h, k: int(h[k]) if k in h else None
        for batch in batches:
            for content in batch.column("content"):
                data = memoryview(content.as_buffer())
                rows, held = [], 0
                for h, block in parse(data[at : at + READ] for at in range(0, len(data), READ)):
                    rows.append(
                        (
                            h["WARC-Record-ID"], h["WARC-Type"], h.get("WARC-Segment-Origin-ID"), number(h, "WARC-Segment-Number"),
                            number(h, "WARC-Segment-Total-Length"), number(h, "X-Page-Id"), _plain_text(h.get("WARC-Target-URI")),
                            number(h, "X-Refers-To-Page"), number(h, "X-Payload-Length"),
                            h.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None, block,
                        )
                    )
                    held += len(block)
                    if held > 8 * READ:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, PARSED)


def reassemble(records: DataFrame) -> DataFrame:
    """One row per logical record: segments joined in order, lengths and digests checked, payload decoded.

    A missing, repeated or surplus segment, a total length or a digest that differs, and a broken
    chunk raise BrokenArchive: nothing is passed over in silence. An empty table gives an empty one.
    """
    whole = records.filter("segment IS NULL").select(
        "page_id", "url", "refers_to", "payload_bytes", "payload_digest", "warc_type",
        F.lit(None).cast("array<int>").alias("numbers"), F.lit(None).cast("long").alias("total_length"),
        F.array("block").alias("blocks"),
    )
    # The first segment goes by its own id, the others by their origin: one group is one payload.
    grouped = (
        records.filter("segment IS NOT NULL").withColumn("_key", F.coalesce("origin", "record_id")).groupBy("_key")
        .agg(
            *(F.first(c, True).alias(c) for c in ("page_id", "url", "refers_to", "payload_bytes", "payload_digest")),
            F.max("total_length").alias("total_length"),
            F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        )
        .select(
            "page_id", "url", "refers_to", "payload_bytes", "payload_digest", F.lit("response").alias("warc_type"),
            F.col("parts.segment").alias("numbers"), "total_length", F.col("parts.block").alias("blocks"),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                block = b"".join(r["blocks"])
                if r["numbers"] is not None and (
                    r["numbers"] != list(range(1, len(r["numbers"]) + 1)) or r["total_length"] != len(block)
                ):
                    raise BrokenArchive(f"Segments {r['numbers']} with {len(block)} of {r['total_length']} bytes")
                payload = None
                if r["warc_type"] == "response":
                    head, _, body = block.partition(b"\r\n\r\n")
                    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                    if hashlib.sha256(payload).hexdigest() != r["payload_digest"]:
                        raise BrokenArchive("A payload of another digest than stated")
                out.append(
                    (
                        r["page_id"], r["url"], r["payload_bytes"] if payload is None else len(payload), r["payload_digest"],
                        r["warc_type"], r["refers_to"], payload,
                    )
                )
            if out:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return whole.unionByName(grouped).mapInArrow(run, READ_BACK)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The pages of the archives below ``path``; a revisit's ``payload`` is null."""
    return reassemble(read_records(spark, path))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    path = shared_dir(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first_id FROM p GROUP BY digest),
m AS (SELECT p.*, first_id, CAST(octet_length(encode(html)) AS BIGINT) AS n FROM p JOIN f USING (digest))
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM m
"""
