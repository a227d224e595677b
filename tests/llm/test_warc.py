"""WARC archives: exact round trips, segments and broken files."""

import gzip
import hashlib
import os

import pytest
from pyspark.errors import PythonException

from platwork.llm.warc import BrokenArchive, chunked, dechunked, parse, read_records, read_warc, reassemble, records_of, write_warc

LONG = bytes(range(256)) * 400
PAYLOADS = [
    (1, "http://a/", b"x" * 100), (2, "http://b/", b"x" * 100), (3, None, b"x" * 99), (4, "http://d/\r\nX: y", b"x" * 99), (5, "u", LONG), (6, "u", LONG),
    (7, "%41 é", None), (8, "h", b""), (9, "i", b"\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9), (9, "i", b"\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9),
    (None, "j", b"only" * 50), (10, "k", "zürich ".encode() * 3000), (0, "l", LONG),
]


@pytest.mark.parametrize("segment", [64, 16384, 1 << 20])
def test_round_trip(spark, tmp_path, segment):
    pages = spark.createDataFrame(PAYLOADS, "page_id long, url string, payload binary").repartition(3)
    write_warc(pages, str(tmp_path / "w"), segment_bytes=segment, file_records=50)
    got = [(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in read_warc(spark, str(tmp_path / "w")).collect()]
    want = []
    for i, url, p in PAYLOADS:
        p = p or b""
        least = min((j for j, _, q in PAYLOADS if q == p and j is not None), default=None) if len(p) >= 100 else i
        again = least is not None and least != i
        want.append((i, url, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", least if again else None, None if again else p))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_files_are_gzip_warc(spark, tmp_path):
    write_warc(spark.createDataFrame(PAYLOADS[:2], "page_id long, url string, payload binary"), str(tmp_path / "w"))
    data = b"".join(gzip.open(tmp_path / "w" / f).read() for f in os.listdir(tmp_path / "w") if f.endswith(".gz"))
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n") and data.count(b"WARC/1.1\r\n") == 2


def test_chunked_framing():
    for payload in (b"", b"a", LONG, b"\r\n0\r\n\r\n"):
        assert dechunked(chunked(payload, 7)) == payload
    assert dechunked(b"3;name=value\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for broken in (b"", b"zz\r\nab\r\n0\r\n\r\n", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(BrokenArchive):
            dechunked(broken)


def test_cut_files_are_refused():
    record = records_of(1, "u", LONG, hashlib.sha256(LONG).hexdigest(), None, "n", 1 << 20)[0] + b"\r\n"
    assert len(list(parse([gzip.compress(record), gzip.compress(record)]))) == 2
    for bad in (record[:-9], record + b"WARC/1.1", record.replace(b"WARC/1.1", b"HTTP/1.1")):
        with pytest.raises(BrokenArchive):
            list(parse([gzip.compress(bad)]))


def test_missing_segment_is_refused(spark, tmp_path):
    write_warc(spark.createDataFrame([(1, "u", LONG)], "page_id long, url string, payload binary"), str(tmp_path / "w"), segment_bytes=9000)
    records = read_records(spark, str(tmp_path / "w"))
    assert reassemble(records).count() == 1
    for lost in ("segment = 2", "total_length IS NOT NULL"):
        with pytest.raises(PythonException, match="BrokenArchive"):
            reassemble(records.filter(f"NOT ({lost}) OR segment IS NULL" if "segment" in lost else "total_length IS NULL")).collect()


def test_empty_table(spark, tmp_path):
    write_warc(spark.createDataFrame([], "page_id long, url string, payload binary"), str(tmp_path / "w"))
    assert read_warc(spark, str(tmp_path / "w")).collect() == []
