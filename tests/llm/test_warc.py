import hashlib

import pyarrow as pa
import zstandard

from termloom.llm import warc
from termloom.session import scratch_path

BIG = "<p>é" + "x" * 2000
ROWS = [
    (1, "http://a/", BIG, "d"), (7, "http://b/\r\nX: y", BIG, "d"), (3, None, BIG, "d"), (7, "http://b/", BIG, "d"),
    (4, "http://c/", "small", "d"), (5, "http://d/", "small", "d"), (6, "e", None, "d"), (None, "f", BIG, "d"),
    (8, "g", "y" * 3_000_000, "d"), (9, "h", "\r\n\r\n" * 400, "d"),
]
SCHEMA = "page_id bigint, url string, html string, digest string"


def test_round_trip(spark):
    folder = scratch_path(spark, "test_warc")
    index = warc.write_bundles(spark.createDataFrame(ROWS, SCHEMA), folder)
    found = warc.read_bundles(index, folder).collect()
    assert sorted(str(r["page_id"]) for r in found) == sorted(str(row[0]) for row in ROWS)
    texts = {row[0]: (row[2] or "").encode() for row in ROWS}
    for row in found:
        payload = texts[row["page_id"]]
        assert row["payload_bytes"] == len(payload)
        assert row["payload_digest"] == hashlib.sha1(payload).hexdigest()
        revisits = row["page_id"] in (1, 3, None)
        assert row["record_type"] == ("revisit" if revisits else "response")
        assert row["refers_to"] == (7 if revisits else None)
        assert row["payload"] == (None if revisits else payload)
    for row in index.collect():
        record = warc.read_record(row, folder)
        assert record.fields["warc-record-id"] == row["record_id"]


def test_any_reader_reads_a_bundle():
    sink = pa.BufferOutputStream()
    writer = warc.BundleWriter(sink, "b")
    records = [warc.record(i, "u", bytes([i]) * 90_000, "00" * 20, None, False) for i in range(9)]
    for i, data in enumerate(records):
        writer.add(str(i), data)
    writer.close()
    whole = sink.getvalue().to_pybytes()
    assert len(writer.frames) == 3
    read = zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read()
    assert read == b"".join(records)


def test_no_pages(spark):
    folder = scratch_path(spark, "test_warc")
    index = warc.write_bundles(spark.createDataFrame([], SCHEMA), folder)
    assert warc.read_bundles(index, folder).collect() == []
