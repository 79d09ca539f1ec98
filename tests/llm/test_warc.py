import hashlib

import zstandard
from pyspark.sql import functions as F

from zonecast.llm import warc
from zonecast.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, record_type string, payload_bytes string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


BIG = "é" * 80
ROWS = [
    (5, "http://a/", BIG),
    (3, "http://b/", BIG),
    (3, "http://b/", BIG),
    (None, "http://c/", BIG),
    (6, None, None),
    (7, "http://d/ x\r\ny", ""),
    (8, "http://e/", "small"),
    (9, "http://f/", "small"),
    (None, "http://g/", "n" * 200),
    (None, "http://g/", "n" * 200),
    (10, "http://h/", "\r\n\r\nWARC/1.1\r\n" * 60_000),
]


def test_round_trip(spark):
    bundles = warc.write_bundles(pages(spark, ROWS))
    back = [r for r in warc.read_bundles(bundles).collect()]
    got = sorted(((r.page_id, r.record_type, r.refers_to, bytes(r.payload).decode(), r.full_bytes) for r in back), key=str)
    want = []
    for page, _, html in ROWS:
        html = html or ""
        again = html == BIG and page != 3
        want.append((page, "revisit" if again else "response", 3 if again else None, "" if again else html, len(html.encode())))
    assert got == sorted(want, key=str)
    assert {r.digest for r in back} == {hashlib.sha256((h or "").encode()).hexdigest() for *_, h in ROWS}


def test_bundles_are_plain_zstandard_and_seekable(spark):
    rows = [(i, f"http://x/{i}", f"page {i} " * 3000) for i in range(60)]
    bundles = warc.write_bundles(pages(spark, rows).coalesce(1))
    frames = 0
    for b in bundles.collect():
        data = bytes(b.data)
        starts = warc.frames_of(data)
        frames += len(starts)
        whole = b"".join(zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() for _ in (0,))
        assert whole.count(b"WARC/1.1\r\n") == len(b.records)
        for r in b.records:
            at, size = starts[r.frame]
            frame = zstandard.ZstdDecompressor().decompress(data[at : at + size])
            _, fields, _ = next(warc.parsed(frame[r.offset : r.offset + r.length]))
            assert fields["WARC-Record-ID"] == f"<{r.record_id}>" and fields["X-Page"] == str(r.page_id)
    assert frames > 2
    ids = bundles.select(F.explode("records.record_id").alias("record_id"))
    some = ids.where(F.crc32("record_id") % 7 == 0)
    found = warc.fetch(bundles, some)
    assert {r.record_id for r in found.collect()} == {r.record_id for r in some.collect()}
    assert all(bytes(r.payload).decode() == rows[r.page_id][2] for r in found.collect())


def test_empty_and_null_pages(spark):
    table = pages(spark, ROWS)
    assert warc.read_bundles(warc.write_bundles(table.limit(0))).count() == 0
    nulls = table.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema))
    assert {(r.page_id, r.record_type, bytes(r.payload)) for r in warc.read_bundles(warc.write_bundles(nulls)).collect()} == {(None, "response", b"")}


def test_op4_counts(spark, sf):
    rows = QUERIES["op4_warc"](spark, sf).collect()
    html = {r.page_id: r.html or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(html)
    first = {}
    for k in sorted(html):
        first.setdefault(html[k], k)
    for r in rows:
        size = len(html[r.page_id].encode())
        again = size >= 100 and first[html[r.page_id]] != r.page_id
        assert (r.payload_bytes, r.record_type, r.refers_to) == (size, "revisit" if again else "response", first[html[r.page_id]] if again else None)
        assert r.payload_digest == hashlib.sha256(html[r.page_id].encode()).hexdigest()
