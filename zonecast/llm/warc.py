"""WARC archives as seekable Zstandard bundles.

A bundle is a series of independent frames of some records each, closed by a seek table in a skippable frame: any
Zstandard tool can unpack it whole, and a reader that knows a record's frame and its offset there unpacks one frame.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.llm.common import slices, stored, table

#: Bytes of records in a frame before it is closed, and of compressed frames in a bundle.
FRAME, BUNDLE = 256 << 10, 8 << 20
#: Payloads of at least this size are written once.
LEAST = 100
#: Fixed: numbers of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_NAMES = uuid.UUID("8a7b1f3e-0c52-4a0e-9d7c-2f1f6e0b5a11")

BUNDLES = "bundle string, data binary, records array<struct<record_id:string,page_id:long,frame:int,offset:long,length:long>>"


def record_id(page_id: int | None, digest: str) -> str:
    """Rows that repeat a page and its payload share an identifier."""
    return f"urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}:{digest}')}"


def one_line(value: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> tuple[str, bytes]:
    """Identifier and bytes of a record. A revisit holds no payload; extension fields give its full size and the pages."""
    name = record_id(page_id, digest)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head.append(f"Content-Length: {len(body)}")
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries)) + entries


def frames_of(bundle: bytes) -> list[tuple[int, int]]:
    """Start and size of every frame, from the seek table at the end."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("the bundle has no seek table")
    width = 12 if flags & 0x80 else 8
    table_at = len(bundle) - 9 - count * width
    out, at = [], 0
    for k in range(count):
        size, _ = struct.unpack_from("<II", bundle, table_at + k * width)
        out.append((at, size))
        at += size
    return out


def parsed(data: bytes, offset: int = 0) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, fields and payload of the records in an unpacked frame from ``offset`` on."""
    while offset < len(data):
        end = data.index(b"\r\n\r\n", offset)
        lines = data[offset:end].decode().split("\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(fields["Content-Length"])
        body = data[end + 4 : end + 4 + size]
        yield offset, fields | {"full": str(_http_length(body))}, body[body.index(b"\r\n\r\n") + 4 :]
        offset = end + 4 + size + 4


def _http_length(body: bytes) -> int:
    head = body[: body.index(b"\r\n\r\n")].decode()
    return int(re.search(r"Content-Length: (\d+)", head)[1])


def first_pages(pages: DataFrame) -> DataFrame:
    """(digest, first): the smallest page of every payload that several pages share. Pre-aggregated before its shuffle."""
    large = pages.where(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return stored(large.where("n > 1 AND first IS NOT NULL").select("digest", "first"))


def write_bundles(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Bundles of (page_id, url, html), with an index of their records; stored in the shared folder.

    A row's payload is its html in UTF-8, null as empty. Of pages with equal payloads of ``LEAST`` bytes and more, the
    smallest page_id is the response; others, a null id among them, revisit it; rows that repeat the smallest
    id are responses all; where all ids are null, so are they. Smaller payloads are all responses. A null url
    is an empty target. An empty table gives no bundle; other columns are ignored. Bundles are rows of a Parquet table that
    Spark commits, so a lost or repeated task leaves no half bundle.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit("")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    marked = rows.join(first_pages(rows), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = marked.select("page_id", "url", "payload", "digest", "first", revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        pack = zstandard.ZstdCompressor(level=3)
        number, size, frame, frame_size = 0, 0, [], 0
        blobs: list[bytes] = []
        table_: list[tuple[int, int]] = []
        index: list[tuple] = []

        def close_frame() -> None:
            nonlocal frame, frame_size, size
            if frame:
                blob = pack.compress(b"".join(frame))
                blobs.append(blob)
                table_.append((len(blob), frame_size))
                size += len(blob)
                frame, frame_size = [], 0

        def close_bundle() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            close_frame()
            if blobs:
                names = ("record_id", "page_id", "frame", "offset", "length")
                kinds = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())))))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"part-{part:06d}-{number:06d}.warc.zst"]),
                        pa.array([b"".join(blobs) + seek_table(table_)], pa.binary()),
                        pa.array([[dict(zip(names, x)) for x in index]], kinds),
                    ],
                    ["bundle", "data", "records"],
                )
                number, size = number + 1, 0
                blobs.clear(), table_.clear(), index.clear()

        for batch in slices(batches, "payload"):
            for page_id, target, payload, digest, first, again in zip(*(c.to_pylist() for c in batch.columns)):
                name, data = record(page_id, target, payload, digest, first, again, date)
                index.append((name, page_id, len(blobs), frame_size, len(data)))
                frame.append(data)
                frame_size += len(data)
                if frame_size >= FRAME:
                    close_frame()
                    if size >= BUNDLE:
                        yield from close_bundle()
        yield from close_bundle()

    return stored(marked.mapInArrow(run, BUNDLES))


RECORDS = "bundle string, frame int, offset long, record_id string, record_type string, page_id long, url string, digest string, refers_to long, full_bytes long, payload binary"


def _row(fields: dict[str, str], payload: bytes) -> tuple:
    page, back = fields.get("X-Page"), fields.get("X-Refers-To-Page")
    return (
        fields["WARC-Record-ID"][1:-1],
        fields["WARC-Type"],
        int(page) if page else None,
        fields["WARC-Target-URI"],
        fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        int(back) if back else None,
        int(fields["full"]),
        payload,
    )


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in RECORDS.split(", ")])


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles; a revisit has an empty payload and the size of the full one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, data in zip(*(batch.column(c).to_pylist() for c in ("bundle", "data"))):
                for k, (at, size) in enumerate(frames_of(data)):
                    frame = unpack.decompress(data[at : at + size])
                    yield _records([(name, k, offset, *_row(f, p)) for offset, f, p in parsed(frame)])

    return bundles.select("bundle", "data").mapInArrow(run, RECORDS)


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records whose identifiers are in ``wanted`` (record_id), each read by its frame and offset alone."""
    places = bundles.select("bundle", F.explode("records").alias("r")).select("bundle", "r.record_id", "r.frame", "r.offset")
    places = places.join(wanted.select("record_id").distinct(), "record_id").select("bundle", F.struct("frame", "offset").alias("place"))
    here = places.groupBy("bundle").agg(F.sort_array(F.collect_list("place")).alias("places"))  # at most a bundle's records

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, data, found in zip(*(batch.column(c).to_pylist() for c in ("bundle", "data", "places"))):
                starts, opened = frames_of(data), {}
                for place in found:
                    k = place["frame"]
                    if k not in opened:
                        opened = {k: unpack.decompress(data[starts[k][0] : sum(starts[k])])}
                    offset, fields, payload = next(parsed(opened[k], place["offset"]))
                    yield _records([(name, k, offset, *_row(fields, payload))])

    return bundles.select("bundle", "data").join(here, "bundle").mapInArrow(run, RECORDS)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_bundles(write_bundles(table(spark, sf_dir, "pages")))
    whole = F.col("record_type") == "response"
    return back.select(
        "page_id",
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("full_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


OP4_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
