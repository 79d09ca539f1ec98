"""Archives of any size, read in byte ranges: one JSON object ``{"alerts": {id: record}}`` by many tasks.

The text source cuts a file at closing braces and deals byte ranges of it to tasks, in any store that Spark reads. Whether a
range starts inside a text, how deep it stands and in which section depends on all that comes before it. So a first pass
notes what each range does to that state for both cases, inside a text or not; these notes are composed in order; a
second pass cuts the ranges into records. Ranges start right after a brace, so no escape is pending at a border.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonecast.session import materialize
from zonecast.sources.archive import _struct, _typed

#: A text, possibly without its end, or a brace.
_TOKEN = re.compile(rb'"(?:[^"\\]++|\\.)*+("|\Z|\\\Z)|[{}]', re.S)
_TEXT_END = re.compile(rb'(?:[^"\\]++|\\.)*+("|\Z|\\\Z)', re.S)
_KEY = re.compile(rb'"((?:[^"\\]++|\\.)*+)"\s*:\s*\Z', re.S)
#: Records stand this deep, below the section's own brace.
DEPTH = 2


class Cursor:
    """State after some pieces: inside a text, depth, and the last key that opened an object at each depth."""

    def __init__(self, inside: bool, depth: int = 0, section: bytes | None = None) -> None:
        self.inside, self.depth, self.keys = inside, depth, {} if section is None else {1: section}
        self.opened = 0

    def pass_over(self, piece: bytes) -> None:
        """Advance over a piece; ``opened`` is where the last object at depth 1 starts its content, else 0."""
        at, self.opened = 0, 0
        if self.inside:
            end = _TEXT_END.match(piece)
            at, self.inside = end.end(), end[1] != b'"'
        if self.inside:
            return
        for token in _TOKEN.finditer(piece, at):
            if token[0] == b"{":
                key = _KEY.search(piece, max(0, token.start() - 300), token.start())
                self.keys[self.depth] = key[1] if key else b""
                self.depth += 1
                if self.depth == DEPTH:
                    self.opened = token.end()
            elif token[0] == b"}":
                self.depth -= 1
            else:
                self.inside = token[1] != b'"'


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "}").text(path).select(
        meta["file_path"].alias("file"), meta["file_size"].alias("size"), meta["file_block_start"].alias("start"), F.col("value").cast("binary").alias("data")
    )


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("file", "start", "size", "data")))


NOTE = "file string, start long, size long, bytes long, inside boolean, ends_inside boolean, depth int, keys map<int,binary>"


def _note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each range does to the state, from outside of a text and, but for a file's first range, from inside one."""
    schema = pa.schema(
        [
            ("file", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()), ("inside", pa.bool_()),
            ("ends_inside", pa.bool_()), ("depth", pa.int32()), ("keys", pa.map_(pa.int32(), pa.binary())),
        ]
    )

    def rows(now: tuple, total: int, both: list[Cursor]) -> pa.RecordBatch:
        made = [
            {"file": now[0], "start": now[1], "size": now[2], "bytes": total, "inside": i == 1, "ends_inside": c.inside, "depth": c.depth, "keys": list(c.keys.items())}
            for i, c in enumerate(both)
        ]
        return pa.RecordBatch.from_pylist(made, schema=schema)

    now, total, both = None, 0, []
    for file, start, size, data in _by_range(batches):
        if now != (file, start, size):
            if now:
                yield rows(now, total, both)
            now, total, both = (file, start, size), 0, [Cursor(False), Cursor(True)] if start else [Cursor(False)]
        total += len(data) + 1
        for cursor in both:
            cursor.pass_over(data + b"}")
    if now:
        yield rows(now, total, both)


def _entries(notes: DataFrame) -> dict[tuple[str, int], tuple[bool, int, bytes | None, bool]]:
    """State at the start of each range, and whether its last piece is the unclosed end of the file.

    Some hundred bytes for each range of ``spark.sql.files.maxPartitionBytes``; composed in order of the ranges.
    """
    found: dict[str, dict[int, dict[bool, tuple]]] = {}
    sizes: dict[str, list[int]] = {}
    for r in notes.collect():
        found.setdefault(r["file"], {}).setdefault(r["start"], {})[r["inside"]] = (r["ends_inside"], r["depth"], r["keys"])
        if not r["inside"]:
            sizes.setdefault(r["file"], [r["size"], 0])[1] += r["bytes"]
    out = {}
    for file, parts in found.items():
        inside, depth, section = False, 0, None
        open_end = sizes[file][1] > sizes[file][0]
        for start in sorted(parts):
            out[file, start] = (inside, depth, section, open_end and start == max(parts))
            ends, moved, keys = parts[start][inside]
            section = keys.get(1 - depth, section)
            inside, depth = ends, depth + moved
    return out


PART = "file string, start long, kind string, data binary"


def archive_segments(spark: SparkSession, path: str, section: str = "alerts") -> DataFrame:
    """(file, data, whole): the text of each entry of the section, ending with its object; entries that a file breaks off are not ``whole``.

    Files are read in ranges of ``spark.sql.files.maxPartitionBytes``; only entries that cross a border are shuffled.
    Braces, quotes and escapes inside texts belong to the texts. Files that are not such an object give what can be cut.
    """
    pieces = _pieces(spark, path)
    entries = spark.sparkContext.broadcast(_entries(materialize(pieces.mapInArrow(_note, NOTE))))
    wanted = section.encode()
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.string()), ("data", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        now, held, cursor, last, taken, seen = None, None, None, False, [], False

        def add(kind: str, data: bytes) -> None:
            out.append({"file": now[0], "start": now[1], "kind": kind, "data": data})

        def feed(piece: bytes, closed: bool = True) -> None:
            nonlocal seen, taken
            within = cursor.depth >= DEPTH and cursor.keys.get(1) == wanted
            cursor.pass_over(piece)
            if cursor.opened and cursor.keys.get(1) == wanted:
                taken, piece, within, seen = [], piece[cursor.opened :], True, True
            if not within:
                return
            taken.append(piece)
            if cursor.inside or cursor.depth > DEPTH or not closed:
                return
            if cursor.depth == DEPTH:
                add("whole" if seen else "head", b"".join(taken))
            taken, seen = [], True

        def finish() -> None:
            if now and held is not None:
                feed(held if last else held + b"}", not last)
            if now and any(taken):
                add("tail" if seen else "middle", b"".join(taken))

        for file, start, _, data in _by_range(batches):
            if now != (file, start):
                finish()
                now, held = (file, start), None
                inside, depth, key, last = entries.value[now]
                cursor, taken = Cursor(inside, depth, key), []
                seen = not (inside or depth > DEPTH)
            if held is not None:
                feed(held + b"}")
            held = data
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        finish()
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    parts = materialize(pieces.mapInArrow(cut, PART))
    # Two rows a range at most: a tail starts an entry, heads end it.
    order = W.partitionBy("file").orderBy("start", F.when(F.col("kind") == "tail", 1).otherwise(0))
    crossing = parts.filter("kind <> 'whole'").withColumn("_n", F.sum(F.when(F.col("kind") == "tail", 1).otherwise(0)).over(order))
    joined = crossing.groupBy("file", "_n").agg(
        F.array_sort(F.collect_list(F.struct("start", "data"))).alias("p"), F.max(F.col("kind") == "head").alias("whole")
    )
    data = F.aggregate("p", F.lit(b""), lambda acc, p: F.concat(acc, p["data"]))
    across = joined.select("file", data.alias("data"), "whole")
    return parts.filter("kind = 'whole'").select("file", "data", F.lit(True).alias("whole")).unionByName(across)


def read_report_ranges(spark: SparkSession, path: str) -> DataFrame:
    """The reports of :func:`zonecast.sources.archive.read_report_archive`, from files that many tasks share."""
    whole = archive_segments(spark, path).filter("whole").select(F.decode("data", "UTF-8").alias("t"))
    entry = F.from_json(F.concat(F.lit("{"), F.regexp_replace("t", r"^[\s,]+", ""), F.lit("}")), f"map<string,struct<{_struct()}>>")
    return whole.select(F.explode(entry).alias("k", "r")).select(*_typed(F.col("k"), F.col("r")))
