"""Alignment of two tokenizers: fragments of byte ranges compose to the groups of whole documents."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonecast.llm.common import slices, stored, table, texts_of
from zonecast.llm.packing import byte_letters, byte_vocabulary, encoding

#: Bytes of a range; longer documents are dealt out by ranges.
RANGE = 1 << 16
#: How far on either side of a range's border a place may lie where no token of either side crosses.
SLACK = 1 << 12
#: Fragments that one step of the tree composes.
FAN = 8
#: Bytes of text that a worker holds the tokens of at once.
BATCH = 1_000_000
#: Commonest id pairs that every task is sent; the others are joined.
KNOWN = 1 << 20

#: Fixed: white space beyond ASCII, in UTF-8.
_WIDE = (rb"\xc2[\x85\xa0]", rb"\xe1\x9a\x80", rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]", rb"\xe2\x81\x9f", rb"\xe3\x80\x80")
#: A single blank between other characters: both vocabularies start a token there.
_SAFE = re.compile(
    rb"(?<=[^\x00-\x20])" + b"".join(b"(?<!%s)" % w for w in _WIDE) + rb"\x20(?=[^\x00-\x20])(?!" + b"|".join(_WIDE) + b")"
)


@dataclass
class Fragment:
    """What a byte range holds: tokens up to its first common end, groups that are closed, tokens after its last one.

    Without a common end (``cut`` is false) all tokens are ``head``. The id pairs of all common ends are ``links``.
    Composition is associative; the empty fragment changes nothing.
    """

    cut: bool = False
    head: tuple[bytes, bytes] = (b"", b"")
    body: str = ""
    groups: int = 0
    tail: tuple[bytes, bytes] = (b"", b"")
    links: bytes = b""
    right: bool = True
    tokens: tuple[int, int] = (0, 0)

    def __add__(self, other: Fragment) -> Fragment:
        join = lambda x, y: (x[0] + y[0], x[1] + y[1])
        both = replace(
            self,
            links=self.links + other.links,
            right=self.right and other.right,
            tokens=(self.tokens[0] + other.tokens[0], self.tokens[1] + other.tokens[1]),
        )
        if not other.cut:
            return replace(both, tail=join(self.tail, other.head)) if self.cut else replace(both, head=join(self.head, other.head))
        if not self.cut:
            return replace(both, cut=True, head=join(self.head, other.head), body=other.body, groups=other.groups, tail=other.tail)
        middle = group_text(join(self.tail, other.head))
        return replace(both, body=self.body + middle + other.body, groups=self.groups + 1 + other.groups, tail=other.tail)


def ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i4")


def group_text(sides: tuple[bytes, bytes]) -> str:
    return "|".join(",".join(map(str, ints(side).tolist())) for side in sides) + ";"


@dataclass
class Pair:
    """Both encoders, the bytes of their tokens, and the texts of their ids followed by each separator."""

    a: tiktoken.Encoding
    b: sentencepiece.SentencePieceProcessor
    bytes_a: list[bytes]
    bytes_b: list[bytes]
    texts: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for piece in (self.b.id_to_piece(i) for i in range(len(self.bytes_b))):
            if "▁" in piece.lstrip("▁"):
                raise ValueError("pieces of this vocabulary cross blanks")
        n = max(len(self.bytes_a), len(self.bytes_b))
        self.texts = {s: np.array([f"{i}{s}" for i in range(n)], object) for s in ",|;"}
        self.sizes = np.array([*map(len, self.bytes_a)]), np.array([*map(len, self.bytes_b)])


@lru_cache(2)
def loaded(byte_file: str, piece_file: str) -> Pair:
    a = encoding(byte_file)
    with open(byte_file, encoding="utf-8") as file:
        vocab = json.load(file)["model"]["vocab"]
    letters, of_a = byte_letters(), [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        of_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
    of_b = [
        bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        for i in range(b.get_piece_size())
    ]
    return Pair(a, b, of_a, of_b)


def ranges(data: bytes, size: int = RANGE, slack: int = SLACK) -> list[tuple[int, int, int, int]]:
    """(low, high, start, end) of each byte range and of what has to be encoded for its tokens.

    Borders stand at multiples of ``size``, but for those without a safe place on both sides within ``slack``.
    """
    borders = [(0, 0, 0)]
    for at in range(size, len(data), size):
        before = [m.start() for m in _SAFE.finditer(data, max(borders[-1][0], at - slack), at)]
        after = _SAFE.search(data, at, at + slack)
        if before and after:
            borders.append((at, before[-1], after.start()))
    borders.append((len(data), len(data), len(data)))
    return [(x[0], y[0], x[1], y[2]) for x, y in zip(borders, borders[1:])]


def fragment(ids_a: np.ndarray, ends_a: np.ndarray, ids_b: np.ndarray, ends_b: np.ndarray, pair: Pair) -> Fragment:
    """The fragment of the tokens that end in a byte range."""
    data = lambda x, y: (x.astype("<i4").tobytes(), y.astype("<i4").tobytes())
    tokens = (len(ids_a), len(ids_b))
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    if not len(common):
        return Fragment(head=data(ids_a, ids_b), tokens=tokens)
    last_a, last_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
    links = ids_a[last_a].astype(np.int64) * len(pair.bytes_b) + ids_b[last_b]
    head = data(ids_a[: last_a[0] + 1], ids_b[: last_b[0] + 1])
    tail = data(ids_a[last_a[-1] + 1 :], ids_b[last_b[-1] + 1 :])
    # tokens of closed groups, each side's own place moved by what the other side has before it
    a, b = ids_a[last_a[0] + 1 : last_a[-1] + 1], ids_b[last_b[0] + 1 : last_b[-1] + 1]
    sizes_a, sizes_b = np.diff(last_a), np.diff(last_b)
    before_b = np.cumsum(sizes_b) - sizes_b
    out = np.empty(len(a) + len(b), object)
    place_a = np.arange(len(a)) + np.repeat(before_b, sizes_a)
    place_b = np.arange(len(b)) + np.repeat(np.cumsum(sizes_a), sizes_b)
    out[place_a], out[place_b] = pair.texts[","][a], pair.texts[","][b]
    ends = np.cumsum(sizes_a) - 1, np.cumsum(sizes_b) - 1
    out[place_a[ends[0]]], out[place_b[ends[1]]] = pair.texts["|"][a[ends[0]]], pair.texts[";"][b[ends[1]]]
    return Fragment(True, head, "".join(out.tolist()), len(sizes_a), tail, links.tobytes(), True, tokens)


def fragments(pieces: list[bytes], bounds: list[tuple[int, int]], pair: Pair) -> list[Fragment]:
    """A fragment for each piece of text (from a blank on) and the byte range inside it that counts."""
    out = []
    for data, (low, high) in zip(pieces, bounds):
        if len(data) < 2:
            out.append(Fragment(right=False))
            continue
        text = data.decode()
        ids = pair.a.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int64), np.array(pair.b.encode(text[1:]), np.int64)
        if any(b"".join(map(names.__getitem__, x.tolist())) != data for names, x in zip((pair.bytes_a, pair.bytes_b), ids)):
            out.append(Fragment(right=False))
            continue
        sides = []
        for x, sizes in zip(ids, pair.sizes):
            ends = np.cumsum(sizes[x])
            inside = slice(*np.searchsorted(ends, [low, high], "right"))
            sides += [x[inside], ends[inside]]
        out.append(fragment(*sides, pair))
    return out


PARTS = (
    "cut boolean, head_a binary, head_b binary, body string, groups long, tail_a binary, tail_b binary, links binary, right boolean, n_a long, n_b long"
)
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups string, pairs binary, times binary"


def columns_of(parts: list[Fragment]) -> list[pa.Array]:
    return [
        pa.array([p.cut for p in parts], pa.bool_()),
        *(pa.array([p.head[s] for p in parts], pa.binary()) for s in (0, 1)),
        pa.array([p.body for p in parts], pa.string()),
        pa.array([p.groups for p in parts], pa.int64()),
        *(pa.array([p.tail[s] for p in parts], pa.binary()) for s in (0, 1)),
        pa.array([p.links for p in parts], pa.binary()),
        pa.array([p.right for p in parts], pa.bool_()),
        *(pa.array([p.tokens[s] for p in parts], pa.int64()) for s in (0, 1)),
    ]


def of_row(p: dict) -> Fragment:
    sides = (p["head_a"], p["head_b"]), (p["tail_a"], p["tail_b"])
    return Fragment(p["cut"], sides[0], p["body"], p["groups"], sides[1], p["links"], p["right"], (p["n_a"], p["n_b"]))


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def finished(keys: pa.Array, parts: list[Fragment]) -> pa.RecordBatch:
    """Rows of ``ALIGNED``; what is not right has no tokens."""
    parts = [p if p.right and p.cut else Fragment() for p in parts]
    counted = [np.unique(np.frombuffer(p.links, "<i8"), return_counts=True) for p in parts]
    return pa.RecordBatch.from_arrays(
        [
            keys,
            *(pa.array([p.tokens[s] for p in parts], pa.int64()) for s in (0, 1)),
            pa.array([p.groups + p.cut for p in parts], pa.int64()),
            pa.array([(group_text(p.head) + p.body)[:-1] if p.cut else "" for p in parts], pa.string()),
            pa.array([x.astype("<i8").tobytes() for x, _ in counted], pa.binary()),
            pa.array([n.astype("<i4").tobytes() for _, n in counted], pa.binary()),
        ],
        names(ALIGNED),
    )


def align(docs: DataFrame, byte_file: str, piece_file: str, size: int = RANGE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, pairs, times): tokens of both sides cut at the byte offsets where both end.

    ``byte_file`` is a tokenizers file with byte-level ids (A), ``piece_file`` a sentencepiece model with byte fallback (B); every
    worker can open them. A encodes a blank and the text, B the text; special tokens in a text are plain text.
    ``groups`` is ``a1,a2|b1;a3|b2,b3`` in ids, ``pairs`` the distinct pairs of ids that end together (a * size of B + b),
    ``times`` how often each does, little-endian with 64 and 32 bits.

    Null and empty texts, and texts that the tokens of a side do not give back, have no tokens: zeros and empty values. Repeated rows
    and null ids give a row each, an empty table none; other columns are ignored. Documents up to ``size`` bytes are
    one fragment and never move. Longer ones are cut into byte ranges, which are dealt to tasks; a token belongs to the range it ends in. Their
    fragments are composed in a tree, ``FAN`` at a time, so that a task holds some ranges, and the last one a
    document's groups. Store what is read more than once.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    is_long = F.octet_length("text") > size

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(byte_file, piece_file)
        for batch in slices(batches, "text", BATCH):
            pieces = [b" " + t.encode() for t in texts_of(batch)]
            yield finished(batch.column("doc_id"), fragments(pieces, [(0, len(p)) for p in pieces], pair))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for row, doc, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), texts_of(batch)):
                data = b" " + text.encode()
                for k, (low, high, start, end) in enumerate(ranges(data, size, min(size, SLACK))):
                    made = {"row": row, "doc_id": doc, "k": k, "low": low - start, "high": high - start, "piece": data[start:end]}
                    yield pa.RecordBatch.from_pylist([made], schema=cut_schema)

    cut_schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("piece", pa.binary())]
    )

    def of_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(byte_file, piece_file)
        for batch in slices(batches, "piece", BATCH):
            bounds = [*zip(batch.column("low").to_pylist(), batch.column("high").to_pylist())]
            parts = fragments(batch.column("piece").to_pylist(), bounds, pair)
            keys = [batch.column(c) for c in ("row", "doc_id", "k")]
            yield pa.RecordBatch.from_arrays(keys + columns_of(parts), ["row", "doc_id", "k", *names(PARTS)])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                parts = [*map(of_row, one.column("parts").to_pylist()[0])]
                keys = [one.column(c) for c in ("row", "doc_id", "k")]
                yield pa.RecordBatch.from_arrays(keys + columns_of([reduce(Fragment.__add__, parts)]), ["row", "doc_id", "k", *names(PARTS)])

    def of_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                yield finished(pa.array([p["doc_id"]], pa.int64()), [of_row(p)])

    short = picked.filter(~is_long).mapInArrow(whole, ALIGNED)
    schema = f"row long, doc_id long, k long, {PARTS}"
    cuts = picked.filter(is_long).withColumn("row", F.monotonically_increasing_id())
    dealt = cuts.mapInArrow(cut, "row long, doc_id long, k long, low long, high long, piece binary").repartition(
        int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    )
    parts = stored(dealt.mapInArrow(of_ranges, schema))
    most = parts.agg(F.max("k")).first()[0] or 0
    while most:
        gathered = parts.groupBy("row", F.floor(F.col("k") / FAN).alias("k")).agg(
            F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", *names(PARTS)))).alias("parts")
        )
        parts, most = gathered.select("row", "doc_id", "k", "parts").mapInArrow(composed, schema), most // FAN
    return short.unionByName(parts.mapInArrow(of_whole, ALIGNED))


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): links of each id pair over all documents, and whether no pair with the same B id has more. Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "pairs"):
            pairs = np.frombuffer(b"".join(batch.column("pairs").to_pylist()), "<i8")
            times = ints(b"".join(batch.column("times").to_pylist()))
            keys, at = np.unique(pairs, return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, at, times)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sums)], ["pair", "n"])

    counted = aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # a B id has as many pairs as A has ids at most
    top = F.max("n").over(W.partitionBy(F.col("pair") % size_b))
    return stored(counted.select("pair", "n", (F.col("n") == top).alias("best")))


def link_scores(aligned: DataFrame, counts: DataFrame, known: int = KNOWN) -> DataFrame:
    """``aligned`` without pairs and times, with n_links, n_best (links of a best pair) and count_sum (over links).

    The ``known`` commonest pairs are sent to all tasks; links of other pairs, where there are any, are joined with their counts.
    """
    spark = aligned.sparkSession
    common = counts.orderBy(F.desc("n"), "pair").limit(known).toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast(tuple(common.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")))
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.select(*kept).schema)
    schema = f"row long, {types}, n_links long, n_best long, count_sum long, pairs binary, times binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = sent.value
        for batch in slices(batches, "pairs"):
            links, bests, sums, rest_pairs, rest_times = [], [], [], [], []
            for p, t in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
                p, t = np.frombuffer(p, "<i8"), ints(t)
                at = np.minimum(np.searchsorted(keys, p), len(keys) - 1) if len(keys) else np.zeros(len(p), int)
                hit = keys[at] == p if len(keys) else np.zeros(len(p), bool)
                links.append(int(t.sum()))
                bests.append(int((t[hit] * best[at[hit]]).sum()))
                sums.append(int((t[hit] * n[at[hit]]).sum()))
                rest_pairs.append(p[~hit].tobytes())
                rest_times.append(t[~hit].tobytes())
            made = [pa.array(x, pa.int64()) for x in (links, bests, sums)] + [pa.array(x, pa.binary()) for x in (rest_pairs, rest_times)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", *kept)] + made, names(schema))

    scored = aligned.withColumn("row", F.monotonically_increasing_id()).select("row", *kept, "pairs", "times").mapInArrow(run, schema)
    out = [*kept, "n_links", "n_best", "count_sum"]
    if counts.count() <= known:
        return scored.select(*out)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, p, t in zip(*(batch.column(c).to_pylist() for c in ("row", "pairs", "times"))):
                p = np.frombuffer(p, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), row)), pa.array(p), pa.array(ints(t), pa.int64())], ["row", "pair", "times"])

    scored = stored(scored)
    rest = scored.select("row", "pairs", "times").filter(F.octet_length("pairs") > 0).mapInArrow(listed, "row long, pair long, times long")
    more = (
        rest.join(counts, "pair")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    )
    add = lambda c, m: (F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c)
    return scored.join(more, "row", "left").select(*kept, "n_links", add("n_best", "more_best"), add("count_sum", "more_sum"))


def piece_model() -> str:
    """Path of the sentencepiece model that documents are aligned with."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = piece_model()
    groups = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    aligned = align(table(spark, sf_dir, "documents"), byte_vocabulary(), pieces)
    aligned = stored(aligned.withColumn("groups_sha256", groups).drop("groups"))
    size_b = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    return link_scores(aligned, pair_counts(aligned, size_b))
