"""Near-duplicate documents: an inverted join on the coordinates of MinHash signatures, confirmed on full sets.

1. Documents with equal sets form a class; the smallest id stands for it.
2. A representative is posted under the coordinate-value pairs of the first ``PREFIX`` coordinates: two signatures
   that agree in ``LEAST`` coordinates of ``COORDINATES`` agree in one of those.
3. Postings are sorted by pair, then by the coordinates that follow, once forwards and once backwards; a posting is
   compared with the ``REACH`` before it. Pairs that agree in ``LEAST`` coordinates or more bind their documents
   into a cluster. Lists that are longer than that sees, or that are cut, are then compared pair by pair, but for
   pairs that are bound already.
4. Inside a cluster every pair is compared by signature, and by its full sets unless it is already connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from zonecast.llm.common import slices, stored, table, texts_of
from zonecast.llm.components import Forest, components

#: At a similarity of 0.8 a pair agrees in fewer than 16 of 32 coordinates about once in 50,000, at 0.85 once in millions.
COORDINATES, LEAST = 32, 16
PREFIX = COORDINATES - LEAST + 1
#: Postings before a posting that it is compared with. Nearly equal signatures stand side by side in most lists.
REACH = 8
#: Rows that one task compares with each other: on full sets, and by signature alone.
BLOCK, SIGNATURES = 256, 1024
#: Bytes of sets or signatures in one block of a large cluster.
BLOCK_BYTES = 32 << 20
#: Cells of a matrix that the sets of a block are written to.
CELLS = 1 << 22

_SEEDS = np.random.default_rng(7).integers(1, 2**63, (2, COORDINATES)).astype(np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles as 64-bit hashes.

    Words are runs of anything but the six ASCII spaces, A-Z in lower case. With fewer words than ``width``, all of
    them are one shingle; without words the set is empty.
    """
    lists = [t.encode().lower().split() for t in texts]
    sizes = [len(x) for x in lists]
    flat = np.fromiter(chain.from_iterable(lists), object, sum(sizes))
    codes, words = pd.factorize(flat)
    named = pd.util.hash_array(np.asarray(words, object), categorize=False)[codes] if len(words) else np.zeros(0, np.uint64)
    ends = np.cumsum(sizes)
    total = len(named)
    run = np.full(total, 0x5EED, np.uint64)
    for k in range(min(width, total)):
        run[: total - k] = mixed(run[: total - k] + named[k:])
    out = []
    for size, end in zip(sizes, ends):
        if size >= width:
            out.append(np.unique(run[end - size : end - width + 1]))
        elif size:
            one = np.full(1, size, np.uint64)
            for w in named[end - size : end]:
                one = mixed(one + w)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``COORDINATES`` minima for each set, none of which is empty."""
    if not sets:
        return np.zeros((0, COORDINATES), np.uint64)
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    columns = [np.minimum.reduceat((flat ^ a) * b >> np.uint64(32), starts) for a, b in _SEEDS.T]
    return np.stack(columns, axis=1)


SIGNED = "doc_id long, n_shingles long, set_key binary, sig binary, gis binary, pairs array<long>"


def signed(docs: DataFrame, width: int) -> DataFrame:
    """Set size, a fingerprint of the set, a byte of each coordinate, in order and reversed, and the hashed
    coordinate-value pairs to post under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(PREFIX, dtype=np.uint64) << np.uint64(40)
        for batch in slices(batches, "text"):
            sets = shingle_sets(texts_of(batch), width)
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = signatures([sets[i] for i in full])
            pairs = mixed(sig[:, :PREFIX] + place).view(np.int64)
            key: list[bytes | None] = [None] * len(sets)
            low: list[bytes | None] = [None] * len(sets)
            posts: list[list[int] | None] = [None] * len(sets)
            for row, i in enumerate(full):
                key[i] = fingerprint(sets[i])
                low[i] = (sig[row] & np.uint64(255)).astype(np.uint8).tobytes()
                posts[i] = pairs[row].tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(key, pa.binary()),
                    pa.array(low, pa.binary()),
                    pa.array([x and x[::-1] for x in low], pa.binary()),
                    pa.array(posts, pa.list_(pa.int64())),
                ],
                [c.split()[0] for c in SIGNED.split(", ")],
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, SIGNED)


def candidate_links(reps: DataFrame) -> DataFrame:
    """(a, b): links that connect all documents that share a posting and agree in ``LEAST`` coordinates.

    A list is cut wherever the sort by range cuts it, so a hot list is spread over tasks by what follows in the
    signature. A task emits a link only between documents that its earlier links have not connected. That is exact for
    whole lists of ``REACH`` + 1 postings; in all others, every pair not connected by then is compared, in blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keys = batch.column("pair").to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            # the first list of a task may have begun in the one before
            cut = keys[:1].tolist() if last is None else []
            # a list turns all its signatures alike, so that turned ones agree where the signatures do
            sig = np.frombuffer(b"".join(batch.column("turn").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            if last is not None:
                keys, ids, sig = np.concatenate([last[0], keys]), np.concatenate([last[1], ids]), np.concatenate([last[2], sig])
            joined, links = Forest(), []
            for back in range(1, min(REACH, len(keys) - 1) + 1):
                same = np.flatnonzero((keys[back:] == keys[:-back]) & (ids[back:] != ids[:-back]))
                near = same[(sig[same + back] == sig[same]).sum(axis=1) >= LEAST]
                pairs = np.unique(np.stack([np.minimum(ids[near], ids[near + back]), np.maximum(ids[near], ids[near + back])], axis=1), axis=0)
                links += [(a, b) for a, b in pairs.tolist() if joined.join(a, b)]
            last = keys[-REACH:], ids[-REACH:], sig[-REACH:]
            none = [None] * len(links)
            columns = [x[0] for x in links] + [None] * len(cut), [x[1] for x in links] + [None] * len(cut), none + cut
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "cut"])

    posts = reps.select("doc_id", "sig", "gis", F.posexplode("pairs").alias("at", "pair"))
    turned = lambda c, at: F.expr(f"concat(substring({c}, {at} + 2), substring({c}, 1, {at} + 1))")
    ways = F.array(
        F.struct("pair", turned("sig", "at").alias("turn")),
        F.struct(F.bitwise_not("pair").alias("pair"), turned("gis", f"({COORDINATES - 1} - at)").alias("turn")),
    )
    both = posts.select("doc_id", F.explode(ways).alias("p")).select("p.pair", "p.turn", "doc_id")
    spread = both.repartitionByRange("pair", "turn", "doc_id").sortWithinPartitions("pair", "turn", "doc_id")
    found = stored(spread.mapInArrow(run, "a long, b long, cut long"))
    near = found.where("cut IS NULL").select("a", "b").distinct()
    long = posts.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > REACH + 1).select("pair")
    cut = found.where("cut IS NOT NULL").select(F.explode(F.array("cut", F.bitwise_not("cut"))).alias("pair"))
    lists = stored(long.union(cut).distinct())
    rest = posts.join(lists, "pair").join(components(near), F.col("doc_id") == F.col("node"), "left")
    rest = stored(rest.select(F.col("pair").alias("cluster"), F.col("doc_id").alias("node"), F.coalesce("component", "doc_id").alias("part"), "sig"))
    members = rest.select("cluster", "part", F.lit(COORDINATES).alias("bytes"))
    return near.union(agreeing_links(dealt(rest, members, SIGNATURES))).distinct()


def dealt(rows: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """Rows of (cluster, node, part and others) in every pair of blocks (left, right) of a cluster that they belong to.

    The part of most ``members`` (cluster, part, bytes) is a cluster's core. Every other row is ``wanted``: it meets the
    whole cluster, core rows meet only those. Clusters of one part are left out. Blocks grow with the square root of what
    they divide, from ``block`` rows on and up to ``BLOCK_BYTES``, so that neither a row's copies nor a task's rows grow in
    proportion to the cluster.
    """
    count = members.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    core = count.groupBy("cluster").agg(
        F.max(F.struct("n", F.col("part").alias("core"), "bytes")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")
    )
    rest = lambda c: (F.col(c) - F.col(f"top.{c}")).alias(f"{c}_outside")
    core = core.select("cluster", "top.core", *[F.col(f"top.{c}").alias(f"{c}_inside") for c in ("n", "bytes")], rest("n"), rest("bytes"))
    core = stored(core.where("n_outside > 0"))
    wanted = F.col("part") != F.col("core")
    number = lambda side: F.ceil(F.greatest(F.sqrt(F.col(f"n_{side}") / block), F.col(f"bytes_{side}") / BLOCK_BYTES, F.lit(1.0))).cast("int")
    nin, nout = number("inside"), number("outside")
    own = F.pmod(F.xxhash64("node", F.lit(2)), F.when(wanted, nout).otherwise(nin)).cast("int")
    # block pairs: (block outside, block outside), and (block outside, -1 - block of the core)
    pair = lambda a, b: F.struct(a.cast("int").alias("left"), b.cast("int").alias("right"))
    with_out = F.transform(F.sequence(F.lit(0), nout - 1), lambda o: pair(F.least(own, o), F.greatest(own, o)))
    with_core = F.transform(F.sequence(F.lit(0), nin - 1), lambda c: pair(own, -1 - c))
    from_core = F.transform(F.sequence(F.lit(0), nout - 1), lambda o: pair(o, -1 - own))
    places = F.when(wanted, F.concat(with_out, with_core)).otherwise(from_core)
    spread = rows.join(core, "cluster").withColumn("wanted", wanted).withColumn("at", F.explode(places))
    return spread.select("cluster", "at.left", "at.right", *[c for c in rows.columns if c != "cluster"], "wanted")


def block_links(rows: DataFrame, names: tuple[str, ...], links: Callable[..., list[tuple[int, int]]]) -> DataFrame:
    """(a, b): what ``links`` makes of the lists of the columns ``names``, for each (cluster, left, right)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            out = links(*held.values())
            for v in held.values():
                v.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        held: dict[str, list] = {c: [] for c in names}
        now = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("cluster", "left", "right"))))
            columns = [batch.column(c).to_pylist() for c in names]
            for row, key in enumerate(keys):
                if key != now and held["node"]:
                    yield done()
                now = key
                for c, values in zip(names, columns):
                    held[c].append(values[row])
        if held["node"]:
            yield done()

    spread = rows.repartition("cluster", "left", "right").sortWithinPartitions("cluster", "left", "right")
    return spread.mapInArrow(run, "a long, b long")


def agreeing_links(rows: DataFrame) -> DataFrame:
    """(a, b): links that connect documents of one block pair whose signatures agree in ``LEAST`` coordinates.

    Rows with equal ``part`` are connected already. Pairs without a ``wanted`` row are not compared.
    """

    def links(ids: list, parts: list, wanted: list, sigs: list) -> list[tuple[int, int]]:
        forest, out = Forest(), []
        sig = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, COORDINATES)
        apart, asked, places = np.array(parts), np.array(wanted), np.arange(len(ids))
        for x in np.flatnonzero(asked).tolist():
            # a pair of wanted rows is compared once, and one link to a part is enough
            near = np.flatnonzero((apart != apart[x]) & (~asked | (places > x)))
            near = near[(sig[near] == sig[x]).sum(axis=1) >= LEAST]
            for y in near[np.unique(apart[near], return_index=True)[1]].tolist():
                if forest.join(parts[x], parts[y]):
                    out.append((ids[x], ids[y]))
        return out

    return block_links(rows, ("node", "part", "wanted", "sig"), links)


class Block:
    """Sets of a block, their hashes sorted together, so that one set meets all others at once."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.values = flat[order]
        self.owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
        self.size = np.array([len(s) for s in sets])

    def shared(self, own: np.ndarray) -> np.ndarray:
        """Size of the intersection of ``own`` with every set."""
        low, high = np.searchsorted(self.values, own, "left"), np.searchsorted(self.values, own, "right")
        count = high - low
        places = np.arange(count.sum()) + np.repeat(low - np.cumsum(count) + count, count)
        return np.bincount(self.owner[places], minlength=len(self.size))

    def intersections(self, rows: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
        """Sizes of the intersections of ``rows`` of the block with every other set.

        Values that several sets hold are columns of a matrix of zeros and ones, which is multiplied in strips; where
        sets have so little in common that the strips are nearly empty, each row is looked up instead.
        """
        code = np.cumsum(np.concatenate([[0], self.values[1:] != self.values[:-1]])) if len(self.values) else np.zeros(0, int)
        held = np.bincount(code) if len(code) else np.zeros(0, int)
        often = held > 1
        if len(self.size) ** 2 * often.sum() > 64 * (held[often].astype(float) ** 2).sum():
            return np.stack([self.shared(sets[x]) for x in rows])
        owner, column = self.owner[often[code]], (np.cumsum(often) - 1)[code[often[code]]]
        out = np.zeros((len(rows), len(self.size)), np.float32)
        width = max(min(CELLS // len(self.size), int(often.sum())), 1)
        for start in range(0, int(often.sum()), width):
            low, high = np.searchsorted(column, (start, start + width))
            strip = np.zeros((len(self.size), width), np.float32)
            strip[owner[low:high], column[low:high] - start] = 1
            out += strip[rows] @ strip.T
        return out.astype(np.int64)


def confirmed_links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect documents of one block pair, each confirmed on full sets.

    Rows with equal ``part`` are connected already. Pairs without a ``wanted`` row are not compared.
    """

    def links(ids: list, parts: list, wanted: list, held: list, sigs: list) -> list[tuple[int, int]]:
        forest, out = Forest(), []
        sets = [np.frombuffer(x, np.uint64) for x in held]
        sig = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, COORDINATES)
        block = Block(sets)
        apart, asked, places = np.array(parts), np.array(wanted), np.arange(len(ids))
        for some in np.array_split(np.flatnonzero(asked), range(BLOCK, int(asked.sum()), BLOCK)):
            # a pair of wanted rows is compared once
            agree = [((sig == sig[x]).sum(axis=1) >= LEAST) & (apart != apart[x]) & (~asked | (places > x)) for x in some]
            any_of = [bool(near.any()) for near in agree]
            some, agree = some[any_of], [near for near in agree if near.any()]
            if not agree:
                continue
            for x, near, shared in zip(some.tolist(), agree, block.intersections(some, sets)):
                found = np.flatnonzero(near & (100 * shared >= percent * (block.size[x] + block.size - shared)))
                # one link to a part is enough
                for y in found[np.unique(apart[found], return_index=True)[1]].tolist():
                    if forest.join(parts[x], parts[y]):
                        out.append((ids[x], ids[y]))
        return out

    return block_links(rows, ("node", "part", "wanted", "set", "sig"), links)


def fingerprint(held: np.ndarray) -> bytes | None:
    """Names a set; None for the empty one."""
    return hashlib.blake2b(held.tobytes(), digest_size=16).digest() if len(held) else None


def with_sets(texts: DataFrame, width: int) -> DataFrame:
    """Add the set and the signature's bytes to (cluster, node, text); drop the text, and rows whose set is not the node's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(texts_of(batch), width)
            batch = batch.filter(pa.array([len(s) > 0 for s in sets]))
            sets = [s for s in sets if len(s)]
            sig = (signatures(sets) & np.uint64(255)).astype(np.uint8)
            bytes_of = [pa.array([x.tobytes() for x in v], pa.binary()) for v in (sets, sig)]
            bytes_of.append(pa.array([fingerprint(x) for x in sets], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("node"), batch.column("size"), *bytes_of], ["cluster", "node", "size", "set", "sig", "set_key"])

    rows = texts.mapInArrow(run, "cluster long, node long, size long, set binary, sig binary, set_key binary")
    return rows.where(F.xxhash64("set_key") == F.col("node")).drop("set_key")


def cluster_links(docs: DataFrame, clusters: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) that connect what is connected in each cluster.

    ``clusters`` has (node, component, rep): the set's number, its cluster, the id of a document that has it.
    A cluster above ``BLOCK`` rows is dealt into blocks. First each block is compared within itself, together with a
    few rows of the cluster that all its blocks get. What that connects most widely is then the cluster's core: every
    other row is compared with the whole cluster, core rows among themselves no more.
    """
    sizes = stored(clusters.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    members = clusters.join(sizes, "component").select(F.col("component").alias("cluster"), "node", "rep", "size")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    ready = stored(with_sets(texts.join(members, "rep").select("cluster", "node", "size", "text"), width))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    central = F.pmod(F.xxhash64("node", F.lit(1)), F.greatest(F.col("size") / 8, F.lit(1)).cast("long")) == 0
    places = F.when((blocks > 1) & central, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(mine))
    shape = ("cluster", F.col("at").alias("left"), F.col("at").alias("right"), "node", F.col("node").alias("part"), F.lit(True).alias("wanted"), "set", "sig")
    first = stored(confirmed_links(ready.withColumn("at", F.explode(places)).select(*shape), percent))
    large = ready.where(blocks > 1)
    if large.isEmpty():
        return first
    parts = components(first)
    large = stored(
        large.groupBy("cluster", "node").agg(F.max(F.length("set")).alias("bytes")).join(parts, "node", "left").select(
            "cluster", "node", F.coalesce("component", "node").alias("part"), "bytes"
        )
    )
    second = confirmed_links(dealt(ready.join(large.drop("bytes"), ["cluster", "node"]), large, BLOCK), percent)
    return first.union(second)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Documents are linked where 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles; a
    component is what links connect, named by its smallest id; its document of that id is kept. ``percent`` must be 80
    or more, for which ``LEAST`` is chosen. Null and empty texts and texts without words have an empty set, are linked with
    nothing and kept. A null id stays apart: its component is null and it is kept. Rows that repeat an id and text get
    the same result each; rows that share an id with other texts are judged by their own text. An empty table gives no
    rows; other columns are ignored; whole texts are read.
    """
    rows = judged(docs, width, percent)
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def judged(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, component_id, first_key): a row's set, its component, the set that stands for that.

    Sets are linked, not ids: an id that has several sets stands in the component of each.
    """
    base = stored(signed(docs, width))
    used = F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()
    classes = base.where(used).groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes.withColumn("node", F.xxhash64("set_key")))
    reps = base.where(used).join(classes.select("set_key", "rep", "node"), "set_key").where("doc_id = rep").select(F.col("node").alias("doc_id"), "sig", "gis", "pairs")
    clusters = stored(components(candidate_links(stored(reps))).join(classes.select("node", "rep"), "node"))
    linked = stored(components(cluster_links(docs, clusters, width, percent)).join(classes.select("node", "rep", "set_key"), "node"))
    tops = stored(linked.groupBy("component").agg(F.min(F.struct("rep", "set_key")).alias("first")))
    named = linked.join(tops, "component").select("set_key", "first.rep", F.col("first.set_key").alias("first_key"))
    copied = classes.where("n > 1").join(linked.select("set_key"), "set_key", "left_anti").select("set_key", "rep", F.col("set_key").alias("first_key"))
    found = stored(named.union(copied))
    members = base.where(used).select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    members = members.select("doc_id", "n_shingles", "set_key", F.coalesce("rep", "doc_id").alias("component_id"), F.coalesce("first_key", "set_key").alias("first_key"))
    return members.union(base.where(~used).select("doc_id", "n_shingles", "set_key", F.col("doc_id").alias("component_id"), F.col("set_key").alias("first_key")))


def with_set_key(docs: DataFrame, width: int) -> DataFrame:
    """(row, id, text, set_key): all columns of a row as one, what it is judged by, its set's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            key = pa.array([fingerprint(x) or b"" for x in shingle_sets(texts_of(batch), width)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, key], [*batch.schema.names, "set_key"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("set_key", BinaryType())]))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with all its columns. Null ids stay.

    A row is known by its id and set: rows of one id with different sets are each judged by their own; of rows equal in
    both, the one of least text, then of least other columns, stays.
    """
    key, first = (F.coalesce(c, F.lit(b"")) for c in ("set_key", "first_key"))
    rows = judged(docs, width, percent).where(F.col("doc_id").isNotNull())
    rows = stored(rows.select(F.col("doc_id").alias("id"), key.alias("set_key"), ((F.col("doc_id") == F.col("component_id")) & (key == first)).alias("kept")))
    ids = stored(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).where("kept"))
    known = docs.where(F.col("doc_id").isNotNull())
    at = known["doc_id"].cast("long")
    once, often = (ids.where(c).select("id") for c in ("n = 1", "n > 1"))
    out = known.join(once, at == once["id"], "left_semi").union(docs.where(F.col("doc_id").isNull()))
    if often.isEmpty():
        return out
    some = with_set_key(known.join(often, at == often["id"], "left_semi"), width)
    some = some.join(rows.where("kept").select("id", "set_key").distinct(), ["id", "set_key"], "left_semi")
    picked = some.groupBy("id", "set_key").agg(F.min_by("row", F.struct("text", F.to_json("row"))).alias("row"))
    return out.union(picked.select("row.*"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85)
