"""Near-duplicate embeddings: coarse inverted lists, product-quantised residuals, exact cosine of what remains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.llm.common import stored, table
from zonecast.llm.components import components

#: Bound on the vectors that the index is fitted on. Every vector is indexed.
SAMPLE = 16_384
#: Coarse lists: the square root of the number of vectors, up to this many; lists that a vector searches.
MOST_LISTS, PROBES = 1024, 16
#: Subspaces of a residual and codes of each.
PARTS, CODES = 8, 64
#: Vectors of a list, and searches of it, that meet in one task.
BASE_BLOCK, QUERY_BLOCK = 2048, 8192


def kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """At most ``k`` centres of the rows of ``x``, from a fixed start."""
    centres = x[np.random.default_rng(3).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=len(centres))
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """The ``n`` nearest centres of every row, in no order but for one."""
    far = (centres**2).sum(axis=1) - 2 * x @ centres.T
    if n == 1 or len(centres) == 1:
        return np.argmin(far, axis=1)[:, None]
    return np.argpartition(far, n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(len(centres)), (len(x), 1))


class Quantiser:
    """Coarse centres and a codebook for each subspace of the residuals. Unit vectors are padded to whole subspaces."""

    def __init__(self, sample: np.ndarray, lists: int) -> None:
        x = self.padded(sample)
        self.centres = kmeans(x, lists)
        rest = x - self.centres[nearest(x, self.centres)[:, 0]]
        self.width = x.shape[1] // PARTS
        self.books = [kmeans(np.ascontiguousarray(part), CODES) for part in np.split(rest, PARTS, axis=1)]

    @staticmethod
    def padded(x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.pad(x, ((0, 0), (0, -x.shape[1] % PARTS)))

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home list, codes and length of what the codes leave out, of padded vectors."""
        home = nearest(x, self.centres)[:, 0]
        rest = x - self.centres[home]
        parts = np.split(rest, PARTS, axis=1)
        codes = np.stack([nearest(p, b)[:, 0] for p, b in zip(parts, self.books)], axis=1)
        left = rest - np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return home, codes.astype(np.uint8), np.linalg.norm(left, axis=1)

    def distances(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of padded vectors from coded ones of list ``at``, added up from a table per subspace."""
        out = np.zeros((len(x), len(codes)))
        for m, (part, book) in enumerate(zip(np.split(x - self.centres[at], PARTS, axis=1), self.books)):
            grid = (part**2).sum(axis=1)[:, None] + (book**2).sum(axis=1) - 2 * part @ book.T
            out += grid[:, codes[:, m]]
        return out


def vectors_of(column: pa.Array) -> np.ndarray:
    """Doubles of a binary column of equally long vectors."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, key, data) of the rows that can link with others: a fingerprint and the bytes of the doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.asarray(v, np.float64) for v in batch.column("v").to_pylist()]
            raw = [v.tobytes() for v in data]
            keys = [hashlib.blake2b(b, digest_size=16).digest() for b in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([len(v) for v in data], pa.int32()), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())],
                ["vec_id", "dim", "key", "data"],
            )

    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    return rows.mapInArrow(run, "vec_id long, dim int, key binary, data binary")


def links_of(reps: DataFrame, n: int, least: float) -> DataFrame:
    """(a, b), a < b: pairs of different vectors of one length with a cosine of ``least`` or more.

    A vector is coded in its home list and searches its ``PROBES`` nearest lists; a pair is found from either side.
    Table distances drop a pair only where its true distance cannot reach the bound, given what the codes leave out.
    Lists above ``BASE_BLOCK`` vectors, and searches above ``QUERY_BLOCK``, are dealt over block pairs.
    """
    share = int(min(1.0, SAMPLE / max(n, 1)) * (1 << 20))
    sample = reps.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share).select("data").toPandas()["data"]
    if not len(sample):
        sample = reps.limit(1).select("data").toPandas()["data"]
    fitted = np.stack([np.frombuffer(b, np.float64) for b in sample])
    spark = reps.sparkSession
    index = spark.sparkContext.broadcast(Quantiser(fitted, max(1, min(MOST_LISTS, int(n**0.5)))))
    places = "list int, query boolean, vec_id long, data binary, codes binary, left_out double"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = index.value
        for batch in batches:
            ids, data = batch.column("vec_id"), batch.column("data")
            x = q.padded(vectors_of(data))
            home, codes, left = q.coded(x)
            packed_codes = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(home, pa.int32()), pa.array(np.zeros(len(x), bool)), ids, data, packed_codes, pa.array(left)],
                [c.split()[0] for c in places.split(", ")],
            )
            probes = nearest(x, q.centres, PROBES)
            for k in range(probes.shape[1]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(probes[:, k], pa.int32()), pa.array(np.ones(len(x), bool)), ids, data, pa.nulls(len(x), pa.binary()), pa.nulls(len(x), pa.float64())],
                    [c.split()[0] for c in places.split(", ")],
                )

    placed = stored(reps.select("vec_id", "data").mapInArrow(place, places))
    sizes = placed.groupBy("list").agg(F.count_if(~F.col("query")).alias("b"), F.count_if("query").alias("q"))
    blocks = stored(sizes.select("list", F.ceil(F.greatest("b", F.lit(1)) / BASE_BLOCK).cast("int").alias("nb"), F.ceil(F.greatest("q", F.lit(1)) / QUERY_BLOCK).cast("int").alias("nq")))
    pair = lambda b, q: F.struct(b.cast("int").alias("bb"), q.cast("int").alias("qb"))
    mine = F.xxhash64("vec_id")
    as_base = F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda q: pair(F.pmod(mine, "nb"), q))
    as_query = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda b: pair(b, F.pmod(mine, "nq")))
    # at most MOST_LISTS rows
    dealt = placed.join(F.broadcast(blocks), "list").withColumn("at", F.explode(F.when(F.col("query"), as_query).otherwise(as_base)))
    dealt = dealt.select("list", "at.bb", "at.qb", "query", "vec_id", "data", "codes", "left_out")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = index.value
        reach = (2 - 2 * least) ** 0.5
        now, base = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("list", "bb", "qb", "query")], axis=1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *edges], [*edges, len(keys)]):
                if start == stop:
                    continue
                part, (at, bb, qb, query) = batch.slice(start, stop - start), keys[start].tolist()
                if (at, bb, qb) != now:
                    now, base = (at, bb, qb), []
                ids, x = part.column("vec_id").to_numpy(), vectors_of(part.column("data"))
                if not query:
                    codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(-1, PARTS)
                    base.append((ids, x, codes, part.column("left_out").to_numpy()))
                    continue
                for base_ids, y, codes, left in base:
                    for s in range(0, len(x), 512):
                        own, z = ids[s : s + 512], x[s : s + 512]
                        near = q.distances(q.padded(z), at, codes) <= (reach + left + 1e-9) ** 2
                        i, j = np.nonzero(near & (own[:, None] != base_ids))
                        if len(i):
                            cosine = np.einsum("ij,ij->i", z[i], y[j]) / np.sqrt(np.einsum("ij,ij->i", z[i], z[i]) * np.einsum("ij,ij->i", y[j], y[j]))
                            i, j = i[cosine >= least], j[cosine >= least]
                        found = np.minimum(own[i], base_ids[j]), np.maximum(own[i], base_ids[j])
                        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], ["a", "b"])

    spread = dealt.repartition("list", "bb", "qb").sortWithinPartitions("list", "bb", "qb", "query")
    return stored(spread.mapInArrow(search, "a long, b long").distinct())


def near_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding).

    Equal vectors form a class, searched once and counted as often as it has rows. Vectors that are null, empty, zero,
    or hold a null or a component that is not finite link with nothing, nor do those of different lengths with each
    other. A null id has no links and no component and is kept. Rows that repeat an id count as vectors of their own.
    An empty table gives no rows; other columns are ignored.
    """
    good = stored(usable(vectors))
    classes = stored(good.groupBy("dim", "key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size")))
    members = good.select("vec_id", "dim", "key").join(classes, ["dim", "key"])
    reps = good.join(classes, ["dim", "key"]).where("vec_id = rep").select("vec_id", "dim", "data").dropDuplicates(["vec_id", "dim", "data"])
    reps = stored(reps)
    links = [links_of(reps.where(F.col("dim") == r["dim"]), r["count"], least) for r in reps.groupBy("dim").count().collect()]
    pairs = reduce(DataFrame.union, links) if links else good.select(F.col("vec_id").alias("a"), F.col("vec_id").alias("b")).limit(0)
    size = classes.select("rep", "size")
    both = pairs.union(pairs.select("b", "a"))
    others = both.join(size.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.sum("size").alias("others"))
    tops = components(pairs)
    rich = stored(
        size.join(others, F.col("rep") == F.col("a"), "left")
        .join(tops, F.col("rep") == F.col("node"), "left")
        .select("rep", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = stored(members.select("vec_id", "rep")).join(rich, "rep").select("vec_id", "n_links", "component_id")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    per_id = linked.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    named = rows.join(per_id, "vec_id", "left")
    top = F.coalesce("component_id", "vec_id")
    return named.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), top.alias("component_id"), F.coalesce(F.col("vec_id") == top, F.lit(True)).alias("kept"))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
