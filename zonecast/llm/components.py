"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.llm.common import stored

#: Links that one task connects by itself; a larger graph is first shrunk to that.
ROWS = 200_000


class Forest:
    """Sets of joined keys, each found under its smallest."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (r := up.get(root, root)) != root:
            root = r
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a, b) -> bool:
        """Whether the two were apart until now."""
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def connected(edges: DataFrame) -> DataFrame:
    """(old, new): every node of at most ``ROWS`` links and the smallest node that it reaches; in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, nodes = Forest(), set()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                forest.join(a, b)
                nodes.update((a, b))
        olds = sorted(nodes)
        yield pa.RecordBatch.from_arrays([pa.array(olds, pa.int64()), pa.array([forest.find(n) for n in olds], pa.int64())], ["old", "new"])

    return edges.coalesce(1).mapInArrow(run, "old long, new long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    While there are more than ``ROWS`` links, every node joins the neighbour that comes first in a hashed order, and
    links are renamed to what they joined; links inside a joined pair vanish. That shrinks a graph of any shape by a
    constant factor a round. What is left fits one task. Rounds are stored in the shared folder. Null ends and loops
    are ignored; repeated links count once; no links give no rows.
    """
    edges = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    at, turn = None, 0
    while edges.count() > ROWS:
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        joined = stored(best.select(F.col("a").alias("old"), F.when(F.col("best") < rank("a"), F.col("best.v")).otherwise(F.col("a")).alias("new")))
        named = edges.join(joined, F.col("a") == F.col("old")).select(F.col("new").alias("a"), "b")
        named = named.join(joined, F.col("b") == F.col("old")).select("a", F.col("new").alias("b")).where("a <> b")
        edges = stored(named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        at = joined.select(F.col("old").alias("node"), F.col("new").alias("top")) if at is None else renamed(at, joined)
        turn += 1
    last = stored(connected(edges))
    if at is None:
        return last.select(F.col("old").alias("node"), F.col("new").alias("component"))
    at = renamed(at, last)
    least = stored(at.groupBy("top").agg(F.min("node").alias("component")))
    return stored(at.join(least, "top").select("node", "component"))


def renamed(at: DataFrame, joined: DataFrame) -> DataFrame:
    """(node, top) with each top replaced by what it joined, if anything."""
    return stored(at.join(joined, F.col("top") == F.col("old"), "left").select("node", F.coalesce("new", "top").alias("top")))
