"""Labelled documents and the split of their ids into rows to learn from and rows held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids are broadcast up to this many rows (about 16 MB); a larger table of labels joins by a shuffle.
BROADCAST_ROWS = 1_000_000


def remainder(modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def held_out(modulus: int, value: int) -> Column:
    """Whether an id belongs to the rows that no label is learnt from; false for a null id."""
    return F.coalesce(remainder(modulus) == value, F.lit(False))


def agreed_labels(labels: DataFrame, label: str, modulus: int, out: int) -> DataFrame:
    """(doc_id, y) of the ids that may be learnt from. An id whose rows disagree is left out, as is a null label."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(modulus, out))
    each = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most"))
    return each.where("y = most").select("doc_id", "y")


def with_labels(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, y) of the documents that have a label; ``rows`` is the number of labels."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(labels) if rows <= BROADCAST_ROWS else labels, "doc_id")


def sampled(labels: DataFrame, rows: int, most: int) -> DataFrame:
    """About ``most`` of ``rows`` labels, chosen by a hash of the id; all of them where there are no more."""
    if rows <= most:
        return labels
    return labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(most / rows * (1 << 20)))


def set_aside(labels: DataFrame, rows: int, most: int) -> tuple[DataFrame, DataFrame]:
    """A sample for the final weights, chosen by a hash of the id, and every other label: at most about ``most`` of
    ``rows`` in the sample, and about a third where there are few."""
    bound = min(most / max(rows, 1), 1 / 3)
    mine = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(bound * (1 << 20))
    return labels.where(mine), labels.where(~mine)
