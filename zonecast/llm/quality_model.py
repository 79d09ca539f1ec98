"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.llm.common import slices, stored, table, texts_of
from zonecast.llm.labelled import agreed_labels, held_out, sampled, with_labels

#: Hash space of the features; the size of the model whatever the size of the corpus.
BITS = 18
#: Bound on the labelled rows that the model is fitted on, and the number of shards they are fitted in.
MOST_ROWS, SHARDS = 16_384, 4
#: Updates: learning rate, its offset, penalties, passes over a shard.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-3, 1e-3, 4
SCALE = 8.0

_SHAPE = bytes(
    ord("a") if 97 <= b <= 122 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else ord("u") if b >= 128 else b for b in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.S)
_MASK = np.uint64((1 << BITS) - 1)


def mixed(seed: int, *parts: np.ndarray) -> np.ndarray:
    """A slot of the hash space for each combination of the parts."""
    h = np.full(len(parts[0]), seed, np.uint64)
    for part in parts:
        h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h & _MASK).astype(np.int64)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, slot) of every n-gram and the number of words of each text.

    n-grams: words and pairs of words without case and outer punctuation; runs of one to three word forms (upper and
    lower case, digits, signs, repeats collapsed); whether a word repeats the one before.
    """
    lists = [t.encode().split() for t in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    doc = np.repeat(np.arange(len(texts)), n)
    codes, words = pd.factorize(np.fromiter(chain.from_iterable(lists), object, len(doc)))
    if not len(words):
        return doc, doc, n
    core = np.array([zlib.crc32(w.strip(b".,;:!?()\"'").lower()) for w in words], np.uint64)[codes]
    form = np.array([zlib.crc32(_RUN.sub(rb"\1", w.translate(_SHAPE))) for w in words], np.uint64)[codes]

    def after(values: np.ndarray, step: int) -> np.ndarray:
        """The value ``step`` words on; 1 beyond the end of the text."""
        out = np.ones_like(values)
        same = doc[step:] == doc[: len(doc) - step]
        out[: len(doc) - step][same] = values[step:][same]
        return out

    form1, core1 = after(form, 1), after(core, 1)
    slots = [
        mixed(1, core),
        mixed(2, core, core1),
        mixed(3, form),
        mixed(4, form, form1),
        mixed(5, form, form1, after(form, 2)),
        mixed(6, (core == core1).astype(np.uint64)),
    ]
    return np.tile(doc, len(slots)), np.concatenate(slots), n


def fit_shard(texts: list[str], y: list[int]) -> np.ndarray:
    """Weights, the intercept last, after ``EPOCHS`` passes of updates in the given order."""
    vectors = []
    for text in texts:
        _, slots, n = grams([text])
        at, count = np.unique(slots, return_counts=True)
        vectors.append((np.append(at, 1 << BITS), np.append(count * (SCALE / max(n[0], 1)), 1.0)))
    z, g2 = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(g2[at])) / ALPHA + L2))

    order = np.arange(len(y))
    for epoch in range(EPOCHS):
        np.random.default_rng(epoch).shuffle(order)
        for i in order:
            at, x = vectors[i]
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y[i]) * x
            z[at] += g - (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / ALPHA * w
            g2[at] += g * g
    return weights(np.arange((1 << BITS) + 1))


def fit(docs: DataFrame, labels: DataFrame, label: str, modulus: int, out: int, most: int = MOST_ROWS) -> np.ndarray:
    """Fit on at most about ``most`` labelled rows, outside the held-out remainder.

    Shards are fitted side by side, each in one task, and their weights averaged; a weight per slot is all that
    reaches the driver. Without any label the weights are zero.
    """
    rows = stored(agreed_labels(labels, label, modulus, out))
    count = rows.count()
    sample = with_labels(docs, sampled(rows, count, most), min(count, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(s, d, t or "", y) for b in batches for s, d, t, y in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "text", "y")))]
        for shard in sorted({x[0] for x in got}):
            mine = sorted(x[1:] for x in got if x[0] == shard)
            w = fit_shard([t for _, t, _ in mine], [y for *_, y in mine])
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at]), pa.array(np.full(len(at), shard))], ["slot", "weight", "shard"])

    shard = F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int")
    fitted = sample.withColumn("shard", shard).repartition(SHARDS, "shard").mapInArrow(run, "slot long, weight double, shard long")
    fitted = stored(fitted)
    shards = max(fitted.select("shard").distinct().count(), 1)
    mean = fitted.groupBy("slot").agg((F.sum("weight") / shards).alias("weight")).toPandas()
    weights = np.zeros((1 << BITS) + 1)
    weights[mean["slot"].to_numpy(np.int64)] = mean["weight"].to_numpy(np.float64)
    return weights


def scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Sparse dot products of the texts' n-gram frequencies with the weights, through the logistic function."""
    doc, slots, n = grams(texts)
    dot = np.bincount(doc, weights[slots], minlength=len(texts)) * SCALE / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(dot + weights[-1], -30, 30)))


def score_quality(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every document.

    Null and empty texts have the score of the intercept. Only the text counts. Repeated rows get equal scores; an
    empty table gives no rows; other columns are ignored; long texts are read whole. A map without shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(texts_of(batch), model.value))], ["doc_id", "score"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, score double")


def keep_likely(docs: DataFrame, weights: np.ndarray, least: float = 0.3) -> DataFrame:
    """The documents that score ``least`` or more, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(scores(texts_of(batch), model.value) >= least))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = fit(docs, table(spark, sf_dir, "labels"), "quality", 5, 0)
    return score_quality(docs, weights).select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
