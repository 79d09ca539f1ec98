"""Toxicity: class-conditional Kneser-Ney models of expressions, compared by length-normalised log-likelihood."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.llm.common import slices, stored, table, texts_of
from zonecast.llm.labelled import agreed_labels, held_out, set_aside, with_labels

#: A word is the pair of its first letters and the rest.
STEM = 4
#: Most words, the commonest, whose ratios every task holds; the others are joined.
COMMON_WORDS = 1 << 18
#: Part of a class's probability that goes to the shared counts; absolute discounts follow from it.
SHARED = 0.05
#: Bound on the labelled rows that the final weights are fitted on.
MOST_ROWS = 20_000
#: A word whose log ratio is above this counts as a strong expression.
STRONG = 2.0


def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Document and code of every word, the distinct words as lower case without outer signs, words per text."""
    lists = [t.encode().split() for t in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    doc = np.repeat(np.arange(len(texts)), n)
    codes, words = pd.factorize(np.fromiter(chain.from_iterable(lists), object, len(doc)))
    return doc, codes, [w.decode().lower().strip(".,;:!?()\"'*#$%&|<>") for w in words], n


@dataclass
class Model:
    """Log ratios, log P(word | toxic) - log P(word | ordinary), by the word itself, and the weights of a text's figures.

    ``common`` has the commonest words. ``words`` (word, ratio) has every counted word and ``stems`` (stem, other) what a
    word of that stem has that was never counted; they are None if nothing was learnt.
    """

    common: dict[str, float] = field(default_factory=dict)
    words: DataFrame | None = None
    stems: DataFrame | None = None
    weights: np.ndarray = field(default_factory=lambda: np.zeros(5))


MEASURED = "key long, tag long, word string, stem string, n long, size long, total double, strong long, top array<double>"


def figures(docs: DataFrame, tag: str, model: Model) -> DataFrame:
    """(tag, x) of every row: mean log ratio, mean of the three largest, largest, log of 1 + the number of strong words, 1.

    Only strong words count as largest. A task sums up the common words of a text. The other words are a row for each
    text and word, joined to the tables of ratios: by the word, and by its stem where the word was never counted; Spark
    splits what many texts share. ``tag`` is any long column; rows are told apart by their place in the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, context = shared.value, TaskContext.get()
        first = (context.partitionId() if context else 0) << 40
        for batch in slices(batches, "text"):
            texts = texts_of(batch)
            count = len(texts)
            doc, codes, words, size = split_words(texts)
            known = [common.get(w) if w else 0.0 for w in words]
            ratio = np.array([np.nan if r is None else r for r in known], float)[codes] if words else np.zeros(0)
            here = ~np.isnan(ratio)
            total = np.bincount(doc[here], ratio[here], minlength=count)
            strong = np.flatnonzero(here & (ratio > STRONG))
            order = strong[np.lexsort((-ratio[strong], doc[strong]))]
            place = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
            top: list[list[float]] = [[] for _ in range(count)]
            for i in order[place < 3].tolist():
                top[doc[i]].append(float(ratio[i]))
            # words that differ only in case or signs are one
            number, names = pd.factorize(np.array(words, object)) if words else (np.zeros(0, np.int64), [])
            both, n = np.unique(doc[~here] * max(len(names), 1) + number[codes[~here]], return_counts=True)
            owner, rare = both // max(len(names), 1), [names[i] for i in (both % max(len(names), 1)).tolist()]
            keys, more = first + np.arange(count), len(both)
            # a text's own row has a word that no text has, so that these rows are spread as well
            own = [f" {k}" for k in keys.tolist()]
            columns = {
                "key": pa.array(np.concatenate([keys, first + owner]), pa.int64()),
                "tag": pa.concat_arrays([batch.column("tag"), pa.nulls(more, pa.int64())]),
                "word": pa.array(own + rare, pa.string()),
                "stem": pa.array(own + [w[:STEM] for w in rare], pa.string()),
                "n": pa.array(np.concatenate([np.zeros(count, np.int64), n]), pa.int64()),
                "size": pa.array(np.concatenate([size, np.zeros(more, np.int64)]), pa.int64()),
                "total": pa.array(np.concatenate([total, np.zeros(more)]), pa.float64()),
                "strong": pa.array(np.concatenate([np.bincount(doc[strong], minlength=count), np.zeros(more, np.int64)]), pa.int64()),
                "top": pa.array(top + [[]] * more, pa.list_(pa.float64())),
            }
            first += count
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    rows = docs.select(F.col(tag).cast("long").alias("tag"), F.col("text").cast("string").alias("text")).mapInArrow(run, MEASURED)
    ratio: Column = F.lit(0.0)
    if model.words is not None:
        rows = rows.join(model.words, "word", "left").join(model.stems, "stem", "left")
        ratio = F.coalesce("ratio", "other", F.lit(0.0))
    rows = rows.withColumn("value", ratio)
    hit = F.when((F.col("n") > 0) & (F.col("value") > STRONG), F.array_repeat("value", F.least("n", F.lit(3)).cast("int"))).otherwise(F.col("top"))
    each = rows.groupBy("key").agg(
        F.max("tag").alias("tag"),
        ((F.sum("total") + F.sum(F.col("n") * F.col("value"))) / F.greatest(F.sum("size"), F.lit(1))).alias("mean"),
        (F.sum("strong") + F.sum(F.when(F.col("value") > STRONG, F.col("n")).otherwise(0))).alias("strong"),
        F.sort_array(F.flatten(F.collect_list(F.when(F.size(hit) > 0, hit))), False).alias("top"),
    )
    best = [F.coalesce(F.get("top", F.lit(k)), F.lit(0.0)) for k in range(3)]
    return each.select("tag", F.array("mean", (best[0] + best[1] + best[2]) / 3, best[0], F.log1p("strong"), F.lit(1.0)).alias("x"))


def expression_counts(labelled: DataFrame) -> DataFrame:
    """(stem, rest, toxic, ordinary): in how many documents of each class a word occurs. Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            words = list(counts)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([w[:STEM] for w in words], pa.string()),
                    pa.array([w[STEM:] for w in words], pa.string()),
                    pa.array([c[1] for c in counts.values()], pa.int64()),
                    pa.array([c[0] for c in counts.values()], pa.int64()),
                ],
                ["stem", "rest", "toxic", "ordinary"],
            )
            counts.clear()
            return out

        counts: dict[str, list[int]] = {}
        for batch in slices(batches, "text"):
            y = np.array(batch.column("y").to_pylist(), np.int64)
            doc, codes, words, _ = split_words(texts_of(batch))
            width = max(len(words), 1)
            once = np.unique(doc * width + codes)
            both = np.bincount((once % width) * 2 + y[once // width], minlength=2 * width).reshape(-1, 2).tolist()
            for word, (ordinary, toxic) in zip(words, both):
                if word:
                    c = counts.setdefault(word, [0, 0])
                    c[0] += ordinary
                    c[1] += toxic
            if len(counts) > 400_000:
                yield flush()
        yield flush()

    parts = labelled.select("text", "y").mapInArrow(run, "stem string, rest string, toxic long, ordinary long")
    return parts.groupBy("stem", "rest").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def log_ratios(counts: DataFrame) -> Model:
    """Log ratios of every counted word and stem, from the counts of all labelled documents but the held-out ones and the
    bounded sample.

    P(word) = P(stem) P(rest | stem), per class. Each factor is the discounted count of the class plus a share of
    a distribution that both classes have in common: how many distinct rests follow a stem, how many distinct stems
    precede a rest. The discounts of stems give both classes the same share, so what neither has seen weighs nothing. A
    word that neither has seen gets what its stem leaves to such words in each class. No words share a ratio.
    """
    kinds = ("toxic", "ordinary")
    stems = stored(
        counts.groupBy("stem").agg(
            *(F.sum(k).alias(f"stem_{k}") for k in kinds),
            *(F.count_if(F.col(k) > 0).alias(f"rests_{k}") for k in kinds),
            F.count(F.lit(1)).alias("rests"),
        )
    )
    rests = stored(counts.groupBy("rest").agg(F.count(F.lit(1)).alias("stems")))
    total = stems.agg(
        *(F.sum(f"stem_{k}").alias(f"all_{k}") for k in kinds), *(F.count_if(F.col(f"stem_{k}") > 0).alias(f"types_{k}") for k in kinds), F.sum("rests").alias("pairs")
    ).first()
    if not total["pairs"] or not total["all_toxic"] or not total["all_ordinary"]:
        return Model()

    share = min(SHARED, *(0.95 * total[f"types_{k}"] / total[f"all_{k}"] for k in kinds))

    def of_stem(k: str):
        discount = share * total[f"all_{k}"] / total[f"types_{k}"]
        return F.greatest(F.col(f"stem_{k}") - discount, F.lit(0.0)) / total[f"all_{k}"] + share * F.col("rests") / total["pairs"]

    def left(k: str):
        """Weight of the shared counts after a stem; 1 after a stem that the class has not."""
        return F.when(F.col(f"stem_{k}") > 0, 0.75 * F.col(f"rests_{k}") / F.col(f"stem_{k}")).otherwise(1.0)

    def of_rest(k: str):
        seen = F.when(F.col(f"stem_{k}") > 0, F.greatest(F.col(k) - 0.75, F.lit(0.0)) / F.col(f"stem_{k}")).otherwise(0.0)
        return seen + left(k) * F.col("stems") / total["pairs"]

    of_stems = F.log(of_stem("toxic") / of_stem("ordinary"))
    pairs = counts.join(rests, "rest").join(stems.withColumn("of_stem", of_stems), "stem")
    ratio = F.col("of_stem") + F.log(of_rest("toxic") / of_rest("ordinary"))
    words = stored(pairs.select(F.concat("stem", "rest").alias("word"), ratio.alias("ratio"), (F.col("toxic") + F.col("ordinary")).alias("n")))
    other = stored(stems.select("stem", (of_stems + F.log(left("toxic") / left("ordinary"))).alias("other")))
    # the commonest words, by whole steps of their count, so that only a histogram is needed to find them
    step = F.floor(F.log2("n") * 4)
    least, held = None, 0
    for row in words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        held += row["count"]
        if held > COMMON_WORDS:
            break
        least = row["step"]
    got = words.where(step >= least).select("word", "ratio").toPandas() if least is not None else pd.DataFrame({"word": [], "ratio": []})
    return Model(dict(zip(got["word"].tolist(), got["ratio"].tolist())), words.select("word", "ratio"), other)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, out: int = 2) -> Model:
    """Counts from every labelled document but a bounded sample, final weights from that sample.

    The counts and the ratios of their words grow with the labels and stay in Spark; only ``COMMON_WORDS`` ratios and
    the sample's figures (five numbers each) reach the driver.
    """
    rows = stored(agreed_labels(labels, label, modulus, out))
    size = rows.count()
    few, most = set_aside(rows, size, MOST_ROWS)
    model = log_ratios(stored(expression_counts(with_labels(docs, most, size))))
    sample = with_labels(docs, few, min(size, MOST_ROWS))
    got = figures(sample, "y", model).withColumnRenamed("tag", "y").toPandas()
    if got["y"].nunique() == 2:
        model.weights = logistic(np.stack(got["x"]), got["y"].to_numpy(float))
    else:
        model.weights = np.array([1.0, 0.5, 0.5, 0.5, -3.0])
    return model


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document; higher is likelier toxic.

    Null and empty texts have the score of a text without any known word. Only the text counts. Repeated rows get
    equal scores; an empty table gives no rows; other columns are ignored; long texts are read whole. Moves a row for each
    text and each of its words that are not common.
    """
    x = figures(docs, "doc_id", model)
    dot = sum((F.col("x")[k] * float(w) for k, w in enumerate(model.weights)), F.lit(0.0))
    score = 1 / (1 + F.exp(-F.greatest(F.least(dot, F.lit(30.0)), F.lit(-30.0))))
    return x.select(F.col("tag").alias("doc_id"), score.alias("score"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
