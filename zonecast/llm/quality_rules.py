"""Quality rules: counts of repetition and symbols, then divergence of histograms from language references."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.llm.common import slices, table, texts_of

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Fixed: frequent words of each language.
COMMON = {
    "de": "der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er",
    "en": "the of and to in is that for it was on are with as by at this be have or an from not a they",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o pero sus",
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas plus au ce il ne se avec",
}
BINS = sorted(set(" ".join(COMMON.values()).split()))

#: Guards and bounds. A document of fewer words is judged by the base rules only; a shorter one may lie further from
#: its reference, since its histogram is noisier: bound + slack / sqrt(words).
LEAST_WORDS = 50
#: Only documents with at most these shares of capitals, of ``!?`` and of other signs enter a reference.
PLAIN = (0.15, 0.01, 0.01)
CHAR_BOUND, CHAR_SLACK = 0.12, 1.0
WORD_BOUND, WORD_SLACK = 0.28, 1.5

_CLASSES = np.full(256, 8)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", SPACES, ".,;:'\"-()", "!?")):
    _CLASSES[[ord(c) for c in _chars]] = _k
_CLASSES[[b for b in range(33, 127) if _CLASSES[b] == 8]] = 6
_CLASSES[192:] = 7
N_CLASSES = 8

_CODE = {w.encode(): i for i, w in enumerate(BINS)}


class Measured:
    """Counts of a batch of texts; a row of each array per text."""

    def __init__(self, texts: list[str], windows: bool = True) -> None:
        raw = [t.encode() for t in texts]
        lists = [r.split() for r in raw]  # bytes split at exactly the six ASCII spaces
        self.n_words = np.fromiter(map(len, lists), np.int64, len(lists))
        self.size = len(texts)
        doc = np.repeat(np.arange(self.size), self.n_words)
        codes, words = pd.factorize(np.fromiter(chain.from_iterable(lists), object, len(doc)))
        kind = np.array([_CODE.get(w.strip(b".,;:!?()\"'").lower(), len(BINS)) for w in words] or [0])
        self.common = self._histogram(doc, kind[codes], len(BINS) + 1)
        data = np.frombuffer(b"".join(raw), np.uint8)
        owner = np.repeat(np.arange(self.size), np.fromiter(map(len, raw), np.int64, len(raw)))
        self.classes = self._histogram(owner, _CLASSES[data], N_CLASSES + 1)[:, :N_CLASSES]
        if windows:
            self.word_chars = np.array([len(t) - sum(map(t.count, SPACES)) for t in texts], np.int64)
            self.n_symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
            self.n_dup_lines = np.array([duplicate_lines(t) for t in texts], np.int64)
            self.n_repeat_words = self._repeats(codes, doc)

    def _histogram(self, owner: np.ndarray, kind: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(owner * width + kind, minlength=self.size * width).reshape(self.size, width)

    def _repeats(self, codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Words in windows of 8 that a text holds twice or more; windows are named exactly, by pairs of halves."""
        if len(codes) < 8:
            return np.zeros(self.size, np.int64)
        name = codes.astype(np.int64)
        for step in (1, 2, 4):
            name = pd.factorize(name[:-step] * (name.max() + 1) + name[step:])[0]
        starts = np.flatnonzero(doc[: len(name)] == doc[7 : 7 + len(name)])
        found, _ = pd.factorize(doc[starts] * (name.max() + 1) + name[starts])
        starts = starts[np.bincount(found)[found] > 1] if len(found) else starts
        edge = np.bincount(starts, minlength=len(doc) + 9) - np.bincount(starts + 8, minlength=len(doc) + 9)
        return np.bincount(doc[np.cumsum(edge)[: len(doc)] > 0], minlength=self.size)

    def base_failed(self) -> np.ndarray:
        return (self.n_words < 20) | (100 * self.n_repeat_words > 30 * self.n_words)


def duplicate_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance to base 2 between rows of ``p`` and ``q``."""
    mid = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(p > 0, p * np.log2(p / mid), 0) + np.where(q > 0, q * np.log2(q / mid), 0)
    return np.sqrt(np.clip(part.sum(axis=-1) / 2, 0, 1))


References = dict[str, tuple[list[float], list[float]]]


def fit_references(docs: DataFrame) -> References:
    """Mean histograms of each known language and, under "", of all documents together.

    Every document of ``LEAST_WORDS`` words and more within ``PLAIN`` counts once. Tasks add up what they read, so a row per language
    and task is all that moves; the result has at most five entries, whatever the size of the table.
    """
    width = N_CLASSES + len(BINS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros(width + 1) for k in ("", *COMMON)}
        for batch in slices(batches, "text"):
            m = Measured(texts_of(batch), windows=False)
            plain = (m.n_words >= LEAST_WORDS) & (shares(m.classes)[:, [1, 5, 6]] <= PLAIN).all(axis=1)
            rows = np.hstack([shares(m.classes), shares(m.common), np.ones((m.size, 1))]) * plain[:, None]
            lang = np.array(batch.column("lang").to_pylist(), object)
            totals[""] += rows.sum(axis=0)
            for k in COMMON:
                totals[k] += rows[lang == k].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals)), pa.array([list(v) for v in totals.values()], pa.list_(pa.float64()))], ["lang", "sums"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    parts = docs.select(F.col("text").cast("string").alias("text"), lang.alias("lang")).mapInArrow(run, "lang string, sums array<double>")
    total = parts.select("lang", F.posexplode("sums").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    sums: dict[str, np.ndarray] = {}
    for row in total.collect():
        sums.setdefault(row["lang"], np.zeros(width + 1))[row["at"]] = row["x"]
    out = {k: v[:-1] / v[-1] for k, v in sums.items() if v[-1] > 0}
    return {k: (list(v[:N_CLASSES]), list(v[N_CLASSES:])) for k, v in out.items()}


def distances(m: Measured, references: References) -> tuple[np.ndarray, np.ndarray]:
    """Distances of each text's histograms from those of the language that is nearest to it."""
    if not references:
        return np.zeros(m.size), np.zeros(m.size)
    chars = np.stack([js_distance(shares(m.classes), np.array(c)) for c, _ in references.values()])
    words = np.stack([js_distance(shares(m.common), np.array(w)) for _, w in references.values()])
    at = np.argmin(chars + words, axis=0), np.arange(m.size)
    return chars[at], words[at]


def verdict(m: Measured, chars: np.ndarray, words: np.ndarray) -> np.ndarray:
    root = np.sqrt(np.maximum(m.n_words, 1))
    near = (chars <= CHAR_BOUND + CHAR_SLACK / root) & (words <= WORD_BOUND + WORD_SLACK / root)
    return ~m.base_failed() & ((m.n_words < LEAST_WORDS) | near)


RULES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, char_distance double, word_distance double"
)


def quality_rules(docs: DataFrame, references: References) -> DataFrame:
    """One row of counts, distances and verdict per document.

    Null texts count as empty: no words, base rules failed. Each text is compared with
    the nearest reference, whatever its ``lang`` says. Rows are judged one by one, so repeated rows, null ids, ties and hot sources need no care; an empty
    table gives no rows; other columns are ignored. Texts are read whole. A map without shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            m = Measured(texts_of(batch))
            chars, words = distances(m, references)
            counts = [pa.array(x, pa.int64()) for x in (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)]
            flags = [pa.array(m.base_failed()), pa.array(verdict(m, chars, words)), pa.array(chars), pa.array(words)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, *flags], [c.split()[0] for c in RULES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RULES)


def keep_good(docs: DataFrame, references: References) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            m = Measured(texts_of(batch))
            yield batch.filter(pa.array(verdict(m, *distances(m, references))))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit_references(docs))
