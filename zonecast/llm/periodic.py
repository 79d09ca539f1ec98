"""Periodic runs of words: blocks are convolved with the window after them, scale by scale."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.llm.common import slices, table, texts_of

#: Primes k * 2**m + 1 with a primitive root. Sums stay exact below their product, about 2**61.
PRIMES = ((2013265921, 31), (1811939329, 13))
#: Modulus and base of the prefix checksums that extensions are first measured with.
HASH, BASE = 2147483647, 1_000_003
#: Numbers in one batch of transforms; a block that is longer goes alone.
CELLS = 1 << 20
#: Fewest words of a run, and fewest periods.
LEAST, TIMES = 6, 4


def powers(root: int, n: int, prime: int) -> np.ndarray:
    """root**0 .. root**(n - 1) modulo ``prime`` by doubling."""
    out = np.ones(n, np.int64)
    have, step = 1, root % prime
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * step % prime
        have, step = have + take, step * step % prime
    return out


def transform(rows: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Number-theoretic transform of each row, in bit-reversed order."""
    count, size = rows.shape
    half = size // 2
    while half:
        x = rows.reshape(count, -1, 2, half)
        w = powers(pow(root, (prime - 1) // (2 * half), prime), half, prime)
        rows = np.stack([(x[:, :, 0] + x[:, :, 1]) % prime, (x[:, :, 0] - x[:, :, 1]) * w % prime], 2).reshape(count, size)
        half //= 2
    return rows


def inverse(rows: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Rows back from bit-reversed order."""
    count, size = rows.shape
    half = 1
    while half < size:
        x = rows.reshape(count, -1, 2, half)
        w = powers(pow(root, prime - 1 - (prime - 1) // (2 * half), prime), half, prime)
        turned = x[:, :, 1] * w % prime
        rows = np.stack([(x[:, :, 0] + turned) % prime, (x[:, :, 0] - turned) % prime], 2).reshape(count, size)
        half *= 2
    return rows * pow(size, -1, prime) % prime


def no_mismatch(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Where each block, moved by 0 .. its length - 1, equals what lies under it in its window.

    The sum of squared differences is the sum of both squares less twice the correlation; the latter is a product of
    transforms of twice the block's length, whose wrapped part lies outside the places that are read.
    """
    count, length = blocks.shape
    equal = np.ones((count, length), bool)
    for prime, root in PRIMES:
        turned, under = np.zeros((count, 2 * length), np.int64), np.zeros((count, 2 * length), np.int64)
        turned[:, :length] = blocks[:, ::-1]
        under[:, : 2 * length - 1] = windows
        product = transform(turned, prime, root) * transform(under, prime, root) % prime
        cross = inverse(product, prime, root)[:, length - 1 : 2 * length - 1]
        sums = np.concatenate([np.zeros((count, 1), np.int64), np.cumsum(under * under % prime, 1)], 1)
        squares = (blocks * blocks % prime).sum(1, keepdims=True) + sums[:, length : 2 * length] - sums[:, :length]
        equal &= (squares - 2 * cross) % prime == 0
    return equal


def gaps(ids: np.ndarray) -> np.ndarray:
    """Words from each word to its next occurrence; the length of all where there is none."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), len(ids), np.int64)
    same = ids[order[:-1]] == ids[order[1:]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


class Extender:
    """How far two places of a word sequence agree, before and after."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.base = ids, powers(BASE, len(ids) + 1, HASH)
        self.sums = np.concatenate([[0], np.cumsum((ids + 1) % HASH * self.base[:-1] % HASH)])

    def same(self, at: np.ndarray, moved: np.ndarray, length: np.ndarray) -> np.ndarray:
        left = (self.sums[at + length] - self.sums[at]) % HASH
        right = (self.sums[moved + length] - self.sums[moved]) % HASH
        return left * self.base[moved - at] % HASH == right

    def agreed(self, at: np.ndarray, distance: np.ndarray, back: bool) -> np.ndarray:
        """Longest agreement of what starts (or, backwards, ends) at ``at`` and ``distance`` behind, by halving."""
        low = np.zeros(len(at), np.int64)
        high = at.copy() if back else len(self.ids) - at - distance
        while (low < high).any():
            middle = (low + high + 1) // 2
            start = at - middle if back else at
            fits = self.same(start, start + distance, middle)
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low

    def stretch(self, first: int, last: int, distance: int, left: int, right: int) -> tuple[int, int]:
        """Start and end of a stretch of that period around the known part; checksums that met by chance are seen through."""
        start, end = first - left, last + right + distance
        wrong = np.flatnonzero(self.ids[start : end - distance] != self.ids[start + distance : end]) + start
        before, after = wrong[wrong < first], wrong[wrong >= last]
        return int(before[-1]) + 1 if len(before) else start, (int(after[0]) + distance if len(after) else end)


def find_runs(ids: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """All (start, end, period) with the smallest period repeated ``TIMES`` times or more, over ``LEAST`` words or more.

    At scale L, blocks of L words at multiples of L are sought L to 2L - 1 words further on, which finds the periods
    of that size: such a run holds a whole block and its copy. Blocks with a word that does not come again within
    2L words have no copy and skip the convolution, as do blocks that lie, with their whole window, in a known run of
    period L or less. A copy that lies with its block in a known run whose period divides its distance belongs to that
    run. ``longest`` is the length of the longest text; texts are told apart by words that occur once.
    """
    n = len(ids)
    extender: Extender | None = None
    runs: list[tuple[int, int, int]] = []
    length, widest = 1, gaps(ids)
    while TIMES * length <= longest:
        starts = outside(np.flatnonzero(widest < 2 * length) * length, length, runs)
        if len(starts):
            padded = np.concatenate([ids, np.full(3 * length, n + 1, np.int64)])
            b, d = [], []
            step = max(1, CELLS // (2 * length))
            for k in range(0, len(starts), step):
                at = starts[k : k + step, None]
                row, lag = np.nonzero(no_mismatch(padded[at + np.arange(length)], padded[at + np.arange(length, 3 * length - 1)]))
                b.append(starts[k + row])
                d.append(lag + length)
            found = chains(np.concatenate(b), np.concatenate(d), length, runs)
            if len(found[0]):
                extender = extender or Extender(ids)
                first, last, distance = found
                left, right = extender.agreed(first, distance, True), extender.agreed(last, distance, False)
                long = left + right + last - first + distance >= np.maximum(LEAST, TIMES * distance)
                for x in np.stack([first, last, distance, left, right], 1)[long].tolist():
                    start, end = extender.stretch(*x)
                    if end - start >= max(LEAST, TIMES * x[2]):
                        runs.append((start, end, x[2]))
        length *= 2
        whole = len(widest) // 2
        widest = np.maximum(widest[: 2 * whole : 2], widest[1 : 2 * whole : 2])
    return sorted({(s, e): (s, e, q) for s, e, q in reversed(runs)}.values(), key=lambda r: (r[0], r[2]))


def outside(starts: np.ndarray, length: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Blocks whose window leaves every known run of period up to ``length``."""
    keep = np.ones(len(starts), bool)
    for start, end, period in runs:
        if period <= length and end - start >= 3 * length:
            low, high = np.searchsorted(starts, [start, end - 3 * length + 1])
            keep[low:high] = False
    return starts[keep]


def chains(b: np.ndarray, d: np.ndarray, length: int, runs: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
    """First word, end and distance of neighbouring blocks that match at one distance and lie in no run known for it."""
    keep = np.ones(len(b), bool)
    for start, end, period in runs:
        if end - start >= 2 * length:
            low, high = np.searchsorted(b, [start, end - 2 * length + 1])
            keep[low:high] &= (b[low:high] + d[low:high] + length > end) | (d[low:high] % period != 0)
    b, d = b[keep], d[keep]
    order = np.lexsort((b, d))
    b, d = b[order], d[order]
    new = np.ones(len(b), bool)
    new[1:] = (d[1:] != d[:-1]) | (b[1:] != b[:-1] + length)
    last = np.append(new[1:], True)
    return b[new], b[last if len(b) else new] + length, d[new]


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts as numbers, a number of its own after each text, and where each text starts."""
    known: dict[bytes, int] = {}
    total = sum(map(len, texts)) + len(texts)
    ids, starts, at = np.empty(total, np.int64), np.zeros(len(texts) + 1, np.int64), 0
    for k, words in enumerate(texts):
        ids[at : at + len(words)] = [known.setdefault(w, len(known)) for w in words]
        ids[at + len(words)] = -1
        at += len(words) + 1
        starts[k + 1] = at
    ids[starts[1:] - 1] = len(known) + np.arange(len(texts))
    return ids, starts


RUNS = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): runs of words (start, length, period) by start, then period, and the text without
    what they repeat: its words outside the runs and the first period of each, joined by one blank.

    Words are what stands between ASCII white space. A run is a stretch whose smallest period fits ``TIMES`` times
    or more and that no neighbouring word extends; it has ``LEAST`` words or more. Runs may overlap, and a word that
    any of them repeats is dropped. Null, empty and blank texts have no words, no runs and an empty text. Repeated
    rows and null ids give a row each, an empty table none; other columns are ignored. A map without shuffle; whole
    texts are read, memory grows with one text's words, time with words times the square of their logarithm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in slices(batches, "text"):
            texts = [t.encode().split() for t in texts_of(batch)]
            ids, starts = numbered(texts)
            found = np.array(find_runs(ids, max(map(len, texts), default=0)), np.int64).reshape(-1, 3)
            owner = np.searchsorted(starts, found[:, 0], "right") - 1
            repeated = np.zeros(len(ids) + 1, np.int64)
            np.add.at(repeated, found[:, 0] + found[:, 2], 1)
            np.add.at(repeated, found[:, 1], -1)
            kept = np.cumsum(repeated) == 0
            for k in np.unique(owner).tolist():
                texts[k] = [w for w, stays in zip(texts[k], kept[starts[k] : starts[k + 1] - 1].tolist()) if stays]
            first = found[:, 0] - starts[owner]
            values = [pa.array(x, pa.int64()) for x in (first, found[:, 1] - found[:, 0], found[:, 2])]
            offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(starts) - 1),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(values, fields=list(kind))),
                    pa.array([b" ".join(words).decode() for words in texts], pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by the checksum of its id, goes on in a period from some word on.

    Null ids have no checksum and keep their text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for k, h in enumerate(batch.column("h").to_pylist()):
                words = texts[k].encode().split() if h is not None and h % 10 == 0 else []
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    texts[k] = b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)]).decode()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    key = F.col("doc_id").cast("long")
    picked = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"), F.crc32(key.cast("string").cast("binary")).alias("h"))
    return picked.mapInArrow(run, "doc_id long, text string")


def runs_digest(rows: DataFrame) -> DataFrame:
    """Number of runs, the one with the greatest exponent, checksums of runs and of the collapsed text."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    # runs stand by start, then period, so that the first of equal exponents stays
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda top, r: F.when(more(r, top), r).otherwise(top))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return rows.select("doc_id", "n_words", "runs", "collapsed", best.alias("top")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.floor(F.lit(1000) * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_digest(periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))))
