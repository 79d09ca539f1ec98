"""BPE encoding and decoding: a contiguous array of ranks per word, scanned for its minimum."""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.llm.common import slices, table, texts_of
from zonecast.llm.packing import byte_letters

#: White space as the vocabulary's own splitting sees it; Python's also has \x1c-\x1f.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed: the pattern that the vocabulary's words follow.
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
#: The same for lower-case ASCII, where Python's own engine is faster.
_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_GAPS = re.compile(f"[{SPACE}]+")
_ODD = re.compile("[\x1c-\x1f]")

#: No merge.
_NONE = 1 << 62
_SHIFT, _MASK = 20, (1 << 20) - 1
#: Words of more parts than this take a heap in place of scans.
SHORT = 200
#: Encoded chunks, and words of several chunks, that a worker remembers; it starts anew beyond that.
REMEMBERED = 200_000


class WordBpe:
    """Encoder and decoder for a tokenizers file with lower-cased words and an end-of-word suffix."""

    def __init__(self, vocabulary: str) -> None:
        with open(vocabulary, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        vocab = model["vocab"]
        suffix = model["end_of_word_suffix"]
        if not suffix or content["decoder"] is not None or model["dropout"] or model["byte_fallback"]:
            raise ValueError("this vocabulary is of another kind")
        self.letters = {b: vocab[c] for c, b in byte_letters().items()}
        self.last = {b: vocab[c + suffix] for c, b in byte_letters().items()}
        # pair of ids -> rank and merged id in one number, so that the least number is the first merge
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[a] << _SHIFT | vocab[b], rank << _SHIFT | vocab[a + b])
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.known: dict[str, bytes] = {}
        self.known_words: dict[str, bytes] = {}

    def word(self, word: str) -> list[int]:
        """Ids of a word: part boundaries and the ranks of adjacent parts stand side by side in two short lists."""
        data = word.encode()
        parts = [self.letters[b] for b in data[:-1]]
        parts.append(self.last[data[-1]])
        if len(parts) > SHORT:
            return self.long_word(parts)
        get = self.merges.get
        ranks = [get(a << _SHIFT | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = least & _MASK
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << _SHIFT | parts[i], _NONE)
            if i < len(ranks):
                ranks[i] = get(parts[i] << _SHIFT | parts[i + 1], _NONE)
        return parts

    def long_word(self, parts: list[int]) -> list[int]:
        """The same merges in the same order by a heap over linked parts, for words where scans would take too long."""
        n, get = len(parts), self.merges.get
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (m := get(parts[i] << _SHIFT | parts[j])) is not None:
                heapq.heappush(heap, (m, i, parts[i], parts[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = m & _MASK, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [p for p, there in zip(parts, alive) if there]

    def chunk(self, chunk: str) -> bytes:
        """Ids, as little-endian unsigned 32-bit, of text without white space."""
        found: list[bytes] = []
        for piece in self.cut.split(chunk) if self.cut and "<" in chunk else (chunk,):
            if piece in self.special:
                found.append(struct.pack("<I", self.special[piece]))
            elif piece.isascii():
                plain = piece.lower()
                found += map(self.remembered_word, (plain,) if plain.isalpha() else _ASCII_WORD.findall(plain))
            else:
                plain = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
                found += map(self.remembered_word, WORD.findall(plain))
        ids = b"".join(found)
        if len(chunk) < 100:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[chunk] = ids
        return ids

    def remembered_word(self, word: str) -> bytes:
        ids = self.known_words.get(word)
        if ids is None:
            parts = self.word(word)
            ids = struct.pack(f"<{len(parts)}I", *parts)
            if len(word) < 100:
                if len(self.known_words) >= REMEMBERED:
                    self.known_words.clear()
                self.known_words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Words end at white space, so that a text's ids are those of its chunks in turn."""
        chunks = _GAPS.split(text) if _ODD.search(text) else text.split()
        get, new = self.known.get, self.chunk
        return b"".join([get(c) or new(c) for c in chunks])

    def decode(self, ids: bytes) -> str:
        """The tokens with a blank between them, which is what a vocabulary without a decoder gives."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def loaded(vocabulary: str) -> WordBpe:
    return WordBpe(vocabulary)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids): each whole text's ids as little-endian unsigned 32-bit.

    Null texts count as empty and have no ids. Special tokens that stand in a text are encoded as such; none is added.
    Rows are independent: repeated rows and null ids give a row each, an empty table none; other columns are
    ignored. ``vocabulary`` is a file that every worker can open. A map without shuffle; memory is bounded by one text
    and the remembered chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in slices(batches, "text"):
            ids = pa.array([bpe.encode(t) for t in texts_of(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, ids binary")


def decode(rows: DataFrame, vocabulary: str) -> DataFrame:
    """Add ``decoded``, the text of ``ids``, to (doc_id, ids); null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in slices(batches, "ids"):
            texts = pa.array([bpe.decode(x or b"") for x in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), texts], ["doc_id", "ids", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    both = decode(encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return both.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
