"""Packing by power-of-two decomposition: every sequence is one piece of one document."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.llm.common import slices, table, texts_of

#: Fixed: the split pattern of byte-level BPE vocabularies of this kind.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes
    stand for themselves, the others take the code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    rest = [b for b in range(256) if chr(b) not in letters]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def encoding(vocabulary: str) -> tiktoken.Encoding:
    """Encoder with the ids of a tokenizers file. Its ids grow with the merge ranks, so they serve as ranks."""
    with open(vocabulary, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("pieces", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


def piece_lengths(n: int, limit: int) -> list[int]:
    """``limit`` as often as it fits, then the binary digits of the rest, largest first."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


PIECES = "doc_id long, start long, length long, bucket int, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_pieces(docs: DataFrame, vocabulary: str, limit: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece; ``ids`` are little-endian unsigned 32-bit, ``bucket`` is log2 of the length.

    A document's ids, then ``end_id``, are cut into lengths that are powers of two up to
    ``limit`` (a power of two itself). Every piece is a sequence of its own, so it starts at
    offset 0, no sequence crosses documents and none needs padding; pieces of a bucket stack
    into rectangular batches. Null or empty texts give one piece that holds ``end_id``.
    Repeated rows and ids are packed each on their own; a null id stays null; an empty table
    gives no rows; other columns are ignored. Long texts are cut, never shortened. Map-only:
    a lost task is simply run again and gives the same ``sequence_id`` values, which are
    numbered within the partition of the input.
    """
    if limit & (limit - 1):
        raise ValueError("limit must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(vocabulary)
        marked = [*encoder.special_tokens_set]
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        for batch in slices(batches, "text"):
            doc, start, length, total, ids = [], [], [], [], []
            for key, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                special = "all" if any(m in text for m in marked) else set()
                got = np.append(encoder.encode_to_numpy(text, allowed_special=special, disallowed_special=()), np.uint32(end_id))
                lengths = piece_lengths(len(got), limit)
                data, at = got.astype("<u4").tobytes(), 0
                for size in lengths:
                    start.append(at)
                    ids.append(data[4 * at : 4 * (at + size)])
                    at += size
                doc += [key] * len(lengths)
                length += lengths
                total += [len(got)] * len(lengths)
            n = len(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, pa.int64()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array([x.bit_length() - 1 for x in length], pa.int32()),
                    pa.array(total, pa.int64()),
                    pa.array(range(sequence, sequence + n), pa.int64()),
                    pa.array(np.zeros(n, np.int64)),
                    pa.array(ids, pa.binary()),
                ],
                [c.split()[0] for c in PIECES.split(", ")],
            )
            sequence += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces as Parquet, one folder per length."""
    pieces.write.partitionBy("bucket").parquet(path)


def byte_vocabulary() -> str:
    """Path of the tokenizers file that pieces are encoded with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed(docs: DataFrame) -> DataFrame:
    """The pieces of ``docs`` with a checksum in place of their ids: what ``op3_packing`` shows, not a product."""
    pieces = pack_pieces(docs, byte_vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
