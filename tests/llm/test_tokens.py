import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import odd
from zonecast.llm.bpe import WordBpe, decode, encode
from zonecast.llm.packing import pack_pieces, packed, piece_lengths
from zonecast.llm.queries import QUERIES

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)


def test_bpe_equals_library_on_random_text(plain):
    bpe, pick = WordBpe(WORDS), random.Random(5)
    pool = "aAbBzZéÉßäÖıΣς '\n\t\x1c\x85\xa0 .,!?'s't'LL12½中か🙂" + "<|endoftext|>"
    cases = ["".join(pick.choice(pool) for _ in range(pick.randint(0, 60))) for _ in range(2000)]
    cases += ["a" * 3000, "ab" * 700 + "!" * 900, "<|startoftext|>x<|endoftext|>", "don't DON'T", ""]
    for text in cases:
        want = plain[0].encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == want, repr(text)
        assert bpe.decode(bpe.encode(text)) == plain[0].decode(want, skip_special_tokens=False)


def test_long_words_merge_as_short_ones():
    bpe, pick = WordBpe(WORDS), random.Random(2)
    for _ in range(200):
        word = "".join(pick.choice("abeinrst") for _ in range(pick.randint(1, 80)))
        data = word.encode()
        assert bpe.word(word) == bpe.long_word([*(bpe.letters[b] for b in data[:-1]), bpe.last[data[-1]]])


def test_op1_equals_library(spark, sf, plain):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op1_bpe"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = plain[0].encode(texts[r.doc_id], add_special_tokens=False).ids
        text = plain[0].decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_takes_odd_tables(spark, plain):
    rows = decode(encode(odd.documents(spark), WORDS), WORDS).collect()
    assert len(rows) == len(odd.TEXTS)
    want = sorted(plain[0].decode(plain[0].encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for _, t in odd.TEXTS)
    assert sorted(r.decoded for r in rows) == want
    assert {(r.doc_id, bytes(r.ids)) for r in encode(odd.nulls(spark), WORDS).collect()} == {(None, b"")}
    assert encode(odd.empty(spark), WORDS).count() == 0


def test_piece_lengths_are_powers_of_two():
    for n in (1, 2, 3, 2047, 2048, 2049, 9999):
        parts = piece_lengths(n, 2048)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 2048 for p in parts)


def test_op3_covers_every_id_once(spark, sf, plain):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op3_packing"](spark, sf).collect()
    ids = {k: [*plain[1].encode(t, add_special_tokens=False).ids, 1] for k, t in texts.items()}
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    seen = dict.fromkeys(ids, 0)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and 1 << r.bucket == r.length
        seen[r.doc_id] += r.length
    assert seen == {k: len(v) for k, v in ids.items()}


def test_packing_takes_odd_tables(spark, plain):
    rows = pack_pieces(odd.documents(spark), BYTES).collect()
    assert sum(r.length for r in rows) == sum(len(plain[1].encode(t or "", add_special_tokens=False).ids) + 1 for _, t in odd.TEXTS)
    assert [(r.start, r.length, r.doc_tokens) for r in packed(odd.documents(spark)).where("doc_id = 2").collect()] == [(0, 1, 1)]
    assert packed(odd.nulls(spark)).count() == len(odd.TEXTS) and packed(odd.empty(spark)).count() == 0
