import hashlib
import json
import random
from collections import Counter
from functools import reduce

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm import odd
from zonecast.llm import align
from zonecast.llm.packing import byte_letters, byte_vocabulary
from zonecast.llm.queries import QUERIES


@pytest.fixture(scope="module")
def plain_tokens():
    tokenizer = Tokenizer.from_file(byte_vocabulary())
    tokenizer.encode_special_tokens = True
    letters = byte_letters()
    pieces = sentencepiece.SentencePieceProcessor(model_file=align.piece_model())
    with open(byte_vocabulary(), encoding="utf-8") as file:
        names = {i: t for t, i in json.load(file)["model"]["vocab"].items()}

    def of_b(i):
        piece = pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def run(text):
        if not text:
            return [], []
        want = (" " + text).encode()
        a = [(i, bytes(letters[c] for c in names[i])) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, of_b(i)) for i in pieces.encode(text)]
        return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])

    return run


def plain_groups(a, b):
    """Groups and links by walking over both sides."""
    groups, links, at, ends = [], [], [0, 0], [0, 0]
    open_a, open_b = [], []
    while at[0] < len(a) or at[1] < len(b):
        side = 0 if ends[0] <= ends[1] else 1
        i, data = (a, b)[side][at[side]]
        (open_a, open_b)[side].append(i)
        ends[side] += len(data)
        at[side] += 1
        if ends[0] == ends[1]:
            links.append((open_a[-1], open_b[-1]))
            groups.append(",".join(map(str, open_a)) + "|" + ",".join(map(str, open_b)))
            open_a, open_b = [], []
    assert not open_a and not open_b
    return groups, links


def plain(rows, tokens):
    got = {}
    for key, text in rows:
        a, b = tokens(text or "")
        got[key] = (len(a), len(b), *plain_groups(a, b))
    counts = Counter(x for *_, links in got.values() for x in links)
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return {
        key: (
            n_a, n_b, len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "",
        )
        for key, (n_a, n_b, groups, links) in got.items()
    }


def result(scored):
    sha = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, sha(r.groups)) for r in scored.collect()}


def made_up():
    rng = random.Random(8)
    words = ["the", "Übergröße", "naïve", "数据", "привет", "🙂🙂", "<|endoftext|>", "</s>", "don't", "x" * 90, "12345", "a.b", "\n\n", "  ", "\t", "　", "\xa0", "é"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(40)]
    texts += ["", None, " ", "\n", "a", " lead", "trail ", "a▁b", "字" * 3000, "ab" * 3000, "\x00\x01", "word " * 3000, "﻿x", "�", "a" + " " * 5000 + "b", "<0x41> <unk> <s>"]
    return list(enumerate(texts))


def test_ranges_cut_anywhere_give_the_same(spark, plain_tokens):
    rows = made_up()
    want = plain(rows, plain_tokens)
    size_b = sentencepiece.SentencePieceProcessor(model_file=align.piece_model()).get_piece_size()
    docs = odd.texts(spark, rows)
    for size, known in ((1 << 16, 1 << 20), (61, 40)):
        aligned = align.align(docs, byte_vocabulary(), align.piece_model(), size)
        assert result(align.link_scores(aligned, align.pair_counts(aligned, size_b), known)) == want


def test_fragments_are_a_monoid(plain_tokens):
    pair = align.loaded(byte_vocabulary(), align.piece_model())
    text = " Übergröße naïve 数据 привет 🙂🙂 don't stop, antidisestablishmentarianism 12345"
    a, b = plain_tokens(text[1:])
    ids = [np.array([i for i, _ in s]) for s in (a, b)]
    ends = [np.cumsum([len(x) for _, x in s]) for s in (a, b)]
    whole = align.fragment(ids[0], ends[0], ids[1], ends[1], pair)
    rng = random.Random(2)
    for _ in range(200):
        cuts = sorted(rng.sample(range(1, len(text.encode())), rng.randint(1, 20)))
        parts = []
        for low, high in zip([0, *cuts], [*cuts, len(text.encode())]):
            inside = [(e > low) & (e <= high) for e in ends]
            parts.append(align.fragment(ids[0][inside[0]], ends[0][inside[0]], ids[1][inside[1]], ends[1][inside[1]], pair))
        k = rng.randint(0, len(parts))
        left, right = reduce(align.Fragment.__add__, parts[:k], align.Fragment()), reduce(align.Fragment.__add__, parts[k:], align.Fragment())
        assert reduce(align.Fragment.__add__, parts) == whole == left + right
        assert align.Fragment() + whole == whole == whole + align.Fragment()


def test_borders_keep_away_from_crossing_tokens(plain_tokens):
    pair = align.loaded(byte_vocabulary(), align.piece_model())
    for _, text in made_up():
        data = b" " + (text or "").encode()
        parts = align.ranges(data, 50, 50)
        assert parts[0][0] == 0 and parts[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
        a, b = plain_tokens(text or "")
        if a:
            got = reduce(align.Fragment.__add__, align.fragments([data[s:e] for _, _, s, e in parts], [(x - s, y - s) for x, y, s, _ in parts], pair))
            assert got.tokens == (len(a), len(b)) and (align.group_text(got.head) + got.body)[:-1] == ";".join(plain_groups(a, b)[0])


def test_op13_equals_plain_version(spark, plain_tokens):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op13_alignment"](spark, sf).collect()
    want = plain(rows, plain_tokens)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want[r.doc_id]


def test_odd_tables(spark):
    size_b = 32_000
    for size in (1 << 16, 100):
        aligned = align.align(odd.documents(spark), byte_vocabulary(), align.piece_model(), size)
        rows = align.link_scores(aligned, align.pair_counts(aligned, size_b)).collect()
        assert len(rows) == len(odd.TEXTS)
        none = [r for r in rows if r.doc_id in (2, 3)]
        assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in none] == [(0,) * 6 + ("",)] * 2
        assert len({tuple(r) for r in rows if r.doc_id == 5}) == 1 and [r.doc_id for r in rows].count(None) == 1
    for docs, n in ((odd.nulls(spark), len(odd.TEXTS)), (odd.empty(spark), 0)):
        aligned = align.align(docs, byte_vocabulary(), align.piece_model())
        assert align.link_scores(aligned, align.pair_counts(aligned, size_b)).where("n_a = 0").count() == n
