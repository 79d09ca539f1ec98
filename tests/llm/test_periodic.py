import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests.llm import odd
from zonecast.llm import periodic
from zonecast.llm.queries import QUERIES


def plain_runs(words):
    """Every stretch of every period, the smallest period of each kept."""
    found = {}
    ids = np.unique(np.array(words, object), return_inverse=True)[1] if words else np.empty(0)
    for q in range(1, len(words) // 4 + 1):
        wrong = np.flatnonzero(np.append(ids[:-q] != ids[q:], True))
        starts = np.append(0, wrong[:-1] + 1)
        for start, end in zip(starts.tolist(), wrong.tolist()):
            if end > start and end - start + q >= max(6, 4 * q):
                found.setdefault((start, end + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(words):
    runs = plain_runs(words)
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    text = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (len(runs), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(text))


def test_transform_gives_exact_correlations():
    rng = np.random.default_rng(1)
    for prime, root in periodic.PRIMES:
        x = rng.integers(0, prime, (3, 16))
        assert (periodic.inverse(periodic.transform(x, prime, root), prime, root) == x).all()
    for length in (1, 2, 8, 32):
        blocks, windows = rng.integers(0, 2, (50, length)), rng.integers(0, 2, (50, 2 * length - 1))
        windows[::3, length // 2 : length // 2 + length] = blocks[::3]
        want = np.array([[(w[k : k + length] == b).all() for k in range(length)] for b, w in zip(blocks, windows)])
        assert (periodic.no_mismatch(blocks, windows) == want).all() and want.any()
    big = np.full((1, 4), 2**31 - 2)
    assert not periodic.no_mismatch(big, np.zeros((1, 7), np.int64)).any()


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_plain_runs(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(150):
        alphabet = b"abcdefgh"[: rng.randint(1, 5)]
        words = []
        while len(words) < rng.randint(0, 120):
            part = [bytes([rng.choice(alphabet)]) for _ in range(rng.randint(1, 12))]
            words += part * rng.choice((1, 1, 2, 4, 6))
        texts.append(words)
    a, b = [b"a"], [b"a", b"b"]
    for _ in range(9):
        a, b = b, b + a
    texts += [b, [b"x"] * 300, ([b"x"] * 100 + [b"y"]) * 9, [b"x"] * 5, [b"x"] * 6, [b"p", b"q"] * 4, [b"p", b"q"] * 3 + [b"p"], []]
    ids, starts = periodic.numbered(texts)
    found = periodic.find_runs(ids, max(map(len, texts)))
    for k, words in enumerate(texts):
        mine = [(s - starts[k], e - s, q) for s, e, q in found if starts[k] <= s < starts[k + 1]]
        assert mine == plain_runs(words), words


def test_checksums_that_meet_by_chance(monkeypatch):
    monkeypatch.setattr(periodic, "HASH", 7)
    monkeypatch.setattr(periodic, "BASE", 3)
    rng = random.Random(5)
    words = [[bytes([rng.choice(b"ab")]) for _ in range(rng.randint(1, 6))] * rng.randint(1, 8) for _ in range(80)]
    texts = [sum(words, [])]
    found = periodic.find_runs(periodic.numbered(texts)[0], len(texts[0]))
    assert [(s, e - s, q) for s, e, q in found] == plain_runs(texts[0])


def test_long_texts_with_many_repeats_stay_cheap():
    for words in ([b"x"] * 150_000 + [b"y"] + [b"x"] * 150_000, [b"%d" % (i % 70_000) for i in range(300_000)]):
        found = periodic.find_runs(periodic.numbered([words])[0], len(words))
        assert [(s, e - s, q) for s, e, q in found] in ([(0, 150_000, 1), (150_001, 150_000, 1)], [(0, 300_000, 70_000)])


def test_op11_equals_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op11_periodic_runs"](spark, sf).collect()
    assert len(rows) == len(texts) and sum(r.n_runs for r in rows) > 50
    for r in rows:
        want = expected(planted(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])))
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want


def test_odd_tables(spark):
    rows = {r.doc_id: r for r in periodic.periodic_runs(odd.documents(spark)).collect()}
    assert rows[2].n_words == rows[3].n_words == rows[6].n_words == 0 and rows[6].collapsed == "" and rows[6].runs == []
    assert [tuple(r) for r in rows[7].runs] == [(0, 140_000, 7)] and rows[7].collapsed == "Ein sehr langer Text, der nicht endet."
    assert rows[8].collapsed == odd.TEXTS[-1][1]
    assert periodic.periodic_runs(odd.documents(spark)).count() == len(odd.TEXTS)
    digest = periodic.runs_digest(periodic.periodic_runs(periodic.with_planted_runs(odd.nulls(spark)))).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert {(r.n_runs, r.start, r.runs_sha256, r.collapsed_sha256) for r in digest} == {(0, None, nothing, nothing)}
    assert periodic.periodic_runs(odd.empty(spark)).count() == 0
