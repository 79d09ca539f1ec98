import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import odd
from zonecast.llm import minhash, vectors
from zonecast.llm import components as component_module
from zonecast.llm.components import components
from zonecast.llm.queries import QUERIES


def grouped(nodes, links):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1)))


def brute_force(texts, width, percent):
    """Components by comparing all pairs that share a shingle."""
    sets = {k: shingles(t, width) for k, t in texts.items()}
    post = {}
    for k, s in sets.items():
        for x in s:
            post.setdefault(x, []).append(k)
    links = []
    for a, s in sets.items():
        count = {}
        for x in s:
            for b in post[x]:
                if b < a:
                    count[b] = count.get(b, 0) + 1
        links += [(a, b) for b, n in count.items() if 100 * n >= percent * (len(s) + len(sets[b]) - n)]
    return sets, grouped(texts, links)


@pytest.mark.parametrize("shape", ["chain", "star", "pairs", "random"])
@pytest.mark.parametrize("rows", [50, 10**6])
def test_components(spark, shape, rows, monkeypatch):
    monkeypatch.setattr(component_module, "ROWS", rows)
    pick = random.Random(3)
    links = {
        "chain": [(i, i + 1) for i in range(300)],
        "star": [(500, i) for i in range(300)],
        "pairs": [(2 * i + 1, 2 * i) for i in range(100)],
        "random": [(pick.randint(0, 400), pick.randint(0, 400)) for _ in range(250)],
    }[shape]
    table = spark.createDataFrame([*links, (None, 1), (7, 7)], "a long, b long")
    want = grouped({x for p in links for x in p if p[0] != p[1]}, links)
    assert {r.node: r.component for r in components(table).collect()} == want
    assert components(table.limit(0)).count() == 0


def test_op7_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sets, want = brute_force(texts, 3, 85)
    rows = QUERIES["op7_minhash_dedup"](spark, sf).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: r.component_id for r in rows} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in rows)


def test_large_group_with_links_at_the_bound(spark):
    """A group above one block, many of whose pairs lie just below the bound."""
    pick = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    texts = {}
    for k in range(700):
        mine = list(words)
        for at in pick.sample(range(120), pick.choice([0, 1, 1, 2, 3, 4, 5, 6])):
            mine[at] = f"x{pick.randint(0, 10**6)}"
        texts[1000 - k] = " ".join(mine)
    _, want = brute_force(texts, 3, 85)
    assert 20 < len(set(want.values())) < 690
    rows = minhash.near_duplicates(odd.texts(spark, list(texts.items())), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in rows} == want


def test_rows_sent_do_not_grow_with_the_square_of_a_group(spark):
    """Groups of rows that nothing connects: four times as many rows make under ten times as many copies, and each pair meets."""
    sent = {}
    for n in (1000, 4000):
        rows = spark.range(n).selectExpr("7L AS cluster", "id AS node", "id AS part", "256 AS bytes")
        met = minhash.dealt(rows, rows, 32).groupBy("left", "right").agg(F.collect_list(F.struct("node", "wanted")).alias("rows"))
        pairs, sent[n] = set(), 0
        for r in met.collect():
            sent[n] += len(r.rows)
            if n == 1000:
                pairs |= {(a.node, b.node) for a in r.rows for b in r.rows if a.node < b.node and (a.wanted or b.wanted)}
        assert n != 1000 or len(pairs) == 1000 * 999 // 2
    assert sent[4000] < 10 * sent[1000]


def test_block_sizes_follow_bytes(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 1 << 16)
    rows = spark.range(600).selectExpr("7L AS cluster", "id AS node", "id AS part", "10000 AS bytes")
    assert minhash.dealt(rows, rows, 1024).groupBy("left", "right").count().agg(F.max("count")).first()[0] < 60


@pytest.mark.parametrize("alike", [True, False])
def test_intersections_of_a_block(alike, monkeypatch):
    monkeypatch.setattr(minhash, "CELLS", 1000)  # several strips
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 90 if alike else 10**6, rng.integers(1, 80)).astype(np.uint64)) for _ in range(70)]
    rows = np.array([0, 3, 69])
    got = minhash.Block(sets).intersections(rows, sets)
    assert all(got[k, y] == len(np.intersect1d(sets[x], s)) for k, x in enumerate(rows) for y, s in enumerate(sets) if x != y)
    assert minhash.Block([sets[0]]).intersections(np.array([0]), sets).shape == (1, 1)


def test_near_duplicates_take_odd_tables(spark):
    rows = minhash.near_duplicates(odd.documents(spark)).collect()
    assert len(rows) == len(odd.TEXTS)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id in (4, 5)) == [(4, 4, True), (5, 4, False), (5, 4, False)]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert all(r.n_shingles == 0 and r.kept for r in rows if r.doc_id in (2, 3, 6))
    one = minhash.keep_one(odd.documents(spark))
    assert one.columns == odd.documents(spark).columns and one.count() == 8
    assert minhash.near_duplicates(odd.nulls(spark)).where("kept").count() == len(odd.TEXTS)
    assert minhash.near_duplicates(odd.empty(spark)).count() == 0 and minhash.keep_one(odd.empty(spark)).count() == 0


def test_keep_one_knows_rows_by_id_and_set(spark):
    """Different texts under one id are each judged by their own, copies under one id leave one, always the same."""
    clean = " ".join(f"clean{i}" for i in range(60))
    own = " ".join(f"own{i}" for i in range(60))
    base = " ".join(f"word{i}" for i in range(60))
    near = base + " end"
    other, closer = " ".join(f"other{i}" for i in range(60)), " ".join(f"other{i}" for i in range(61))
    rows = [(5, clean, "a"), (5, own, "b"), (2, base, "c"), (5, near, "d"), (7, base, "e"), (8, other, "f"), (8, closer, "g")]
    rows += [(9, "one  two", "i"), (9, "one two", "h"), (9, "", "j"), (9, None, "k"), (None, clean, "l"), (None, clean, "m")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3)
        got = {r.source for r in minhash.keep_one(docs, 5, 80).collect()}
        one = got & {"f", "g"}
        assert len(one) == 1 and got - one == {"a", "b", "c", "i", "k", "l", "m"}
        if order is rows:
            before = one
    assert one == before


def links_by_cosine(ids, x, least=0.9):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(x @ x.T >= least, 1))
    return [(ids[a], ids[b]) for a, b in zip(i, j)]


def test_op9_against_all_pairs(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids = [r.vec_id for r in rows]
    links = links_by_cosine(ids, np.array([r.embedding for r in rows], float))
    count = dict.fromkeys(ids, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    got = {r.vec_id: r for r in QUERIES["op9_vector_dedup"](spark, sf).collect()}
    assert len(got) == len(ids) and all(got[k].n_links <= n for k, n in count.items())
    assert sum(r.n_links for r in got.values()) >= 0.99 * 2 * len(links)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_recall_at_the_bound(spark):
    """Pairs spread over cosines from 0.85 to 1: none below the bound, nearly all above."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(1500, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.normal(size=base.shape)
    away -= (away * base).sum(axis=1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cosine = rng.uniform(0.85, 1, (1500, 1))
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * away])
    links = links_by_cosine(range(3000), x)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = vectors.near_vectors(table).selectExpr("sum(n_links)").first()[0]
    assert 0.9 * 2 * len(links) <= found <= 2 * len(links)


def test_vectors_take_odd_tables(spark):
    rows = [
        (1, [1.0, 0.0, 0.0], "a"),
        (2, [2.0, 0.0, 0.0], "a"),
        (3, [1.0, 0.1, 0.0], "b"),
        (4, [0.0, 0.0, 0.0], None),
        (5, None, None),
        (6, [1.0, None, 0.0], "a"),
        (7, [float("nan"), 0.0, 1.0], "a"),
        (8, [float("inf"), 0.0, 1.0], "a"),
        (9, [1.0, 0.0], "a"),
        (10, [1.0, 0.0], "a"),
        (11, [], "a"),
        (None, [1.0, 0.0, 0.0], "a"),
        (12, [0.0, 0.0, 5.0], "a"),
        (12, [0.0, 0.0, 5.0], "a"),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(table).collect()), key=str)
    want = [(k, 0, k, True) for k in (4, 5, 6, 7, 8, 11, None)]
    want += [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (9, 1, 9, True), (10, 1, 9, False), (12, 1, 12, True), (12, 1, 12, True)]
    assert got == sorted(want, key=str)
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_documents_far_apart_in_every_list_are_candidates(spark):
    """Two signatures that agree in every second coordinate, with 20 others between them in each list they share."""
    pick = random.Random(9)
    of = lambda n: [pick.randint(1, 250) for _ in range(n)]
    sigs = {1: [5 if k % 2 == 0 else 0 for k in range(32)], 2: [5 if k % 2 == 0 else 255 for k in range(32)]}
    lists = {n: [7000 + k if k % 2 == 0 else 100 * n + k for k in range(minhash.PREFIX)] for n in sigs}
    for at in range(0, minhash.PREFIX, 2):
        for k in range(20):
            n = 1000 + 100 * at + k
            sigs[n], lists[n] = of(32), [10**6 * n + j for j in range(minhash.PREFIX)]
            sigs[n][at], sigs[n][at + 1], sigs[n][at - 1], lists[n][at] = 5, 100 + k, 100 + k, 7000 + at
    rows = [(n, bytearray(s), bytearray(s[::-1]), lists[n]) for n, s in sigs.items()]
    reps = spark.createDataFrame(rows, "doc_id long, sig binary, gis binary, pairs array<long>")
    agree = lambda a, b: sum(x == y for x, y in zip(sigs[a], sigs[b])) >= minhash.LEAST
    want = {(a, b) for a in sigs for b in sigs if a < b and agree(a, b)}
    assert want == {(1, 2)} == {(r.a, r.b) for r in minhash.candidate_links(reps).collect()}
