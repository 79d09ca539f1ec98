import zlib

import numpy as np
import pandas as pd

from tests.llm import odd
from zonecast.llm import quality_model, toxicity
from zonecast.llm.queries import QUERIES


def auc(y, s):
    rank = pd.Series(s).rank().to_numpy()
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def judged(spark, sf, name, label, modulus, out):
    rows = QUERIES[name](spark, sf).toPandas()
    for r in rows.head(300).itertuples():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == out)
        assert r.predicted == int(r.score >= 0.3)
    assert rows["score"].between(0, 1).all()
    rows = rows.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    rows = rows[rows["held_out"]]
    return rows[label].to_numpy(), rows["score"].to_numpy()


def test_op8_on_held_out_rows(spark):
    y, s = judged(spark, "/root/testdata/sf0.01", "op8_quality_classifier", "quality", 5, 0)
    assert auc(y, s) > 0.95 and (s[y == 1] >= 0.3).mean() > 0.98


def test_op5_on_held_out_rows(spark):
    y, s = judged(spark, "/root/testdata/sf0.1", "op5_toxicity", "toxic", 4, 2)
    assert auc(y, s) > 0.9 and (s[y == 1] >= 0.3).mean() > 0.75 and (s[y == 0] >= 0.3).mean() < 0.05


def test_updates_learn_a_word_order():
    good, bad = ["one two three four"] * 40, ["two one four three"] * 40
    w = quality_model.fit_shard(good + bad, [1] * 40 + [0] * 40)
    a, b = quality_model.scores(["one two three four", "two one four three"], w)
    assert a > 0.9 and b < 0.1


def labels(spark, docs, label):
    rows = [(r.doc_id, i % 2) for i, r in enumerate(docs.collect())]
    return spark.createDataFrame([*rows, (None, 1), (1, None), (77, 1)], f"doc_id long, {label} int")


def test_classifiers_take_odd_tables(spark):
    docs = odd.documents(spark)
    weights = quality_model.fit(docs, labels(spark, docs, "quality"), "quality", 5, 0)
    model = toxicity.fit(docs, labels(spark, docs, "toxic"))
    for score in (lambda d: quality_model.score_quality(d, weights), lambda d: toxicity.score_toxicity(d, model)):
        rows = score(docs).collect()
        assert len(rows) == len(odd.TEXTS) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (2, 3, 6)}) == 1
        assert score(odd.nulls(spark)).count() == len(odd.TEXTS) and score(odd.empty(spark)).count() == 0
    assert quality_model.keep_likely(docs, weights).columns == docs.columns
    none = odd.empty(spark)
    assert not quality_model.fit(none, labels(spark, none, "quality").limit(0), "quality", 5, 0).any()
    assert np.isfinite(toxicity.fit(none, labels(spark, none, "toxic").limit(0)).weights).all()


def test_op5_counts_all_but_the_bounded_sample(spark, monkeypatch):
    """Rows of every remainder that may be learnt from are counted; only about as many as the bound are set aside."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('common word', id, ' text') AS text")
    labels = spark.range(4000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    counted = []
    real = toxicity.expression_counts
    monkeypatch.setattr(toxicity, "expression_counts", lambda d: counted.append({r.doc_id for r in d.select("doc_id").collect()}) or real(d))
    monkeypatch.setattr(toxicity, "MOST_ROWS", 100)
    toxicity.fit(docs, labels)
    rest = {i: zlib.crc32(str(i).encode()) % 4 for i in range(4000)}
    allowed = {i for i, r in rest.items() if r != 2}
    assert counted[0] <= allowed and 50 < len(allowed - counted[0]) < 200
    assert {rest[i] for i in counted[0]} == {0, 1, 3}


def test_op5_words_keep_their_own_ratios(spark, monkeypatch):
    """Ratios belong to words, whatever their checksums; an unknown word has its stem's rest, or nothing; joined or held, all the same."""
    counts = [("dark", "ness", 40, 0), ("dark", "er", 1, 30), ("plai", "n", 0, 50), ("and", "", 60, 60)]
    counts += [("w", str(i), 1, 1) for i in range(3000)]
    counts = spark.createDataFrame(counts, "stem string, rest string, toxic long, ordinary long")
    texts = ["darkness darker", "Darkness, darkness", "darkroom", "zzzzunknown", "plain and darkness", "", None, "plain plain w1 w2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    results = []
    for common in (1 << 18, 2, 0):
        monkeypatch.setattr(toxicity, "COMMON_WORDS", common)
        model = toxicity.log_ratios(counts)
        assert len(model.common) <= common
        results.append({r.tag: list(r.x) for r in toxicity.figures(docs, "doc_id", model).collect()})
    ratios = {r.word: r.ratio for r in model.words.collect()}
    other = {r.stem: r.other for r in model.stems.collect()}
    # the class sees three and two rests of the stem; 0.75 of each goes to rests that were not counted
    back = np.log((0.75 * 2 / 41) / (0.75 * 1 / 30))
    # P(stem) is in both, so it falls out of the difference of two words of a stem
    seen = {k: [max(n - 0.75, 0) / s + 0.75 * r / s / 3004 for n, s, r in v] for k, v in {"ness": [(40, 41, 2), (0, 30, 1)], "er": [(1, 41, 2), (30, 30, 1)]}.items()}
    both = {k: np.log(a / b) for k, (a, b) in seen.items()}
    assert np.isclose(ratios["darkness"] - ratios["darker"], both["ness"] - both["er"])
    assert np.isclose(ratios["darkness"] - other["dark"], both["ness"] - back)
    for got in results:
        assert len(got) == len(texts)
        assert np.isclose(got[0][0], (ratios["darkness"] + ratios["darker"]) / 2) and np.isclose(got[2][0], other["dark"])
        assert got[3] == got[5] == got[6] == [0, 0, 0, 0, 1]
        assert np.allclose(got[1], [ratios["darkness"], ratios["darkness"] * 2 / 3, ratios["darkness"], np.log(3), 1])
        assert all(np.allclose(got[k], results[0][k]) for k in got)
