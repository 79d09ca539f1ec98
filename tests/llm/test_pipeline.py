import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import odd
from tests.llm.test_copies import brute_force
from tests.llm.test_text_rules import base_spans
from zonecast.llm import packing
from zonecast.llm.common import stored

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    label = spark.read.parquet(f"{SF}/labels.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF))
        if name in ("quality_rules", "quality_classifier"):
            lost = before.join(docs, "doc_id", "left_anti").join(label.where("quality = 1"), "doc_id").where("n_chars > 400").count()
            assert lost <= 2
        if name == "minhash_near_dedup":
            texts = {r.doc_id: r.text for r in before.collect()}
            _, want = brute_force(texts, 5, 80)
            assert {r.doc_id for r in docs.collect()} == set(want.values())
        if name == "pii":
            found = {r.doc_id for r in before.collect() if base_spans(r.text)}
            assert found and not any(base_spans(r.text) for r in docs.collect() if r.doc_id in found)
        if name != "packing":
            assert docs.columns == names
            sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] == sizes[4] > 0
    assert docs.agg(F.count_distinct("doc_id")).first()[0] == sizes[4]
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_stages_take_odd_tables(spark):
    for make in (odd.documents, odd.nulls, odd.empty):
        docs = make(spark)
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, docs, "/root/testdata/sf0.001"))
            if name != "packing":
                assert out.columns == docs.columns
                assert out.schema.simpleString() == docs.schema.simpleString()


def test_pipeline_returns_the_packed_tokens(spark, tmp_path):
    """The redacted texts can be read back from what the last stage returns, and from its buckets on disk."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf))
    encoder = packing.encoding(packing.byte_vocabulary())
    want = {r.doc_id: r.text for r in docs.collect()}
    out = corpus_pipeline.run(spark, sf)
    packing.write_buckets(out, str(tmp_path / "pieces"))
    for rows in (out.collect(), spark.read.parquet(str(tmp_path / "pieces")).collect()):
        got: dict[int, list[int]] = {}
        for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
            assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
            got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
        assert all(ids[-1] == 1 for ids in got.values())
        assert {k: encoder.decode(ids[:-1]) for k, ids in got.items()} == want
