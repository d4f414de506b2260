"""The pipeline on the smallest tables against its stages done by hand."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evigraph.llm import decision_lists, mixing, suffix_dedup
from tests.llm.test_media_rules_mix import base_statistics
from tests.llm.test_similarity import brute_components, brute_removal

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["quality rules"](spark, docs, SF).cache()
    names = {r.doc_id for r in clean.collect()}
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    judged = {r.doc_id: r["__rule"] for r in decision_lists.judge(docs, labels).collect()}
    assert all((judged[i] == "base") == base_statistics(t)[5] for i, t in texts)
    assert names == {i for i, r in judged.items() if r is None}
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    assert all(judged[i] in (None, "base") for i in good)

    one = stages["n-gram Jaccard join"](spark, clean, SF).cache()
    left = [(i, t) for i, t in texts if i in names]
    assert {r.doc_id for r in one.collect()} == {c for _, n, c in brute_components(left) if n} | {int(i) for i, n, _ in brute_components(left) if not n}

    cut = stages["suffix-array dedup"](spark, one, SF).cache()
    rest = [(r.doc_id, r.text) for r in one.collect()]
    want = {i: sha for i, gone, _, sha in brute_removal(rest, suffix_dedup.SHORT) if not gone}
    got = {str(r.doc_id): hashlib.sha256(r.text.encode()).hexdigest() for r in cut.collect()}
    assert all(got[i] == sha for i, sha in want.items()) and cut.columns == docs.columns

    drawn = stages["mixing sources to target weights"](spark, cut, SF).cache()
    assert {r.doc_id for r in drawn.collect()} == {r.doc_id for r in mixing.mixed(cut).filter("__sampled").collect()}
    packed = stages["packing"](spark, drawn, SF)
    sums = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id for r in sums} == {r.doc_id for r in drawn.collect()} and all(r.n == r.m for r in sums)
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_stages_take_any_rows(spark, docs, empty):
    """Nulls, blanks, repeated rows and clashing columns pass every stage; an empty table stays empty."""
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, SF), stage(spark, empty, SF)
        assert none.count() == 0 and out.count() > 0
        if name != "packing":
            assert out.columns == docs.columns == none.columns
