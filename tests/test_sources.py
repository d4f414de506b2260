"""Line formats, hashed vectors, codes and the bootstrap against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph import plans
from evigraph.functions import embed
from evigraph.functions.encode import predictive_codes
from evigraph.sources import lines


def test_bad_lines_are_set_apart(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("﻿a\t1,2\t3\t4\troot\n# note\n\nb\t1,x\t3\t4\tnode\nc\t1\t3\n", encoding="utf-8")
    good, bad = lines.nodes(spark, str(tmp_path / "x.tsv"))
    assert [(r.content, r.vec, r.root) for r in good.collect()] == [("a", [1.0, 2.0], True)]
    assert sorted(r.value[0] for r in bad.collect()) == ["b", "c"]


def test_torn_and_open_transactions_are_left_out(spark, tmp_path):
    rows = ["BEGIN\t1", "PUT\t1\tx|y", "COMMIT\t1", "BEGIN\t2", "PUT\t2\tz"]
    framed = [r.v for r in spark.createDataFrame([(r,) for r in rows], "p string").select(lines.frame(F.col("p")).alias("v")).collect()]
    (tmp_path / "log").write_text("\n".join([*framed, framed[0][:-2]]))
    good, bad = lines.replay(spark, str(tmp_path / "log"))
    assert [(r.txid, r.op, r.rest) for r in good.collect()] == [(1, "PUT", "x|y")] and bad.count() == 1


def test_hashed_vectors(spark):
    texts = ["", "a b a", "Über, uns!", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(embed.embed_bytes(F.col("t"), 8).alias("b"), embed.embed_words(F.col("t"), 24).alias("w")).collect()
    for t, r in zip(texts, got, strict=True):
        v, h = [0] * 8, 1469598103934665603
        for b in (t or "").encode():
            h = (h ^ b) * 1099511628211 % 2**64
            v[h % 8] += 1 if h >> 8 & 1 else -1
        n = sum(x * x for x in v) ** 0.5
        assert r.b == pytest.approx([x / n if n else 0 for x in v], abs=1e-6)
        if t == "a b a":
            w = [0] * 24
            for word in t.split():
                h = (1469598103934665603 ^ ord(word)) * 1099511628211 % 2**64
                w[h % 24] += 1 if h & 1 else -1
            assert r.w == pytest.approx([x / sum(y * y for y in w) ** 0.5 for x in w])


def test_codes_follow_the_vectors():
    x = np.cumsum(np.random.default_rng(1).normal(size=(64, 16)), 0)
    codes, decoded, wide = predictive_codes(x)
    assert wide == (codes == -128).sum() and 0 < wide < 64 * 16 * 0.05 and np.abs(decoded - x).max() < 0.05
    assert (decoded[codes == -128] == x[codes == -128]).all()


def test_bootstrap_covers_the_difference(spark):
    pairs = spark.range(400).select((F.col("id") % 2).alias("control"), (F.col("id") % 4 > 0).cast("int").alias("treatment"))
    r = plans.evaluation.paired_bootstrap(pairs, resamples=400).first()
    assert r.delta == 0.25 and 0.15 < r.ci_low < 0.25 < r.ci_high < 0.35


def test_one_fault_refuses_a_batch(spark):
    nodes = spark.createDataFrame([(1, 1), (2, 2)], "id bigint, cell bigint")
    one = lambda *rows: spark.createDataFrame(list(rows), "id bigint, cell bigint")
    gone, links = spark.createDataFrame([(2,)], "id bigint"), spark.createDataFrame([(9, 1)], "src bigint, dst bigint")
    good = plans.ingest.apply_batch(nodes, gone, one((9, 2)), links, 10).collect()
    assert sorted((r.kind, r.version) for r in good if r.version) == [("delete", 11), ("put", 12)] and {r.outcome for r in good} == {"applied"}
    bad = plans.ingest.apply_batch(nodes, gone, one((9, 1)), links, 10).collect()
    assert {(r.kind, r.outcome) for r in bad} == {("delete", "refused"), ("put", "fault"), ("link", "refused")}
