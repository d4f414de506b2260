"""Bucketed orders, blocks, bounded walks, saved copies, codes and streams against plain loops."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph import plans, project, registry
from evigraph.functions import encode
from evigraph.functions.embed import running_hash_vector
from evigraph.operators import blocks, cells, ranges, retrieve, store, world
from evigraph.streaming import state

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_what_stands_before(spark, monkeypatch):
    """Buckets of four ids, keys with gaps, nulls and a null key, both ways."""
    monkeypatch.setattr(ranges, "WIDTH", 4)
    rng = np.random.default_rng(1)
    data = [(None if k % 11 == 0 else ("a", "b")[int(rng.integers(0, 2))], int(i), None if rng.random() < 0.5 else int(i) * 10) for k, i in enumerate(rng.choice(200, 60, replace=False))]
    rows = spark.createDataFrame(data, "k string, i bigint, v bigint").withColumn("b", ranges.bucket("i"))
    for turn in (False, True):
        got = {(r.k, r.i): (r.last, r.n) for r in ranges.before(rows, ["k"], ["b"], ["i"], {"last": F.col("v")}, count="n", next_=turn).collect()}
        for k, i, _ in data:
            own = sorted((j, v) for q, j, v in data if q == k and (j > i if turn else j < i))
            met = [v for _, v in (own[::-1] if turn else own) if v is not None]
            assert got[k, i] == (met[-1] if met else None, len(own))


def test_following_crosses_buckets(spark, monkeypatch):
    monkeypatch.setattr(ranges, "WIDTH", 3)
    data = [(k % 3 if k % 7 else None, k) for k in range(0, 60) if k % 4]
    got = {r.vec_id: (r.n1, r.n2) for r in project._following(spark.createDataFrame(data, "label int, vec_id bigint")).collect()}
    for label, i in data:
        after = [j for q, j in data if q == label and j > i]
        assert got[i] == (after[0] if after else None, after[1] if len(after) > 1 else None)


def test_blocks_give_all_pairs(spark, monkeypatch):
    """Several blocks on both sides, equal vectors, zero vectors, another length; planes of one and two bits."""
    monkeypatch.setattr(blocks, "NODE_BLOCK", 15)
    monkeypatch.setattr(blocks, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(2)
    vec = [[float(x) for x in rng.integers(-3, 4, 5)] for _ in range(50)]
    vec[7], vec[9], vec[11] = vec[3], [0.0] * 5, [1.0, 2.0]
    sig = [int(1 << rng.integers(0, 4) | 1 << (4 + rng.integers(0, 4))) for _ in range(50)]
    nodes = spark.createDataFrame([(i, v, s, 0.15 * (i % 2)) for i, (v, s) in enumerate(zip(vec, sig))], "id bigint, vec array<double>, signature bigint, boost double")
    asked = spark.createDataFrame([(i, vec[i], sig[i] if i % 3 else 1 << (i % 4)) for i in range(0, 50, 4)], "query_id bigint, vec array<double>, signature bigint")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    near, plane = {}, {}
    for r in blocks.nearest(nodes, asked, 4).collect():
        near.setdefault(r.query_id, []).append((r["rank"], r.node_id))
    found = blocks.in_plane(nodes, asked, 4).collect()
    for r in found:
        plane.setdefault(r.query_id, []).append((-r.rated, r.node_id))
    for q in asked.collect():
        ok = [i for i in range(50) if any(vec[i]) and len(vec[i]) == len(q.vec) and any(q.vec)]
        best = sorted(ok, key=lambda i: (-round(cos(vec[i], q.vec), 12), i))[:4]
        assert [i for _, i in sorted(near.get(q.query_id, []))] == best
        fit = [i for i in ok if (sig[i] & q.signature).bit_count() >= max(1, q.signature.bit_count() - 1)]
        best = sorted(fit, key=lambda i: (-round(cos(vec[i], q.vec) + 0.15 * (i % 2), 9), i))[:4]
        assert [i for _, i in sorted(plane.get(q.query_id, []))][:4] == best
        assert sum(r.met for r in found if r.query_id == q.query_id) == len(fit)


def test_walks_within_a_bound(spark):
    """All roots at once, and a queue for each anchor, give what a plain queue gives; some anchors run out of visits."""
    rng = np.random.default_rng(6)
    edge = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (90, 2)) if a != b})
    edges = spark.createDataFrame([(k, a, b, 0.9, "contradicts" if k % 5 == 0 else "causal") for k, (a, b) in enumerate(edge)], "edge_id bigint, src bigint, dst bigint, confidence double, role string")
    nodes = spark.createDataFrame([(i, i % 13 == 0) for i in range(40)], "id bigint, root boolean")
    anchors = nodes.select(F.col("id").alias("anchor"))
    for most in (100, 6, 2):
        want = {}
        for a in range(40):
            queue, parent = [a], {a: None}
            for k in range(most):
                if k == len(queue):
                    break
                at = end = queue[k]
                if at % 13 == 0:
                    path = []
                    while parent[at] is not None:
                        path.append(parent[at][0])
                        at = parent[at][1]
                    want[a] = (end, path[::-1])
                    break
                for e, (s, d) in enumerate(edge):
                    if d == at and s not in parent:
                        parent[s] = (e, at)
                        queue.append(s)
        rows = retrieve.reverse_roots(anchors, edges, nodes, most).collect()
        assert {r.anchor: (r.root, r.rev_edges) for r in rows} == want
        assert all(r.contra == any(k % 5 == 0 for k in r.rev_edges) and r.nodes[0] == r.anchor and r.nodes[-1] == r.root for r in rows)


def test_damage_is_told(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, v string")
    store.backup({"t": rows}, str(tmp_path / "b"))
    assert sorted(map(tuple, store.restore(spark, str(tmp_path / "b"))["t"].collect())) == [(1, "a"), (2, None)]
    spark.createDataFrame([(1, "a"), (2, "x")], "id bigint, v string").write.mode("overwrite").parquet(str(tmp_path / "b" / "t"))
    with pytest.raises(ValueError, match="damaged"):
        store.restore(spark, str(tmp_path / "b"))
    claims = spark.createDataFrame([(1, "claim", "proposed", "observed", 1)], "id bigint, kind string, status string, origin string, n_evidence int")
    events = world.added(claims, "seen")
    world.save(claims, events, str(tmp_path / "w"))
    assert world.load(spark, str(tmp_path / "w"))[1].count() == 1
    world.save(claims, events.withColumn("reason", F.lit("other")), str(tmp_path / "w"))
    with pytest.raises(ValueError, match="checksum"):
        world.load(spark, str(tmp_path / "w"))
    data = encode.pack_segment([(-5, -1, "né", {"k": "v", "": "k"}), (3, 2**62, "", {})])
    assert encode.unpack_segment(data) == [(-5, -1, "né", {"": "k", "k": "v"}), (3, 2**62, "", {})]
    with pytest.raises(ValueError, match="damaged"):
        encode.unpack_segment(data[:-1] + bytes([data[-1] ^ 1]))


def test_half_floats(spark):
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(0, 10.0 ** rng.integers(-8, 5, 400)), 0.0, 1.0, 65519.9, 65520.0, -1e9, 2.0**-24, 2.0**-25, 1.5 * 2.0**-24]
    got = [r.h for r in spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k int, v double").select("k", encode.half(F.col("v")).alias("h")).orderBy("k").collect()]
    with np.errstate(over="ignore"):
        assert got == x.astype(np.float16).astype(float).tolist()


def test_state_is_carried_over_batches(spark, tmp_path):
    """Updates in three batches give the transitions that one table gives."""
    rng = np.random.default_rng(9)
    names = ["resolved", "contested", "open", "provisionally_resolved"]
    rows = [(int(rng.integers(0, 4)), k, int(rng.integers(1, 4)), bool(rng.random() < 0.8), names[int(rng.integers(0, 4))]) for k in range(90)]
    source = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], state.UPDATE).coalesce(1).write.mode("append").parquet(source)
        out = state.carried(spark.readStream.schema(state.UPDATE).parquet(source))
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    got = state.transitions(spark.read.schema(out.schema).parquet(str(tmp_path / "out")))
    want = state.transitions(state.with_prior(spark.createDataFrame(rows, state.UPDATE)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20


@needs_tables
def test_approximate_neighbours_recall(spark):
    """Of the ten nearest by exact search, nine in ten at least are found, for every query whose id is divisible by 20."""
    sf = "/root/testdata/sf0.01"
    exact = {(r.query_id, r.node_id) for r in registry.QUERIES["vector_knn_join"](spark, sf).collect()}
    near = {(r.query_id, r.node_id) for r in registry.QUERIES["vector_topk_lsh"](spark, sf).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


@needs_tables
def test_hashed_texts_find_what_a_loop_finds(spark):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    nodes = con.execute(project.duck("SELECT id, vec FROM vn ORDER BY id")).fetchall()
    unit = np.array([v for _, v in nodes]) / np.linalg.norm([v for _, v in nodes], axis=1, keepdims=True)
    got = {}
    for r in plans.ingest.hybrid_search(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.node_id))
    for i, text in con.execute("SELECT item_id, text FROM benchmark WHERE item_id % 20 = 0").fetchall():
        s = unit @ np.array(running_hash_vector(text, 64))
        assert [n for _, n in sorted(got[i])] == [nodes[k][0] for k in np.lexsort((np.arange(len(s)), -np.round(s, 9)))[:5]]


@needs_tables
def test_approximate_neighbours_write_no_pairs(spark):
    """What is shuffled is a few times the table, not a row for each query and node."""
    written = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    sf = "/root/testdata/sf0.01"
    before = written()
    assert registry.QUERIES["vector_topk_lsh"](spark, sf).count() == 250
    assert written() - before < 4 * os.path.getsize(f"{sf}/embeddings.parquet")


def test_cells_of_odd_rows(spark, monkeypatch):
    """Copies beyond k, cells in several blocks, zero vectors, nulls, no numbers and other lengths: all cells looked into, the
    best are those of a plain loop."""
    for name, n in (("NODE_BLOCK", 40), ("SMALL_BLOCK", 7), ("QUERY_BLOCK", 9)):
        monkeypatch.setattr(cells, name, n)
    monkeypatch.setattr(cells, "fitted", lambda x, k: 2 * cells.DIRECTIONS)
    rng = np.random.default_rng(3)
    vec = [[float(x) for x in rng.integers(-3, 4, 5)] for _ in range(60)] + [[1.0, 2.0, 0.0, -1.0, 1.0]] * 60
    vec[3], vec[4], vec[5], vec[6], vec[8] = [0.0] * 5, None, [1.0, float("nan"), 1.0, 1.0, 1.0], [1.0, None, 1.0, 1.0, 1.0], [1.0, 2.0]
    rows = spark.createDataFrame(list(enumerate(vec)), "id bigint, vec array<double>").repartition(3)
    found = {}
    for r in cells.near(rows, rows.filter("id % 2 = 0").withColumnRenamed("id", "query_id"), 4, -0.5).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.node_id))
    fit = [i for i, v in enumerate(vec) if v and len(v) and all(x is not None and x == x for x in v) and any(v)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    for q in range(0, 120, 2):
        near = [(-round(cos(vec[i], vec[q]), 12), i) for i in fit if len(vec[i]) == len(vec[q])] if q in fit else []
        assert [i for _, i in sorted(found.get(q, []))] == [i for s, i in sorted(near)[:4] if s <= 0.5]
    assert cells.near(rows.limit(0), rows.withColumnRenamed("id", "query_id"), 4, -0.5).count() == 0
