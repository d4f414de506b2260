"""Each registered query of the library against its SQL in DuckDB on the smallest tables; hand-made cases for the quirks."""

import glob
import math
import os

import pytest
from pyspark.sql import functions as F

from evigraph import plans, registry
from evigraph.functions import scalar as S
from evigraph.operators import retrieve

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}") if v else 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, (int, str, bool)) else (float(v) if hasattr(v, "as_integer_ratio") else str(v))


@pytest.fixture(scope="module", autouse=True)
def shared_paths():
    """Path expansion and weighing are the same for many queries: done once here."""
    held, swaps = {}, []

    def once(module, name, key):
        real = getattr(module, name)

        def run(*args):
            k = (name, key(*args))
            if k not in held:
                held[k] = (real(*args), args)  # the arguments are kept, so that ids stay taken
            return held[k][0]

        swaps.append((module, name, real))
        setattr(module, name, run)

    once(plans.reasoning, "symptom_paths", lambda spark, d: d)
    for module in (plans.fibers, plans.dialectic):
        swaps.append((module, "symptom_paths", module.symptom_paths))
        module.symptom_paths = plans.reasoning.symptom_paths
    once(plans.critic, "rows", lambda spark, d: d)
    once(plans.critic, "heads_of", lambda spark, d: d)
    yield
    for module, name, real in swaps:
        setattr(module, name, real)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(registry.ORACLES[name])
    names = [x[0] for x in res.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert sorted(names) == cols and got == want


def test_empty_signatures_differ(spark):
    row = spark.range(1).select(S.matches_plane(F.lit(5).cast("bigint"), F.lit(0).cast("bigint")).alias("a"), S.matches_signature(F.lit(5).cast("bigint"), F.lit(0).cast("bigint")).alias("b")).first()
    assert (row.a, row.b) == (False, True)


def test_hash_is_that_of_a_loop(spark):
    for text in ("", "a", "root cause", "é😀"):
        h = 1469598103934665603
        for b in text.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        assert spark.range(1).select(S.fnv1a(F.lit(text)).alias("h")).first().h % 2**64 == h


def test_root_wins_at_once_and_ties_go_to_least_edges(spark):
    nodes = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False)], "id bigint, root boolean")
    edges = spark.createDataFrame([(7, 1, 3, 0.5), (5, 2, 3, 0.9), (8, 3, 4, 1.0), (9, 4, 3, 1.0)], "edge_id bigint, src bigint, dst bigint, confidence double")
    got = {r.anchor: (r.root, r.depth, r.rev_edges, r.score) for r in retrieve.reverse_roots(spark.createDataFrame([(1,), (3,), (4,)], "anchor bigint"), edges, nodes).collect()}
    assert got == {1: (1, 0, [], 1.0), 3: (2, 1, [5], 0.9), 4: (2, 2, [8, 5], 0.9)}


def test_spiral_walks_rings(spark):
    q, r = S.hex_spiral(F.col("id"))
    got = [(x.q, x.r) for x in spark.range(37).select("id", q.alias("q"), r.alias("r")).orderBy("id").collect()]
    want = [(0, 0)]
    for ring in (1, 2, 3):
        at = (ring, 0)
        for dq, dr in ((0, -1), (-1, 0), (-1, 1), (0, 1), (1, 0), (1, -1)):
            for _ in range(ring):
                want.append(at)
                at = (at[0] + dq, at[1] + dr)
    assert got == want
