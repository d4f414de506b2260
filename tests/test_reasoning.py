"""Hand-made cases of path expansion, process steps and the critic's energy."""

from pyspark.sql import functions as F

from evigraph.functions import governance as G
from evigraph.operators import expand, process

EVENT = "episode bigint, event_id bigint, step int, family string, kind string, bears_on string, independent boolean, decisive boolean, revokes bigint"


def test_support_ends_with_its_revocation(spark):
    rows = [(1, 10, 1, "a", "support", "H1", True, False, None), (1, 11, 2, "a", "support", "H1", True, False, None), (1, 12, 3, "b", "support", "H1", False, False, None)]
    rows += [(1, 13, 4, "c", "revoke", "H1", True, True, 10), (1, 14, 5, "c", "revoke", "H1", True, False, 11), (1, 15, 6, "c", "revoke", "H1", True, False, 13)]
    events = spark.createDataFrame(rows, EVENT)
    got = [(r.step, r.families, r.refuted) for r in process.step_support(events).orderBy("step").collect()]
    assert got == [(1, 1, False), (2, 1, False), (3, 1, False), (4, 1, True), (5, 0, True), (6, 0, False)]
    assert [r.active for r in process.active_count(events).orderBy("step").collect()] == [1, 2, 3, 3, 3, 3]


def test_no_events(spark):
    empty = spark.createDataFrame([], EVENT)
    assert process.step_support(empty).count() == process.active_count(empty).count() == 0


def test_paths_stop_at_roots_and_skip_cycles(spark):
    nodes = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False)], "id bigint, root boolean")
    edges = spark.createDataFrame([(7, 1, 3, 0.5, "causal"), (5, 2, 1, 0.9, "causal"), (8, 3, 4, 1.0, "contradicts"), (9, 4, 3, 1.0, "causal"), (6, 2, 4, 0.4, "causal")], "edge_id bigint, src bigint, dst bigint, confidence double, role string")
    anchors = spark.createDataFrame([(4,)], "anchor bigint")
    got = sorted((r.at, tuple(r.edges), r.score, r.contra) for r in expand.evidence_paths(anchors, nodes, edges, 4).collect())
    assert got == [(1, (8, 7), 0.5, True), (2, (6,), 0.4, False)]
    ahead = sorted((r.at, tuple(r.edges)) for r in expand.forward_arrivals(spark.createDataFrame([(2,)], "anchor bigint"), edges, 3).collect())
    # Two edges reach 3 at depth two, and only the first of them, by 1, goes on.
    assert ahead == [(1, (5,)), (3, (5, 7)), (3, (6, 9)), (4, (5, 7, 8)), (4, (6,))]


def test_floors_of_energy(spark):
    def energy(**errors):
        return spark.range(1).select(G.energy({k: F.lit(float(errors.get(k, 0))) for k in G.ENERGY_WEIGHTS}).alias("e")).first().e

    assert energy() == 0
    assert abs(energy(contradiction=0.5) - 0.65) < 1e-12
    assert abs(energy(retrieval_noise=1) - 0.5) < 1e-12
    assert energy(relevance=0.6) == 0.45
    assert abs(energy(**dict.fromkeys(G.ENERGY_WEIGHTS, 1)) - 1) < 1e-9
