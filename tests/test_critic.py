"""Hand-made cases of weighed paths, groups, target selection, opposition, joint causes and outside checks."""

import math

import pytest
from pyspark.sql import functions as F

from evigraph import plans
from evigraph.operators import critic, expand

PATH = "path string, anchor bigint, root bigint, edges array<bigint>, score double, relevance double, consistency double, contra boolean"
STEP = "path string, source_id string, family string, derivation string, lifecycle string, timely boolean, lost boolean, faults bigint"
TARGET = "anchor bigint, root bigint, families int, supports int, oppositions int, support double, opposition double, belief double, best double, mass double, verified int"


def weighed(spark, steps, contra=False, relevance=1.0):
    paths = [(p, 1, 2, [k, 9], 0.8, relevance, 1.0, contra) for k, p in enumerate(sorted({s[0] for s in steps}))]
    return critic.weigh(spark.createDataFrame(paths, PATH), spark.createDataFrame(steps, STEP))


def test_lost_evidence_and_dead_states_do_not_count(spark):
    steps = [("a", "s1", "f1", "", "active", True, False, 0), ("b", "", "f2", "", "active", True, True, 1), ("c", "s3", "f3", "", "revoked", True, False, 0), ("d", "s4", "f4", "", "active", False, False, 0)]
    got = {r.path: (r.for_it, r.completeness) for r in weighed(spark, steps).collect()}
    assert got == {"a": (True, 1.0), "b": (False, 0.0), "c": (False, 1.0), "d": (False, 0.0)}
    assert weighed(spark, steps, relevance=0.4).filter("kind = 'noise'").count() == 4
    assert weighed(spark, steps, contra=True).filter("against").count() == 1


def test_shared_lineage_is_one_voice(spark):
    steps = [("a", "s1", "f1", "", "active", True, False, 0), ("b", "s1", "f2", "", "active", True, False, 0), ("c", "s3", "f3", "", "active", True, False, 0), ("d", "s4", "f2", "", "active", True, False, 0)]
    rows = weighed(spark, steps)
    heads = critic.representatives(rows)
    assert sorted((r.component, r.paths, r.path) for r in heads.collect()) == [("a", 3, "a"), ("c", 1, "c")]
    found = critic.targets(heads).first()
    assert (found.families, round(found.support, 6)) == (2, 0.96)
    # Edges [0, 9] and [2, 9]: one of three is common.
    assert round(critic.route_diversity(heads).first().diversity, 6) == round(2 / 3, 6)
    score = critic.scores(rows, heads, spark.createDataFrame([(1, False)], "anchor bigint, truncated boolean")).first()
    assert (score.n, score.missing, round(score.support, 6)) == (2, 0.0, round(1 - math.exp(-1.4), 6))
    state = critic.assess(critic.scores(rows, heads, spark.createDataFrame([(1, False)], "anchor bigint, truncated boolean")), "balanced").first()
    assert state.admissible and not state.blocks and 0 <= state.energy <= 1


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(1, 5, 1, 1, 0, 0.6, 0.0, 0.6, 0.6, 0.0, 3)], (5, False)),
        ([(1, 5, 1, 1, 0, 0.6, 0.0, 0.6, 0.6, 0.0, 3), (1, 6, 1, 1, 0, 0.6, 0.0, 0.6, 0.6, 0.0, 3)], (None, True)),
        # Another target has more support and is materially opposed: the believed one needs two families.
        ([(1, 5, 1, 1, 0, 0.6, 0.0, 0.6, 0.6, 0.0, 3), (1, 6, 1, 1, 1, 0.9, 0.8, 0.18, 0.9, 0.8, 3)], (None, False)),
        ([(1, 5, 2, 2, 0, 0.6, 0.0, 0.6, 0.6, 0.0, 3), (1, 6, 1, 1, 1, 0.9, 0.8, 0.18, 0.9, 0.8, 3)], (5, False)),
        ([(1, 5, 1, 1, 0, 0.80, 0.0, 0.80, 0.6, 0.0, 3), (1, 6, 1, 1, 1, 0.9, 0.14, 0.774, 0.9, 0.14, 3)], (6, False)),
    ],
)
def test_selection_keeps_incumbents(spark, rows, want):
    r = critic.select_target(spark.createDataFrame(rows, TARGET)).first()
    assert (r.selected, r.tie) == want


def test_joint_cause_needs_all_sources(spark):
    nodes = spark.createDataFrame([(1, True), (2, False), (3, False)], "id bigint, root boolean")
    edges = spark.createDataFrame([], "edge_id bigint, src bigint, dst bigint, confidence double, role string")
    members = spark.createDataFrame([("g", 10, 1, 3, 0.9, "causal", 2), ("g", 11, 2, 3, 0.4, "causal", 2), ("h", 12, 1, 3, 0.9, "causal", 2), ("h", 13, 8, 3, 0.9, "causal", 2)], "group string, edge_id bigint, src bigint, dst bigint, confidence double, role string, arity int")
    got = expand.joint_paths(spark.createDataFrame([(3,)], "anchor bigint"), nodes, edges, members, 4).collect()
    assert [(r.at, r.edges, round(r.score, 6)) for r in got] == [(1, [10, 11], 0.6)]


def test_checks_only_tighten(spark):
    own = spark.createDataFrame([("a", 0.5, 0.9, 1.0, "unverified"), ("b", 0.5, 0.9, 1.0, "verified"), ("c", 0.5, 0.9, 1.0, "verified")], "path string, relevance double, consistency double, completeness double, status string")
    said = spark.createDataFrame([("a", 0.9, 0.2, 1.0, "verified"), ("b", 1.0, 1.0, 1.0, "not_applicable")], "path string, v_relevance double, v_consistency double, v_completeness double, v_status string")
    got = {r.path: (r.relevance, r.consistency, r.status) for r in plans.dialectic.tighten(own, said).collect()}
    assert got == {"a": (0.5, 0.2, "verified"), "b": (0.5, 0.9, "unverified"), "c": (0.5, 0.9, "verified")}


def test_loop_stops(spark):
    nodes = spark.createDataFrame([(1, True, False), (2, False, True), (3, False, True)], "id bigint, root boolean, symptom boolean")
    edges = spark.createDataFrame([(7, 1, 2, 0.9, "causal", "observed", "s1", "f1", "", "active", "")], "edge_id bigint, src bigint, dst bigint, confidence double, role string, origin string, source_id string, family string, derivation string, lifecycle string, valid_from string")
    got = {r.anchor: (r.paths, r.stop, r.status.split(":")[0]) for r in plans.critic.runtime(nodes, edges, hops=2, rounds=2).collect()}
    assert got[3] == (0, "unchanged", "evidence_required") and got[2][0] == 1 and got[2][1] in ("no_search_requested", "unchanged")
