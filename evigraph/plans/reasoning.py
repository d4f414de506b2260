"""Path expansion, critic energy, corrective plans, governed status and process metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evigraph.functions import governance as G
from evigraph.operators import expand, process
from evigraph.plans.basics import visible
from evigraph.plans.evidence import FINDINGS, findings
from evigraph.project import duck, table
from evigraph.registry import query

HOPS, FORWARD_HOPS, BUDGET, LATEST = 4, 3, 6, 5
#: States a search looks at and paths it finds, where a query holds them low.
VISITS, PATHS = 9, 2

EXPAND = f"""x AS (SELECT id AS anchor, id AS at_, [id] AS nodes, []::BIGINT[] AS edges, 1.0::DOUBLE AS score, false AS contra, root FROM vn WHERE symptom
 UNION ALL SELECT x.anchor, e.src, list_append(x.nodes, e.src), list_append(x.edges, e.edge_id), x.score * e.confidence, x.contra OR e.role = 'contradicts', p.root FROM x JOIN ve e ON e.dst = x.at_ JOIN vn p ON p.id = e.src WHERE NOT x.root AND len(x.edges) < {HOPS} AND NOT list_contains(x.nodes, e.src)),
found AS (SELECT * FROM x WHERE root)"""


def symptom_paths(spark, d):
    n, e = visible(spark, d)
    return expand.evidence_paths(n.filter("symptom").select(F.col("id").alias("anchor")), n, e, HOPS), e


@query("evidence_expand", duck("SELECT anchor, at_ AS root, array_to_string(edges, ',') AS rev_edges, round(score, 9) AS score, contra FROM found", EXPAND, recursive=True))
def evidence_expand(spark, d):
    return symptom_paths(spark, d)[0].select("anchor", F.col("at").alias("root"), F.array_join("edges", ",").alias("rev_edges"), F.round("score", 9).alias("score"), "contra")


@query(
    "expansion_budget",
    duck(
        f"SELECT anchor, count(*) FILTER (root AND rn <= {VISITS} AND ended <= {PATHS}) AS kept, bool_or(rn > {VISITS} OR ended - root::INT >= {PATHS}) AS truncated FROM (SELECT anchor, root, row_number() OVER w AS rn, sum(root::INT) OVER w AS ended FROM x WINDOW w AS (PARTITION BY anchor ORDER BY len(edges), edges ROWS UNBOUNDED PRECEDING)) GROUP BY anchor",
        EXPAND,
        recursive=True,
    ),
)
def expansion_budget(spark, d):
    """Paths of each anchor that a search finds before it has looked at so many states or found so many paths."""
    n, e = visible(spark, d)
    anchors = n.filter("symptom").select(F.col("id").alias("anchor"))
    found, cut = expand.budgeted(anchors, n, e, HOPS, VISITS, PATHS)
    out = anchors.join(found.groupBy("anchor").agg(F.count("*").alias("kept")), "anchor", "left").join(cut.withColumn("truncated", F.lit(True)), "anchor", "left")
    return out.select("anchor", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("truncated", F.lit(False)).alias("truncated"))


@query(
    "root_bundle_stats",
    duck(
        """SELECT root, degeneracy, distinct_edges, round(greatest(0, least(1, 0.60 * mean + 0.15 * least(1, degeneracy / 3) + 0.10 * least(1, distinct_edges / degeneracy / 3) + 0.10 * (1 - missing / steps) - 0.20 * contra - 0.15 * least(1, faults / steps))), 9) AS confidence
 FROM (SELECT at_ AS root, count(*) AS degeneracy, avg(score) AS mean, avg(contra::INT) AS contra FROM found GROUP BY at_)
 JOIN (SELECT at_ AS root, count(DISTINCT edge_id) AS distinct_edges, count(*) AS steps, count(*) FILTER (lost) AS missing, sum(faults) AS faults FROM (SELECT at_, unnest(edges) AS edge_id FROM found) JOIN f USING (edge_id) GROUP BY at_) USING (root)""",
        EXPAND,
        f"f AS (SELECT edge_id, source_id = '' AS lost, len(list_filter([{FINDINGS}], lambda z: z IS NOT NULL)) AS faults FROM ve)",
        recursive=True,
    ),
)
def root_bundle_stats(spark, d):
    paths, e = symptom_paths(spark, d)
    whole = paths.groupBy("at").agg(F.count("*").alias("degeneracy"), F.avg("score").alias("mean"), F.avg(F.col("contra").cast("int")).alias("contra"))
    marks = e.select("edge_id", (F.col("source_id") == "").alias("lost"), F.size(findings()).alias("faults"))
    steps = paths.select("at", F.explode("edges").alias("edge_id")).join(marks, "edge_id").groupBy("at")
    steps = steps.agg(F.count_distinct("edge_id").alias("distinct_edges"), F.count("*").alias("steps"), F.count_if("lost").alias("missing"), F.sum("faults").alias("faults"))
    one, n = F.lit(1.0), F.col("degeneracy")
    score = 0.60 * F.col("mean") + 0.15 * F.least(one, n / 3) + 0.10 * F.least(one, F.col("distinct_edges") / n / 3) + 0.10 * (1 - F.col("missing") / F.col("steps")) - 0.20 * F.col("contra") - 0.15 * F.least(one, F.col("faults") / F.col("steps"))
    return whole.join(steps, "at").select(F.col("at").alias("root"), "degeneracy", "distinct_edges", F.round(G.clamp(score), 9).alias("confidence"))


@query(
    "forward_bundle",
    duck(
        "SELECT anchor, at_ AS target, count(*) AS degeneracy, round(max(score), 9) AS best_confidence, bool_or(contra) AS has_contradiction FROM y WHERE depth > 0 GROUP BY anchor, at_",
        f"""y AS (SELECT id AS anchor, id AS at_, [id] AS nodes, []::BIGINT[] AS edges, 1.0::DOUBLE AS score, false AS contra, 0 AS depth, 1 AS k FROM vn WHERE root
 UNION ALL SELECT y.anchor, e.dst, list_append(y.nodes, e.dst), list_append(y.edges, e.edge_id), y.score * e.confidence, y.contra OR e.role = 'contradicts', y.depth + 1, row_number() OVER (PARTITION BY y.anchor, e.dst ORDER BY list_append(y.edges, e.edge_id)) FROM y JOIN ve e ON e.src = y.at_ WHERE y.k = 1 AND y.depth < {FORWARD_HOPS} AND NOT list_contains(y.nodes, e.dst))""",
        recursive=True,
    ),
)
def forward_bundle(spark, d):
    n, e = visible(spark, d)
    found = expand.forward_arrivals(n.filter("root").select(F.col("id").alias("anchor")), e, FORWARD_HOPS)
    return found.groupBy("anchor", F.col("at").alias("target")).agg(F.count("*").alias("degeneracy"), F.round(F.max("score"), 9).alias("best_confidence"), F.bool_or("contra").alias("has_contradiction"))


#: Assessments by integer rules (input rows, the same text for both engines).
ASSESSED = """vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 0.2e0 ELSE 0e0 END AS noise, CASE WHEN vec_id % 7 = 0 THEN 0.6e0 ELSE 0e0 END AS material, CASE WHEN vec_id % 3 = 1 THEN 0.4e0 ELSE 0e0 END AS contradiction,
 (vec_id % 11) / 10e0 AS completeness, CASE WHEN vec_id % 13 = 0 THEN 0.3e0 ELSE 0e0 END AS missing, (vec_id % 9) / 8e0 AS support, CASE WHEN vec_id % 6 = 0 THEN 0.5e0 ELSE 1e0 END AS temporal, (vec_id % 10) / 10e0 AS pattern_lock,
 (vec_id % 17) / 16e0 AS diversity, (vec_id % 15) / 14e0 AS provenance, (vec_id % 23) / 22e0 AS energy, CASE WHEN vec_id % 4 = 1 THEN (vec_id % 8) / 8e0 ELSE 0e0 END AS opposition, vec_id % 4 = 0 AS verify, vec_id % 19 = 0 AS abstain, vec_id % 3 = 0 AS theoretical, vec_id % 12 = 0 AS questioned, vec_id % 14 < 10 AS goal_reached,
 vec_id % 8 < 7 AS has_answer, vec_id % 21 = 0 AS blocks, vec_id % 16 = 7 AS tie, vec_id % 9 < 7 AS admissible, vec_id % 5 < 3 AS stable, vec_id % 4 < 3 AS sufficient, CASE vec_id % 4 WHEN 0 THEN 'contradicted' WHEN 1 THEN 'unverified' ELSE 'verified' END AS verification"""


def assessed(spark, d):
    return table(spark, d, "embeddings").selectExpr(*ASSESSED.split(","))  # no item holds a comma


def names(rules: str) -> str:
    return f"SELECT id, array_to_string(list_filter([{rules}], lambda z: z IS NOT NULL), ',') AS tasks FROM (SELECT {ASSESSED} FROM embeddings)"


@query(
    "escape_plan",
    names("""CASE WHEN noise > 0 THEN 'prune_retrieval_noise' END, CASE WHEN material > 0 THEN 'search_contradiction' END, CASE WHEN material > 0 THEN 'generate_falsification_question' END, CASE WHEN completeness < 0.75 OR missing > 0 THEN 'generate_missing_evidence_query' END, CASE WHEN support < 0.75 THEN 'seek_independent_evidence' END,
 CASE WHEN temporal < 1 THEN 'search_temporal_neighbour' END, CASE WHEN pattern_lock > 0.55 AND noise = 0 THEN 'expand_minority_path' END, CASE WHEN verify THEN 'verify_semantic_claim' END, CASE WHEN theoretical AND diversity < 0.5 THEN 'explore_analogy' END, CASE WHEN abstain OR energy > 0.7 THEN 'request_human_evidence' END"""),
)
def escape_plan(spark, d):
    return assessed(spark, d).select("id", G.escape_plan().alias("tasks"))


@query(
    "self_healing",
    names("""CASE WHEN pattern_lock > 0.55 OR diversity < 0.25 THEN 'preserve_minority_path' END, CASE WHEN missing > 0 OR provenance < 0.75 OR completeness < 0.75 THEN 'request_source_evidence' END, CASE WHEN material > 0 OR contradiction > 0 OR opposition >= 0.5 THEN 'mark_contested' END, CASE WHEN temporal < 1 THEN 'search_temporal_window' END,
 CASE WHEN questioned OR NOT goal_reached THEN 'generate_independent_test' END, CASE WHEN noise > 0 THEN 'prune_retrieval_noise' END, CASE WHEN verify THEN 'verify_semantic_claim' END, CASE WHEN abstain THEN 'stop_and_abstain' END"""),
)
def self_healing(spark, d):
    return assessed(spark, d).select("id", G.repair_plan().alias("tasks"))


@query(
    "governed_status",
    f"""SELECT id, CASE WHEN NOT has_answer AND blocks THEN 'contested:material_contradiction_without_earned_replacement' WHEN NOT has_answer AND tie THEN 'open:unresolved_semantic_tie' WHEN NOT has_answer AND missing > 0 THEN 'evidence_required:no_answer_missing_evidence' WHEN NOT has_answer THEN 'abstain:no_answer_abstain'
 WHEN verification = 'contradicted' THEN 'contested:semantic_verification_contradicted' WHEN blocks THEN 'contested:material_contradiction_blocks_resolution' WHEN opposition >= 0.5 THEN 'contested:dialectic_opposition_blocks_resolution'
 WHEN NOT admissible AND (completeness < 0.5 OR provenance < 0.25) THEN 'evidence_required:evidence_incomplete_or_low_provenance' WHEN NOT admissible THEN 'abstain:evidence_not_admissible' WHEN theoretical AND verification = 'unverified' THEN 'speculative:theoretical_claim_unverified'
 WHEN stable AND sufficient AND verification = 'verified' AND opposition = 0 THEN 'resolved:earned_resolution' ELSE 'provisionally_resolved:resolution_conditions_not_fully_earned' END AS status FROM (SELECT {ASSESSED} FROM embeddings)""",
)
def governed_status(spark, d):
    return assessed(spark, d).select("id", G.governed_status().alias("status"))


@query(
    "lyapunov_energy",
    f"""SELECT id, round(least(1, greatest(0.12 * t * t + 0.06 * v * v + 0.12 * p * p + 0.16 * c * c + 0.08 * l * l + 0.08 * missing * missing + 0.08 * k * k + 0.08 * noise * noise, CASE WHEN c > 0 THEN 0.35 + 0.60 * c END, CASE WHEN noise > 0 THEN 0.15 + 0.35 * noise END)), 9) AS energy
 FROM (SELECT *, greatest(0, (0.9 - temporal) / 0.9) AS t, greatest(0, (0.25 - diversity) / 0.25) AS v, greatest(0, (0.75 - provenance) / 0.75) AS p, greatest(0, (0.75 - completeness) / 0.75) AS k, greatest(0, (material - 0.15) / 0.85) AS c, greatest(0, (pattern_lock - 0.55) / 0.45) AS l FROM (SELECT {ASSESSED} FROM embeddings))""",
)
def lyapunov_energy(spark, d):
    """Thresholds are parameters of the query; coordinates without an input are zero."""
    c, zero = F.col, F.lit(0.0)
    errors = dict.fromkeys(G.ENERGY_WEIGHTS, zero) | {
        "temporal": G.lower_deficit(c("temporal"), 0.9),
        "diversity": G.lower_deficit(c("diversity"), 0.25),
        "provenance": G.lower_deficit(c("provenance"), 0.75),
        "completeness": G.lower_deficit(c("completeness"), 0.75),
        "contradiction": G.upper_excess(c("material"), 0.15),
        "pattern_lock": G.upper_excess(c("pattern_lock"), 0.55),
        "missing_evidence": c("missing"),
        "retrieval_noise": c("noise"),
    }
    return assessed(spark, d).select("id", F.round(G.energy(errors), 9).alias("energy"))


STEPS = """t AS (SELECT user_id AS episode, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_type AS family, CASE event_id % 5 WHEN 0 THEN 'refute' WHEN 1 THEN 'revoke' ELSE 'support' END AS kind, 'H' || (event_id % 2 + 1) AS bears_on, event_id % 4 <> 0 AS independent, event_id % 3 = 0 AS decisive, event_id % 6 = 2 AS downgrade,
 CASE WHEN event_id % 5 = 1 THEN lag(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS revokes FROM events),
act AS (SELECT s.episode, s.step AS at_, e.* EXCLUDE (episode) FROM t s JOIN t e ON e.episode = s.episode AND e.step <= s.step WHERE NOT EXISTS (SELECT 1 FROM t r WHERE r.episode = s.episode AND r.revokes = e.event_id AND r.step <= s.step AND r.step > e.step))"""


def steps(spark, d):
    e = table(spark, d, "events")
    w, i = Window.partitionBy("user_id").orderBy("ts", "event_id"), F.col("event_id")
    return e.select(
        F.col("user_id").alias("episode"),
        "event_id",
        F.row_number().over(w).alias("step"),
        F.col("event_type").alias("family"),
        F.when(i % 5 == 0, "refute").when(i % 5 == 1, "revoke").otherwise("support").alias("kind"),
        F.concat(F.lit("H"), (i % 2 + 1).cast("string")).alias("bears_on"),
        (i % 4 != 0).alias("independent"),
        (i % 3 == 0).alias("decisive"),
        (i % 6 == 2).alias("downgrade"),
        F.when(i % 5 == 1, F.lag("event_id", 2).over(w)).alias("revokes"),
    )


@query("active_evidence", f"WITH {STEPS} SELECT episode, at_ AS step, count(*) AS active FROM act GROUP BY episode, at_")
def active_evidence(spark, d):
    return process.active_count(steps(spark, d))


@query(
    "step_support",
    f"""WITH {STEPS} SELECT h.episode, h.bears_on AS hypothesis, s.step, count(DISTINCT a.family) FILTER (a.kind = 'support' AND a.independent) AS families, coalesce(bool_or(a.kind IN ('refute', 'revoke') AND a.decisive), false) AS refuted
 FROM (SELECT DISTINCT episode, bears_on FROM t) h JOIN t s ON s.episode = h.episode LEFT JOIN act a ON a.episode = s.episode AND a.at_ = s.step AND a.bears_on = h.bears_on GROUP BY ALL""",
)
def step_support(spark, d):
    return process.step_support(steps(spark, d))


@query("response_latency", f"WITH {STEPS} SELECT a.episode, a.step, (SELECT min(b.step) - a.step FROM t b WHERE b.episode = a.episode AND b.downgrade AND b.step BETWEEN a.step AND a.step + {LATEST}) AS latency FROM t a WHERE decisive AND kind = 'refute'")
def response_latency(spark, d):
    return process.response_latency(steps(spark, d), LATEST)


@query(
    "quantize_block",
    """SELECT vec_id, list_sum(list_transform(embedding::DOUBLE[], lambda v: round_even((v - lo) / scale, 0)))::BIGINT AS code_sum FROM embeddings
 JOIN (SELECT vec_id // 64 AS b, min(list_min(embedding::DOUBLE[])) AS lo, CASE WHEN max(list_max(embedding::DOUBLE[])) = min(list_min(embedding::DOUBLE[])) THEN 1.0 ELSE (max(list_max(embedding::DOUBLE[])) - min(list_min(embedding::DOUBLE[]))) / 255 END AS scale FROM embeddings GROUP BY 1) ON b = vec_id // 64""",
)
def quantize_block(spark, d):
    """8-bit codes over the range of each block of 64 nodes, rounded half to even."""
    e = table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 64).alias("b"), F.col("embedding").cast("array<double>").alias("v"))
    ends = e.groupBy("b").agg(F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi"))
    scale = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("hi") - F.col("lo")) / 255)
    codes = F.transform("v", lambda x: F.rint((x - F.col("lo")) / scale))
    return e.join(ends, "b").select("vec_id", F.aggregate(codes, F.lit(0.0), lambda s, x: s + x).cast("bigint").alias("code_sum"))


@query("semantic_tie", duck("SELECT max(belief) AS first_belief, min(belief) AS second_belief, max(belief) - min(belief) <= greatest(1e-9, 1e-6 * greatest(abs(max(belief)), abs(min(belief)))) AS tied FROM (SELECT round((1 - exp(-0.7 * count(DISTINCT family) FILTER (role <> 'contradicts'))) * (1 - coalesce(max(confidence) FILTER (role = 'contradicts'), 0)), 9) AS belief FROM ve GROUP BY dst ORDER BY belief DESC LIMIT 2)"))
def semantic_tie(spark, d):
    """Whether the two best targets differ by no more than rounding."""
    own = F.col("role") != "contradicts"
    support = F.count_distinct(F.when(own, F.col("family")))
    against = F.coalesce(F.max(F.when(~own, F.col("confidence"))), F.lit(0.0))
    best = visible(spark, d)[1].groupBy("dst").agg(F.round((1 - F.exp(-0.7 * support)) * (1 - against), 9).alias("belief")).orderBy(F.desc("belief")).limit(2)
    hi, lo = F.max("belief"), F.min("belief")
    return best.agg(hi.alias("first_belief"), lo.alias("second_belief"), (hi - lo <= F.greatest(F.lit(1e-9), 1e-6 * F.greatest(F.abs(hi), F.abs(lo)))).alias("tied"))
