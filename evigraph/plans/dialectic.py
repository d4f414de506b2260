"""The path-level form of convergence and opposition, hypotheses, outside checks of paths and joint causes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evigraph import project as P
from evigraph.functions.scalar import clamp
from evigraph.operators import expand, retrieve
from evigraph.plans.basics import COS, visible
from evigraph.plans.evidence import FINDINGS, findings
from evigraph.plans.reasoning import BUDGET, EXPAND, HOPS, symptom_paths
from evigraph.project import duck
from evigraph.registry import query
from evigraph.shared import materialize

#: Least confidence of an answer, paths shown with it, opposition that widens the search or contests.
CONFIDENCE, MOST_SELECTED, REOPEN, CONTESTED, MOST_ROUNDS = 0.45, 4, 0.25, 0.50, 2
SHOWN = 16


@query("causal_root_score", duck("SELECT at_ AS root, count(*) AS degeneracy, round(greatest(0, least(1, 0.35 * least(1, count(*) / 3) + 0.25 * least(1, len(list_distinct(flatten(list(edges)))) / count(*) / 4) - 0.25 * avg(contra::INT) + sum(score) / count(*))), 9) AS confidence FROM found GROUP BY at_", EXPAND, recursive=True))
def causal_root_score(spark, d):
    n, one = F.count("*"), F.lit(1.0)
    distinct = F.size(F.array_distinct(F.flatten(F.collect_list("edges"))))
    score = 0.35 * F.least(one, n / 3) + 0.25 * F.least(one, distinct / n / 4) - 0.25 * F.avg(F.col("contra").cast("int")) + F.sum("score") / n
    return symptom_paths(spark, d)[0].groupBy(F.col("at").alias("root")).agg(n.alias("degeneracy"), F.round(clamp(score), 9).alias("confidence"))


ROOTS = [
    f"f AS (SELECT edge_id, source_id = '' AND origin IN ('observed', 'discovered') AS missing, source_id = '' AS lost, len(list_filter([{FINDINGS}], lambda z: z IS NOT NULL)) AS faults FROM ve)",
    """rb AS (SELECT anchor, root, degeneracy, contra, risk, covered, round(greatest(0, least(1, 0.60 * mean + 0.15 * least(1, degeneracy / 3) + 0.10 * least(1, distinct_edges / degeneracy / 3) + 0.10 * covered - 0.20 * contra - 0.15 * risk)), 9) AS confidence
 FROM (SELECT anchor, at_ AS root, count(*) AS degeneracy, avg(score) AS mean, avg(contra::INT) AS contra FROM found GROUP BY ALL)
 JOIN (SELECT anchor, at_ AS root, count(DISTINCT edge_id) AS distinct_edges, 1 - count(*) FILTER (missing) / count(*)::DOUBLE AS covered, least(1, sum(faults) / count(*)::DOUBLE) AS risk FROM (SELECT anchor, at_, unnest(edges) AS edge_id FROM found) JOIN f USING (edge_id) GROUP BY ALL) USING (anchor, root)),
pl AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY confidence DESC, root) AS place, count(*) OVER (PARTITION BY anchor) AS roots FROM rb)""",
    f"tc AS (SELECT anchor, sum(len(edges)) > {BUDGET} AS truncated, count(*) AS paths FROM found GROUP BY anchor)",
    "cv AS (SELECT pl.*, truncated, paths, confidence >= 0.45 AS has_answer FROM pl JOIN tc USING (anchor) WHERE place = 1)",
]


def root_bundles(found, e):
    """(anchor, root, degeneracy, contra, risk, covered, confidence) of every root an anchor's paths end at."""
    by = ["anchor", F.col("at").alias("root")]
    whole = found.groupBy(*by).agg(F.count("*").alias("degeneracy"), F.avg("score").alias("mean"), F.avg(F.col("contra").cast("int")).alias("contra"))
    lost = (F.col("source_id") == "") & F.col("origin").isin("observed", "discovered")
    marks = e.select("edge_id", lost.alias("missing"), F.size(findings()).alias("faults"))
    steps = found.select(*by, F.explode("edges").alias("edge_id")).join(marks, "edge_id").groupBy("anchor", "root")
    steps = steps.agg(F.count_distinct("edge_id").alias("distinct_edges"), (1 - F.count_if("missing") / F.count("*")).alias("covered"), F.least(F.lit(1.0), F.sum("faults") / F.count("*")).alias("risk"))
    one, c = F.lit(1.0), F.col
    score = 0.60 * c("mean") + 0.15 * F.least(one, c("degeneracy") / 3) + 0.10 * F.least(one, c("distinct_edges") / c("degeneracy") / 3) + 0.10 * c("covered") - 0.20 * c("contra") - 0.15 * c("risk")
    return whole.join(steps, ["anchor", "root"]).withColumn("confidence", F.round(clamp(score), 9))


def converged(found, e):
    """The leading root of each anchor."""
    w = Window.partitionBy("anchor")
    ranked = root_bundles(found, e).withColumns({"place": F.row_number().over(w.orderBy(F.desc("confidence"), "root")), "roots": F.count("*").over(w)})
    size = found.groupBy("anchor").agg((F.sum(F.size("edges")) > BUDGET).alias("truncated"), F.count("*").alias("paths"))
    return ranked.filter("place = 1").join(size, "anchor").withColumn("has_answer", F.col("confidence") >= CONFIDENCE)


def doubts():
    """Names of what stays uncertain about a converged row."""
    return F.concat_ws(",", F.when(F.col("contra") > 0, "contradictory_paths"), F.when(F.col("risk") > 0, "provenance_risk"), F.when(F.col("roots") > 1, "competing_roots"), F.when(F.col("truncated"), "budget_reached"), F.when(~F.col("has_answer"), "low_confidence"))


_DOUBTS = "concat_ws(',', CASE WHEN contra > 0 THEN 'contradictory_paths' END, CASE WHEN risk > 0 THEN 'provenance_risk' END, CASE WHEN roots > 1 THEN 'competing_roots' END, CASE WHEN truncated THEN 'budget_reached' END, CASE WHEN NOT has_answer THEN 'low_confidence' END)"


@query("dialectic_converge", duck(f"SELECT anchor, root AS primary_node, confidence, has_answer, least(degeneracy, {MOST_SELECTED}) AS selected, paths - least(degeneracy, {MOST_SELECTED}) AS discarded, {_DOUBTS} AS doubts FROM cv", EXPAND, *ROOTS, recursive=True))
def dialectic_converge(spark, d):
    shown = F.least("degeneracy", F.lit(MOST_SELECTED))
    return converged(*symptom_paths(spark, d)).select("anchor", F.col("root").alias("primary_node"), "confidence", "has_answer", shown.alias("selected"), (F.col("paths") - shown).alias("discarded"), doubts().alias("doubts"))


def opposed(rows):
    """Claims challenged and nodes to reopen of converged rows: the leading root in some cases, the others if they compete."""
    c = F.col
    weak = (c("risk") > 0) | (c("covered") < 1)
    tests = [~c("has_answer"), c("contra") > 0, weak, c("degeneracy") < 2, c("roots") > 1, c("truncated")]
    claims = sum(t.cast("int") for t in tests)
    primary = (tests[0] | tests[1] | tests[2] | tests[3] | tests[5]).cast("int")
    reopen = primary + F.when((c("roots") > 1) | ~c("has_answer"), c("roots") - 1).otherwise(0)
    score = F.round(clamp(0.18 * claims + 0.04 * reopen), 9)
    return rows.withColumns({"claims": claims, "reopen": reopen, "score": score}).withColumn("again", (F.col("score") >= REOPEN) & (F.col("reopen") > 0))


OPPOSED = """ob AS (SELECT *, round(least(1, 0.18 * claims + 0.04 * reopen), 9) AS score FROM (SELECT *, (NOT has_answer)::INT + (contra > 0)::INT + (risk > 0 OR covered < 1)::INT + (degeneracy < 2)::INT + (roots > 1)::INT + truncated::INT AS claims,
 (NOT has_answer OR contra > 0 OR risk > 0 OR covered < 1 OR degeneracy < 2 OR truncated)::INT + CASE WHEN roots > 1 OR NOT has_answer THEN roots - 1 ELSE 0 END AS reopen FROM cv))"""


@query("dialectic_oppose", duck("SELECT anchor, claims, reopen, score, score >= 0.25 AND reopen > 0 AS again FROM ob", EXPAND, *ROOTS, OPPOSED, recursive=True))
def dialectic_oppose(spark, d):
    return opposed(converged(*symptom_paths(spark, d))).select("anchor", "claims", "reopen", "score", "again")


def status():
    return F.when(~F.coalesce("has_answer", F.lit(False)), "abstain").when(F.col("score") >= CONTESTED, "contested").when((doubts() != "") | (F.col("score") > 0), "provisional").otherwise("supported")


@query("dialectic_reason")
def dialectic_reason(spark, d):
    """Converge and oppose; where opposition asks for it, expand a hop further, twice at most. Anchors without a root abstain."""
    n, e = visible(spark, d)
    active, done = n.filter("symptom").select(F.col("id").alias("anchor")), None
    for k in range(MOST_ROUNDS + 1):
        active = materialize(active)
        if k and active.isEmpty():
            break
        found = expand.evidence_paths(active, n, e, HOPS + k)
        state = materialize(active.join(opposed(converged(found, e)), "anchor", "left").select("anchor", F.col("root").alias("primary_node"), F.coalesce(status(), F.lit("abstain")).alias("status"), F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(k).alias("rounds"), F.coalesce("again", F.lit(False)).alias("again")))
        ended = state.filter(~F.col("again") | F.lit(k == MOST_ROUNDS)).drop("again")
        done = ended if done is None else done.unionByName(ended)
        active = state.filter("again").select("anchor")
    return done


@query(
    "hypotheses",
    duck(
        f"""SELECT anchor, node, plausibility, supported FROM (SELECT anchor, root AS node, confidence AS plausibility, true AS supported FROM pl WHERE place <= {SHOWN}
 UNION ALL SELECT query_id, node_id, 0, false FROM (SELECT a.id AS query_id, b.id AS node_id, row_number() OVER (PARTITION BY a.id ORDER BY {COS} DESC, b.id) AS rank FROM vn a, vn b WHERE a.symptom AND a.id NOT IN (SELECT anchor FROM pl)) WHERE rank <= 3)""",
        EXPAND,
        *ROOTS,
        recursive=True,
    ),
)
def hypotheses(spark, d):
    """Roots as proposals, never as truths; an anchor without roots gets its nearest nodes at plausibility zero."""
    n, e = visible(spark, d)
    found = symptom_paths(spark, d)[0]
    w = Window.partitionBy("anchor").orderBy(F.desc("confidence"), "root")
    roots = root_bundles(found, e).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= SHOWN)
    roots = roots.select("anchor", F.col("root").alias("node"), F.col("confidence").alias("plausibility"), F.lit(True).alias("supported"))
    loose = n.filter("symptom").join(found.select(F.col("anchor").alias("id")), "id", "left_anti").select(F.col("id").alias("query_id"), "vec")
    near = retrieve.knn(n, loose, 3).select(F.col("query_id").alias("anchor"), F.col("node_id").alias("node"), F.lit(0.0).alias("plausibility"), F.lit(False).alias("supported"))
    return roots.unionByName(near)


_VERDICT = "CASE WHEN (anchor + at_) % 5 = 0 THEN 'contradicted' WHEN (anchor + at_) % 5 < 3 THEN 'verified' ELSE 'unverified' END"


def tighten(paths, verdicts):
    """Paths with an outside check's figures: qualities only fall, and a status becomes better than open only if nobody
    disagrees; ``verdicts`` has v_relevance, v_consistency, v_completeness, v_status by path."""
    c = F.col
    out = paths.join(verdicts, "path", "left")
    kept = {k: F.least(clamp(c(k)), clamp(F.coalesce(c(f"v_{k}"), F.lit(1.0)))) for k in ("relevance", "consistency", "completeness")}
    new = F.coalesce("v_status", F.lit("unverified"))
    status = (
        F.when((c("status") == "contradicted") | (new == "contradicted"), "contradicted")
        .when(c("status") == "unverified", new)
        .when((new == "unverified") | (new == c("status")), c("status"))
        .otherwise("unverified")
    )
    return out.withColumns(kept | {"status": status}).drop("v_relevance", "v_consistency", "v_completeness", "v_status")


@query(
    "verifier_tighten",
    duck(
        f"""SELECT path, least(1, relevance) AS relevance, 0.9e0 AS consistency, completeness, CASE WHEN 'contradicted' IN (own, v) THEN 'contradicted' WHEN own = 'unverified' THEN v WHEN v = 'unverified' OR v = own THEN own ELSE 'unverified' END AS status
 FROM (SELECT array_to_string(edges, ',') AS path, (anchor % 10) / 10e0 AS relevance, CASE WHEN at_ % 2 = 0 THEN 0.5e0 ELSE 0.8e0 END AS completeness, CASE WHEN anchor % 3 = 0 THEN 'not_applicable' ELSE 'unverified' END AS own, {_VERDICT} AS v FROM found)""",
        EXPAND,
        recursive=True,
    ),
)
def verifier_tighten(spark, d):
    rows = symptom_paths(spark, d)[0].select(F.array_join("edges", ",").alias("path"), "anchor", "at")
    i = (F.col("anchor") + F.col("at")) % 5
    own = rows.select("path", F.lit(1.2).alias("relevance"), F.lit(0.9).alias("consistency"), F.lit(0.8).alias("completeness"), F.when(F.col("anchor") % 3 == 0, "not_applicable").otherwise("unverified").alias("status"))
    verdict = F.when(i == 0, "contradicted").when(i < 3, "verified").otherwise("unverified")
    said = rows.select("path", ((F.col("anchor") % 10) / 10.0).alias("v_relevance"), F.lit(1.0).alias("v_consistency"), F.when(F.col("at") % 2 == 0, 0.5).otherwise(2.0).alias("v_completeness"), verdict.alias("v_status"))
    return tighten(own, said)


#: Member edges of joint causes by an integer rule: three sources for every tenth node, above the ids of plain edges.
MEMBERS = "jm AS (SELECT 1000000000 + id AS edge_id, id // 10 AS grp, id AS src, (id // 10) * 10 + 3 AS dst, (60 + id % 40) / 100e0 AS confidence FROM vn WHERE id % 10 < 3)"
JOINT = f"""jg AS (SELECT dst, list_sort(list(src)) AS needs, list_sort(list(edge_id)) AS ids, pow(product(confidence), 1 / 3e0) AS c FROM jm GROUP BY grp, dst HAVING count(*) = 3),
hp AS (SELECT dst AS at_, src AS to_, [edge_id] AS ids, [src] AS needs, confidence AS c, role = 'contradicts' AS against FROM ve UNION ALL SELECT dst, unnest(needs), ids, needs, c, false FROM jg),
jx AS (SELECT id AS anchor, id AS at_, [id] AS nodes, []::BIGINT[] AS edges, 1.0::DOUBLE AS score, false AS contra, root, 0 AS depth FROM vn WHERE symptom
 UNION ALL SELECT x.anchor, h.to_, list_append(x.nodes, h.to_), list_concat(x.edges, h.ids), x.score * h.c, x.contra OR h.against, p.root, x.depth + 1 FROM jx x JOIN hp h ON h.at_ = x.at_ JOIN vn p ON p.id = h.to_ WHERE NOT x.root AND x.depth < {HOPS} AND NOT list_has_any(x.nodes, h.needs))"""


@query("evidence_expand_joint", duck("SELECT anchor, at_ AS root, array_to_string(edges, ',') AS rev_edges, round(score, 9) AS score, contra FROM jx WHERE root", MEMBERS, JOINT, recursive=True))
def evidence_expand_joint(spark, d):
    n, e = visible(spark, d)
    i = F.col("id")
    ten = F.floor(i / 10)
    members = P.nodes(spark, d).filter(i % 10 < 3).select((i + 1_000_000_000).alias("edge_id"), ten.alias("group"), i.alias("src"), (ten * 10 + 3).alias("dst"), ((60 + i % 40) / 100.0).alias("confidence"), F.lit("causal").alias("role"), F.lit(3).alias("arity"))
    found = expand.joint_paths(n.filter("symptom").select(i.alias("anchor")), n, e, members, HOPS)
    return found.select("anchor", F.col("at").alias("root"), F.array_join("edges", ",").alias("rev_edges"), F.round("score", 9).alias("score"), "contra")
