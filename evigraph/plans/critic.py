"""Weighed paths, correlated groups, the critic's scores, the choice of a target and the governed loop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from evigraph.functions import governance as G
from evigraph.functions import scalar as S
from evigraph.operators import critic, expand
from evigraph.plans.basics import FNV, RFC, visible
from evigraph.plans.evidence import FINDINGS, findings
from evigraph.plans.reasoning import BUDGET, EXPAND, HOPS
from evigraph.project import duck
from evigraph.registry import query
from evigraph.shared import materialize

MODES = ("empirical", "balanced", "theoretical")


def rows_of(anchors, n, e, hops):
    """Weighed paths of the anchors; relevance and consistency by integer rules."""
    found = expand.evidence_paths(anchors, n, e, hops)
    off = F.col("anchor") + F.col("root")
    paths = found.withColumnRenamed("at", "root").select(
        F.array_join("edges", ",").alias("path"),
        "anchor",
        "root",
        "edges",
        F.round("score", 9).alias("score"),
        "contra",
        F.when(off % 7 == 0, 0.4).otherwise(1.0).alias("relevance"),
        F.when((off + 2 * F.col("anchor")) % 11 == 0, 0.45).otherwise(0.9).alias("consistency"),
    )
    paths = materialize(paths)
    lost = (F.col("source_id") == "") & F.col("origin").isin("observed", "discovered")
    timely = (F.col("valid_from") == "") | S.rfc3339(F.col("valid_from")).isNotNull()
    marks = e.select("edge_id", "source_id", "family", "derivation", "lifecycle", lost.alias("lost"), timely.alias("timely"), F.size(findings()).alias("faults"))
    return materialize(critic.weigh(paths, paths.select("path", F.explode("edges").alias("edge_id")).join(marks, "edge_id")))


def symptoms(n):
    return n.filter("symptom").select(F.col("id").alias("anchor"))


def rows(spark, d):
    n, e = visible(spark, d)
    return rows_of(symptoms(n), n, e, HOPS)


def cut(weighed):
    return weighed.groupBy("anchor").agg((F.sum(F.size("edges")) > BUDGET).alias("truncated"))


def scored(weighed, heads):
    return critic.scores(weighed, heads, cut(weighed))


def ranked(heads):
    """Targets with the rank of their outside check by an integer rule: 3 verified, 2 not applicable, 1 open, 0 refuted."""
    return critic.targets(heads).withColumn("verified", (3 - F.col("root") % 4).cast("int"))


def csv(c):
    return F.array_join(c, ",")


FP = [
    f"ef AS (SELECT edge_id, source_id, family, derivation, lifecycle, valid_from = '' OR regexp_matches(valid_from, '{RFC}') AS timely, source_id = '' AND origin IN ('observed', 'discovered') AS lost, len(list_filter([{FINDINGS}], lambda z: z IS NOT NULL)) AS faults FROM ve)",
    """pa AS (SELECT array_to_string(edges, ',') AS path, anchor, at_ AS root, edges, round(score, 9) AS score, contra, CASE WHEN (anchor + at_) % 7 = 0 THEN 0.4e0 ELSE 1e0 END AS relevance, CASE WHEN (3 * anchor + at_) % 11 = 0 THEN 0.45e0 ELSE 0.9e0 END AS consistency FROM found),
ps AS (SELECT path, unnest(edges) AS edge_id FROM pa),
pg AS (SELECT path, count(*) AS n, count(*) FILTER (lost) AS lost, sum(faults)::BIGINT AS faults, bool_and(lifecycle = 'active') AS operative, bool_and(timely) AS timely, coalesce(string_agg(DISTINCT source_id, ',' ORDER BY source_id) FILTER (source_id <> ''), '') AS sources, coalesce(string_agg(DISTINCT family, ',' ORDER BY family) FILTER (family <> ''), '') AS families FROM ps JOIN ef USING (edge_id) GROUP BY path),
wp AS (SELECT *, CASE WHEN relevance < 0.5 OR consistency < 0.5 THEN 'noise' WHEN contra THEN 'opposition' ELSE 'support' END AS kind, 1 - lost / n::DOUBLE AS coverage, least(greatest(0, 1 - faults / n::DOUBLE), 1 - lost / n::DOUBLE) AS provenance, CASE WHEN timely THEN 1 - lost / n::DOUBLE ELSE 0 END AS completeness FROM pa JOIN pg USING (path)),
fp AS (SELECT *, kind = 'support' AND timely AND lost = 0 AND operative AND completeness >= 0.5 AND provenance > 0 AS for_it, kind = 'opposition' AND timely AND lost = 0 AND operative AND provenance > 0 AS against, round(score * relevance * consistency * completeness * provenance, 9) AS quality FROM wp)""",
]
RP = [
    """tk AS (SELECT DISTINCT path, anchor, root, kind, token FROM (SELECT path, anchor, root, kind, unnest(['s' || nullif(source_id, ''), 'f' || nullif(family, ''), 'd' || nullif(derivation, ''), 'p' || path]) AS token FROM fp JOIN ps USING (path) JOIN ef USING (edge_id) WHERE kind <> 'noise') WHERE token IS NOT NULL),
rc AS (SELECT path, path AS other FROM fp WHERE kind <> 'noise' UNION SELECT r.path, b.path FROM rc r JOIN tk a ON a.path = r.other JOIN tk b ON b.anchor = a.anchor AND b.root = a.root AND b.kind = a.kind AND b.token = a.token),
co AS (SELECT path, min(other) AS component FROM rc GROUP BY path),
gr AS (SELECT component, count(*) AS paths, bool_or(families <> '') AS sourced, first(path ORDER BY (for_it OR against) DESC, quality DESC, path) AS path FROM fp JOIN co USING (path) GROUP BY component),
rp AS (SELECT fp.*, gr.component, gr.paths, for_it AND sourced AS independent FROM gr JOIN fp USING (path))"""
]
FT = [
    """fb AS (SELECT anchor, root, count(*) AS routes, count(*) FILTER (kind <> 'noise') AS relevant, count(*) FILTER (kind = 'noise') AS noise, count(*) FILTER (kind <> 'noise' AND NOT for_it AND NOT against) AS invalid FROM fp GROUP BY ALL),
dv AS (SELECT a.anchor, a.root, round(avg(1 - len(list_intersect(a.edges, b.edges))::DOUBLE / len(list_distinct(list_concat(a.edges, b.edges)))), 9) AS diversity FROM rp a JOIN rp b ON a.anchor = b.anchor AND a.root = b.root AND a.path < b.path WHERE a.independent AND b.independent GROUP BY ALL),
ft AS (SELECT *, 3 - root % 4 AS verified, round(support * (1 - opposition), 9) AS belief FROM (SELECT anchor, root, count(*) FILTER (independent) AS families, count(*) FILTER (for_it) AS supports, count(*) FILTER (against) AS oppositions, round(1 - coalesce(product(1 - quality) FILTER (independent), 1), 9) AS support, round(1 - coalesce(product(1 - quality) FILTER (against), 1), 9) AS opposition,
 coalesce(max(quality) FILTER (independent), 0) AS best, coalesce(max(quality) FILTER (against), 0) AS mass FROM rp GROUP BY ALL))"""
]
_ZERO = ", ".join(f"CASE WHEN n IS NULL THEN 0 ELSE round(coalesce({x}, 0), 9) END AS {x}" for x in ("temporal", "diversity", "support", "provenance", "contradiction", "relevance", "consistency", "completeness"))
SC = [
    f"""su AS (SELECT anchor, count(*) AS n, avg(timely::INT::DOUBLE) AS temporal, round(avg(provenance), 9) AS provenance, round(avg(relevance), 9) AS relevance, round(avg(consistency), 9) AS consistency, round(avg(completeness), 9) AS completeness, avg((families = '')::INT::DOUBLE) AS unsourced, round(max(score) / sum(score), 9) AS top,
 round(CASE WHEN count(*) > 1 THEN least(1, greatest(0, (ln(sum(score)) - sum(score * ln(score)) / sum(score)) / ln(count(*)))) ELSE 0 END, 9) AS spread FROM rp WHERE for_it GROUP BY anchor),
ba AS (SELECT anchor, count(*) AS targets, max(1 - exp(-0.7 * coalesce(families, 0))) AS support, avg(coalesce(diversity, 0)) FILTER (supports > 0) AS diversity, avg(oppositions::DOUBLE / (supports + oppositions)) FILTER (supports > 0) AS contradiction, max(coalesce(mass, 0)) AS material, sum(noise)::DOUBLE / sum(routes) AS noise FROM fb LEFT JOIN ft USING (anchor, root) LEFT JOIN dv USING (anchor, root) GROUP BY anchor),
cu AS (SELECT anchor, sum(len(edges)) > {BUDGET} AS truncated FROM pa GROUP BY anchor),
s0 AS (SELECT anchor, targets, coalesce(n, 0) AS n, {_ZERO}, round(material, 9) AS material, round(noise, 9) AS noise, round(CASE WHEN n IS NULL THEN 1 ELSE least(1, unsourced + (1 - completeness) + CASE WHEN truncated THEN 0.20 ELSE 0 END) END, 9) AS missing,
 round(CASE WHEN n IS NULL THEN 0 ELSE least(1, 0.45 * top + 0.35 * (1 - spread) + 0.20 * (1 - support / greatest(0.5, support + 0.5))) END, 9) AS pattern_lock FROM ba LEFT JOIN su USING (anchor) LEFT JOIN cu USING (anchor))"""
]


def sql(*parts):
    return [x for p in parts for x in p]


def assessed_sql(mode):
    """The assessment of s0 in one mode."""
    plus, minus = G.stability_weights(mode)
    share = lambda w: "(" + " + ".join(f"{v!r}e0 * {k}" for k, v in w.items()) + f") / {sum(w.values())!r}e0"
    own = G.BY_MODE.get(mode, {})
    held = lambda k: G.HELD.get(k, k)
    err = {k: f"least(1, greatest(0, ({own.get(k, v)}e0 - {held(k)}) / {own.get(k, v)}e0))" for k, v in G.LEAST.items()}
    for k, v in G.MOST.items():
        x, m = "(CASE WHEN material > 0 THEN material ELSE contradiction END)" if k == "contradiction" else held(k), own.get(k, v)
        err[k] = f"(CASE WHEN {x} <= {m}e0 THEN 0 ELSE ({x} - {m}e0) / (1 - {m}e0) END)"
    w = G.energy_weights(mode)
    mean = "(" + " + ".join(f"{v!r}e0 * {err[k]} * {err[k]}" for k, v in w.items()) + f") / {sum(w.values())!r}e0"
    floors = f"CASE WHEN {err['contradiction']} > 0 THEN 0.35 + 0.60 * {err['contradiction']} END, CASE WHEN {err['retrieval_noise']} > 0 THEN 0.15 + 0.35 * {err['retrieval_noise']} END, CASE WHEN {err['relevance']} > 0.5 OR {err['target_consistency']} > 0.5 THEN 0.45 END"
    inner = f"SELECT *, CASE WHEN n = 0 THEN 0 ELSE round(least(1, greatest(0, 0.72 * {share(plus)} + 0.28 * (1 - {share(minus)}))), 9) END AS total, CASE WHEN n = 0 THEN 1 ELSE round(least(1, greatest({mean}, {floors})), 9) END AS energy FROM s0"
    inner = f"SELECT *, n > 0 AND relevance >= 0.5 AND consistency >= 0.5 AND completeness >= 0.5 AND provenance >= 0.25 AND noise <= 0.4 AND material < 0.15 AS admissible FROM ({inner})"
    return f"""SELECT '{mode}' AS mode, *, n > 0 AND material >= 0.15 AS blocks, n > 0 AND energy <= 0.08 AS goal, admissible AND total >= 0.62 AND n > 0 AND energy <= 0.08 AS stable, NOT admissible OR total < 0.48 OR energy > 0.25 OR pattern_lock > 0.70 OR missing > 0.25 OR noise > 0.10 AS escape,
 n > 0 AND (material >= 0.15 OR contradiction > 0 OR pattern_lock > 0.55 OR targets > 1) AS oppose, total < 0.25 OR energy > 0.70 OR provenance < 0.25 OR temporal < 0.25 OR relevance < 0.25 OR consistency < 0.25 AS abstain FROM ({inner})"""


def near_sql(a, b):
    return f"abs({a} - {b}) <= greatest(1e-9, 1e-6 * greatest(abs({a}), abs({b})))"


_TIE = " AND ".join(near_sql(f"a.{k}", f"b.{k}") for k in ("belief", "support", "opposition", "best")) + " AND a.verified = b.verified AND a.families = b.families"
SE = [
    f"""tr AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY belief DESC, verified DESC, families DESC, best DESC, root) AS place FROM ft WHERE supports > 0 AND families > 0),
sl AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY support DESC, place) = 1),
lv AS (SELECT t.anchor, count(*) AS level FROM tr t JOIN sl s ON s.anchor = t.anchor AND {near_sql("t.support", "s.support")} GROUP BY t.anchor),
se AS (SELECT a.anchor, coalesce({_TIE}, false) AS tie, CASE WHEN coalesce({_TIE}, false) THEN NULL WHEN a.root = s.root OR level > 1 OR a.families >= 2 THEN a.root WHEN s.opposition >= 0.15 THEN NULL ELSE s.root END AS selected FROM tr a JOIN sl s ON s.anchor = a.anchor JOIN lv ON lv.anchor = a.anchor LEFT JOIN tr b ON b.anchor = a.anchor AND b.place = 2 WHERE a.place = 1)"""
]
AD = [
    """am AS (SELECT r.anchor, count(*) AS n, round(avg(relevance), 9) AS relevance, round(avg(consistency), 9) AS consistency, round(avg(completeness), 9) AS completeness, round(avg(provenance), 9) AS provenance FROM rp r JOIN se ON se.anchor = r.anchor AND se.selected = r.root WHERE independent GROUP BY r.anchor),
ch AS (SELECT DISTINCT fp.anchor, se.selected, coalesce(se.tie, false) AS tie FROM fp LEFT JOIN se ON se.anchor = fp.anchor),
a0 AS (SELECT ch.*, coalesce(t.support, 0) AS support, coalesce(t.belief, 0) AS belief, coalesce(t.families, 0) AS families, coalesce(t.mass, 0) AS mass, coalesce(t.verified, 1) AS verified, coalesce(am.n, 0) AS n, coalesce(relevance, 0) AS relevance, coalesce(consistency, 0) AS consistency, coalesce(completeness, 0) AS completeness, coalesce(provenance, 0) AS provenance, coalesce(noise::DOUBLE / routes, 0) AS noise
 FROM ch LEFT JOIN ft t ON t.anchor = ch.anchor AND t.root = ch.selected LEFT JOIN am ON am.anchor = ch.anchor LEFT JOIN fb ON fb.anchor = ch.anchor AND fb.root = ch.selected),
pr AS (SELECT a.anchor, max(t.opposition) AS pressed FROM a0 a JOIN ft t ON t.anchor = a.anchor AND t.opposition >= 0.15 AND t.families > 0 WHERE a.selected IS NULL OR (a.families < 2 AND t.root <> a.selected AND t.support > a.support) GROUP BY a.anchor),
ad AS (SELECT *, unresolved >= 0.15 AS blocks, families >= 2 AS sufficient, n > 0 AND relevance >= 0.5 AND consistency >= 0.5 AND completeness >= 0.5 AND provenance >= 0.25 AND noise <= 0.4 AND unresolved < 0.15 AS admissible, selected IS NOT NULL AND support >= 0.225 AS has_answer FROM (SELECT a0.*, greatest(mass, coalesce(pressed, 0)) AS unresolved FROM a0 LEFT JOIN pr USING (anchor)))"""
]
OP = [
    """og AS (SELECT r.anchor, max(quality) AS strongest, max(quality) FILTER (ad.has_answer AND r.root = ad.selected) AS mine, list_sort(list(DISTINCT r.root)) AS challenged FROM rp r JOIN ad ON ad.anchor = r.anchor WHERE r.against GROUP BY r.anchor),
op AS (SELECT anchor, greatest(coalesce(strongest, 0), unresolved) AS score, CASE WHEN has_answer THEN greatest(coalesce(mine, 0), unresolved) ELSE 0 END AS selected_score, coalesce(challenged, []) AS challenged, has_answer AND NOT sufficient AS corroborate FROM ad LEFT JOIN og USING (anchor))"""
]
TO_HEADS, TO_TARGETS = sql([EXPAND], FP, RP), sql([EXPAND], FP, RP, FT)
TO_CHOICE = sql(TO_TARGETS, SE, AD)


def rec(body, parts):
    return duck(body, *parts, recursive=True)


@query("fiber_paths", rec("SELECT path, anchor, root, kind, round(coverage, 9) AS coverage, round(provenance, 9) AS provenance, round(completeness, 9) AS completeness, for_it, against, quality FROM fp", sql([EXPAND], FP)))
def fiber_paths(spark, d):
    r = [F.round(c, 9).alias(c) for c in ("coverage", "provenance", "completeness")]
    return rows(spark, d).select("path", "anchor", "root", "kind", *r, "for_it", "against", "quality")


@query("fiber_dedupe", rec("SELECT path, CASE WHEN anchor % 2 = 0 THEN 2 ELSE 1 END AS copies, CASE WHEN anchor % 2 = 0 THEN score / 2 ELSE score END AS score, for_it AND anchor % 2 = 1 AS for_it, CASE WHEN anchor % 2 = 0 THEN CASE WHEN sources = '' THEN 'zz' ELSE sources || ',zz' END ELSE sources END AS sources FROM fp", sql([EXPAND], FP)))
def fiber_dedupe(spark, d):
    """Every other bundle's paths come twice, the second time weaker, from one more source and without a vote."""
    r = rows(spark, d)
    again = r.filter("anchor % 2 = 0").withColumns({"score": F.col("score") / 2, "for_it": F.lit(False), "sources": F.concat("sources", F.array(F.lit("zz")))})
    return critic.dedupe(r.unionByName(again)).select("path", "copies", "score", "for_it", csv("sources").alias("sources"))


@query("fiber_counts", rec("SELECT *, noise::DOUBLE / routes AS noise_ratio, CASE WHEN relevant > 0 THEN invalid::DOUBLE / relevant ELSE 0 END AS invalid_ratio FROM fb", TO_TARGETS))
def fiber_counts(spark, d):
    return critic.counts(rows(spark, d))


@query("path_overlap", rec("SELECT DISTINCT a.path, b.path AS other FROM tk a JOIN tk b ON b.anchor = a.anchor AND b.root = a.root AND b.kind = a.kind AND b.token = a.token WHERE a.path < b.path", TO_HEADS))
def path_overlap(spark, d):
    """Correlated paths of one target: an equi-join on what they share (a request bounds the paths of a target)."""
    r = rows(spark, d).filter("kind <> 'noise'")
    named = critic.lineage()
    t = r.select("path", "anchor", "root", "kind", F.explode(F.concat(*named)).alias("token"))
    return t.join(t.withColumnRenamed("path", "other"), ["anchor", "root", "kind", "token"]).filter("path < other").select("path", "other").distinct()


@query("correlation_groups", rec("SELECT anchor, root, kind, component, paths, path, quality, independent FROM rp", TO_HEADS))
def correlation_groups(spark, d):
    return critic.representatives(rows(spark, d)).select("anchor", "root", "kind", "component", "paths", "path", "quality", "independent")


@query("route_diversity", rec("SELECT anchor, root, diversity FROM dv", TO_TARGETS))
def route_diversity(spark, d):
    return critic.route_diversity(critic.representatives(rows(spark, d)))


@query("target_belief", rec("SELECT anchor, root, families, support, opposition, belief, best FROM ft", TO_TARGETS))
def target_belief(spark, d):
    return critic.targets(critic.representatives(rows(spark, d))).select("anchor", "root", "families", "support", "opposition", "belief", "best")


@query("stability_scores", rec("SELECT * FROM s0", sql(TO_TARGETS, SC)))
def stability_scores(spark, d):
    r = rows(spark, d)
    return scored(r, critic.representatives(r))


_FLAGS = ["blocks", "admissible", "goal", "stable", "escape", "oppose", "abstain"]


@query("stability_assess", rec(" UNION ALL ".join(f"SELECT anchor, mode, total, energy, {', '.join(_FLAGS)} FROM ({assessed_sql(m)})" for m in MODES), sql(TO_TARGETS, SC)))
def stability_assess(spark, d):
    r = rows(spark, d)
    s = materialize(scored(r, critic.representatives(r)))
    parts = [critic.assess(s, m).select("anchor", F.lit(m).alias("mode"), "total", "energy", *_FLAGS) for m in MODES]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("select_target", rec("SELECT anchor, selected, tie FROM se", TO_CHOICE))
def select_target(spark, d):
    return critic.select_target(ranked(critic.representatives(rows(spark, d))))


def allowed(weighed, heads):
    return critic.admissibility(weighed, heads, materialize(ranked(heads)))


def heads_of(spark, d):
    r = rows(spark, d)
    return r, materialize(critic.representatives(r))


@query("admissibility", rec("SELECT anchor, selected, tie, unresolved, blocks, sufficient, admissible, has_answer FROM ad", TO_CHOICE))
def admissibility(spark, d):
    return allowed(*heads_of(spark, d)).select("anchor", "selected", "tie", "unresolved", "blocks", "sufficient", "admissible", "has_answer")


@query("admissibility_means", rec("SELECT anchor, relevance, consistency, completeness, provenance, noise FROM ad", TO_CHOICE))
def admissibility_means(spark, d):
    return allowed(*heads_of(spark, d)).select("anchor", "relevance", "consistency", "completeness", "provenance", "noise")


#: Fixed value: paths shown with an answer.
MOST_SELECTED = 4


@query("converge", rec(f"""SELECT ad.anchor, has_answer, selected AS primary_node, belief AS confidence, coalesce(evidence, '') AS evidence FROM ad LEFT JOIN (SELECT anchor, string_agg(DISTINCT edge_id::VARCHAR, ',' ORDER BY edge_id::VARCHAR) AS evidence FROM (SELECT r.anchor, unnest(r.edges) AS edge_id FROM
 (SELECT rp.*, row_number() OVER (PARTITION BY rp.anchor ORDER BY quality DESC, path) AS place FROM rp JOIN ad ON ad.anchor = rp.anchor AND ad.selected = rp.root WHERE independent) r WHERE place <= {MOST_SELECTED}) GROUP BY anchor) USING (anchor)""", TO_CHOICE))
def converge(spark, d):
    """The chosen target, its belief, and the edges of its best independent paths."""
    return answer(*heads_of(spark, d))


def answer(weighed, heads):
    chosen = materialize(allowed(weighed, heads))
    own = heads.filter("independent").join(chosen.select("anchor", F.col("selected").alias("root")), critic.TARGET)
    shown = own.groupBy("anchor").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("quality")).alias("k"), "path", "edges"))), 1, MOST_SELECTED).alias("x"))
    evidence = csv(F.array_sort(F.array_distinct(F.transform(F.flatten("x.edges"), lambda i: i.cast("string")))))
    return chosen.join(shown, "anchor", "left").select("anchor", "has_answer", F.col("selected").alias("primary_node"), F.col("belief").alias("confidence"), F.coalesce(evidence, F.lit("")).alias("evidence"))


@query("oppose", rec("SELECT anchor, score, selected_score, array_to_string(challenged, ',') AS challenged, len(challenged) > 0 AND score >= 0.25 AS challenge, corroborate, CASE WHEN len(challenged) > 0 THEN array_to_string(list_sort(list_distinct(list_append(challenged, anchor))), ',') ELSE '' END AS reopen FROM op", sql(TO_CHOICE, OP)))
def oppose(spark, d):
    r, heads = heads_of(spark, d)
    return critic.opposition(heads, materialize(allowed(r, heads))).withColumns({"challenged": csv("challenged"), "reopen": csv("reopen")})


@query("g0_projection", rec("SELECT anchor, 'abstain' AS status, 0 AS primary_node, array_to_string(list_sort(list_distinct(flatten(list(edges)))), ',') AS evidence, (SELECT string_agg(DISTINCT family, ',' ORDER BY family) FROM fp x JOIN ps USING (path) JOIN ef USING (edge_id) WHERE x.anchor = fp.anchor AND family <> '') AS families FROM fp GROUP BY anchor", sql([EXPAND], FP)))
def g0_projection(spark, d):
    """Evidence alone: what was found, and never an answer."""
    union = lambda c: csv(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))))
    return rows(spark, d).groupBy("anchor").agg(union("edges").alias("evidence"), union("families").alias("families")).select("anchor", F.lit("abstain").alias("status"), F.lit(0).alias("primary_node"), "evidence", "families")


_SIGNED = "CASE WHEN h >= 9223372036854775808 THEN (h::HUGEINT - 18446744073709551616)::BIGINT ELSE h::BIGINT END"


@query("bundle_hash", rec(f"SELECT anchor, {_SIGNED} AS hash FROM (SELECT anchor, {FNV} AS h FROM (SELECT anchor, string_agg(path || '|' || kind || '|' || floor(quality * 1e6 + 0.5)::BIGINT, ';' ORDER BY path) AS x FROM fp GROUP BY anchor))", sql([EXPAND], FP)))
def bundle_hash(spark, d):
    """One number for all that a bundle holds, whatever order its rows come in."""
    return hashes(rows(spark, d))


def hashes(weighed):
    line = F.concat_ws("|", "path", "kind", F.floor(F.col("quality") * 1e6 + 0.5).cast("string"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"])
    return weighed.groupBy("anchor").agg(S.fnv1a(F.array_join(lines, ";")).alias("hash"))


#: Fixed value: most rounds of recovery.
ROUNDS = 3


def decide(weighed, mode="balanced"):
    """(anchor, paths, status, selected, confidence, energy, wants, lineage) of each bundle."""
    heads = materialize(critic.representatives(weighed))
    chosen = materialize(allowed(weighed, heads))
    state = critic.assess(scored(weighed, heads), mode).select("anchor", "missing", "completeness", "provenance", "stable", "escape", "energy")
    against = critic.opposition(heads, chosen).select("anchor", F.col("selected_score").alias("opposition"), "challenge")
    own = chosen.select("anchor", "selected", "has_answer", "tie", "blocks", "admissible", "sufficient", F.col("belief").alias("confidence"), F.element_at(F.array(*map(F.lit, ("contradicted", "unverified", "not_applicable", "verified"))), F.col("verified") + 1).alias("verification"))
    size = weighed.groupBy("anchor").agg(F.count("*").alias("paths"), csv(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources"))))).alias("lineage"))
    out = own.join(state, "anchor").join(against, "anchor").join(size, "anchor").withColumn("theoretical", F.lit(mode == "theoretical"))
    return out.select("anchor", "paths", G.governed_status().alias("status"), F.when(F.col("has_answer"), F.col("selected")).alias("selected"), "confidence", "energy", (F.col("escape") | F.col("challenge")).alias("wants"), "lineage")


def runtime(n, e, hops=HOPS, rounds=ROUNDS):
    """One row an anchor: its last state, the rounds it took and why it stopped.

    Bundles that call for more evidence are expanded again, a hop further each round, until nothing is asked for, a round
    finds nothing new, or the rounds are used up; only those bundles take part in a round.
    """
    active, done = symptoms(n).withColumn("before", F.lit(-1).cast("bigint")), None
    for k in range(rounds + 1):
        active = materialize(active)
        if k and active.isEmpty():
            break
        seen = decide(rows_of(active.select("anchor"), n, e, hops + k))
        state = active.join(seen, "anchor", "left").withColumns({"paths": F.coalesce("paths", F.lit(0)), "status": F.coalesce("status", F.lit("evidence_required:no_answer_missing_evidence")), "wants": F.coalesce("wants", F.lit(True)), "confidence": F.coalesce("confidence", F.lit(0.0)), "energy": F.coalesce("energy", F.lit(1.0)), "lineage": F.coalesce("lineage", F.lit(""))})
        stop = F.when(~F.col("wants"), "no_search_requested").when(F.col("paths") == F.col("before"), "unchanged").when(F.lit(k == rounds), "rounds_used")
        state = materialize(state.withColumns({"stop": stop, "round": F.lit(k)}))
        ended = state.filter("stop IS NOT NULL").drop("before", "wants")
        done = ended if done is None else done.unionByName(ended)
        active = state.filter("stop IS NULL").select("anchor", F.col("paths").alias("before"))
    return done


@query("runtime_reason")
def runtime_reason(spark, d):
    return runtime(*visible(spark, d))


@query("receipt")
def receipt(spark, d):
    """The end state of each bundle with one hash over all it says; energies and confidences as billionths."""
    r = runtime(*visible(spark, d))
    whole = lambda c: F.floor(F.col(c) * 1e9).cast("string")
    text = F.concat_ws("\x1f", F.col("anchor").cast("string"), F.coalesce(F.col("selected"), F.lit(0)).cast("string"), "status", whole("confidence"), whole("energy"), F.col("paths").cast("string"), "lineage", "stop", F.col("round").cast("string"))
    return r.select("anchor", "selected", "status", "confidence", "energy", "lineage", "stop", S.fnv1a(text).alias("content_hash"))
