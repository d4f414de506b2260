"""Logs and their audits, paired statistics, rollups of runs, scorecards and reconstruction figures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from evigraph import project as P
from evigraph.functions import scalar as S
from evigraph.functions.encode import predictive_codes
from evigraph.operators import expand, process, ranges, retrieve
from evigraph.plans.basics import COS, FNV, query_vectors, visible
from evigraph.plans.reasoning import STEPS, steps
from evigraph.project import duck, table
from evigraph.registry import query

EPSILON = 1e-9


def unsigned(h):
    return F.conv(F.hex(h), 16, 10)


@query("state_transitions", "SELECT user_id, event_id, before, event_type AS after FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def state_transitions(spark, d):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("user_id", "event_id", before.alias("before"), F.col("event_type").alias("after")).filter("NOT before <=> after")


def event_checksum():
    """Hash of a log row (sequence, event_id, before, event_type)."""
    return S.fnv1a(F.concat(F.col("sequence").cast("string"), F.col("event_id").cast("string"), F.coalesce("before", F.lit("")), F.col("event_type")))


def event_log(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", F.row_number().over(w).alias("sequence"), F.lag("event_type").over(w).alias("before"))
    return rows.withColumn("checksum", event_checksum())


_SIGNED = "CASE WHEN h >= 9223372036854775808 THEN (h::HUGEINT - 18446744073709551616)::BIGINT ELSE h::BIGINT END"
LOG = f"""lg AS (SELECT user_id, event_id, event_type, row_number() OVER w AS sequence, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
lh AS (SELECT user_id, event_id, sequence, {FNV} AS h FROM (SELECT *, sequence::VARCHAR || event_id || coalesce(before, '') || event_type AS x FROM lg))"""


@query("event_log_hash", f"WITH {LOG} SELECT user_id, {_SIGNED} AS hash FROM (SELECT user_id, {FNV} AS h FROM (SELECT user_id, string_agg(h::VARCHAR, '' ORDER BY sequence) AS x FROM lh GROUP BY user_id))")
def event_log_hash(spark, d):
    """Each user's log as one number: the hash runs on over the checksums' digits, so it is that of their concatenation."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("sequence", unsigned(F.col("checksum")).alias("t")))), lambda x: x["t"])
    return event_log(spark, d).groupBy("user_id").agg(S.fnv1a(F.array_join(parts, "")).alias("hash"))


AUDIT = """SELECT vec_id AS id, CASE vec_id % 3 WHEN 0 THEN 'hypothesis' WHEN 1 THEN 'claim' ELSE 'observation' END AS kind, CASE vec_id % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'active' ELSE 'proposed' END AS status, vec_id % 5 AS o, vec_id % 6 < 2 AS bare FROM embeddings"""


@query("model_world_audit", f"""SELECT id, unnest(list_filter([CASE WHEN status = 'verified' AND bare THEN 'VERIFIED_WITHOUT_EVIDENCE' END, CASE WHEN status = 'verified' AND o IN (2, 4) THEN 'SILENT_TRUTH_PROMOTION' END, CASE WHEN kind = 'hypothesis' AND status = 'active' AND bare THEN 'ACTIVE_HYPOTHESIS_WITHOUT_EVIDENCE' END], lambda z: z IS NOT NULL)) AS code FROM ({AUDIT})
 UNION ALL SELECT event_id, 'EVENT_CHECKSUM_MISMATCH' FROM events WHERE event_id % 29 = 0""")
def model_world_audit(spark, d):
    """What a world of claims must not hold; every 29th log row was stored with a wrong checksum."""
    i, c = F.col("vec_id"), F.col
    world = table(spark, d, "embeddings").select(
        i.alias("id"),
        F.when(i % 3 == 0, "hypothesis").when(i % 3 == 1, "claim").otherwise("observation").alias("kind"),
        F.when(i % 4 == 0, "verified").when(i % 4 == 1, "active").otherwise("proposed").alias("status"),
        P.pick(P.ORIGINS, i % 5).alias("origin"),
        (i % 6 < 2).alias("bare"),
    )
    codes = F.array_compact(
        F.array(
            F.when((c("status") == "verified") & c("bare"), "VERIFIED_WITHOUT_EVIDENCE"),
            F.when((c("status") == "verified") & c("origin").isin("inferred", "hypothetical"), "SILENT_TRUTH_PROMOTION"),
            F.when((c("kind") == "hypothesis") & (c("status") == "active") & c("bare"), "ACTIVE_HYPOTHESIS_WITHOUT_EVIDENCE"),
        )
    )
    log = event_log(spark, d).withColumn("stored", F.when(c("event_id") % 29 == 0, c("checksum").bitwiseXOR(F.lit(1))).otherwise(c("checksum")))
    broken = log.filter(c("stored") != event_checksum()).select(c("event_id").alias("id"), F.lit("EVENT_CHECKSUM_MISMATCH").alias("code"))
    return world.select("id", F.explode(codes).alias("code")).unionByName(broken)


@query("policy_history", """WITH p AS (SELECT event_id, user_id % 3 AS tenant, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS seq, CASE WHEN event_id % 5 = 0 THEN 'rollback' ELSE 'promote' END AS action, event_id % 37 AS version FROM events),
a AS (SELECT *, action = 'promote' OR coalesce(min(seq) FILTER (action = 'promote') OVER (PARTITION BY tenant, version), seq + 1) < seq AS accepted FROM p)
SELECT event_id, tenant, action, version, accepted, CASE WHEN accepted THEN last_value(CASE WHEN accepted THEN version END IGNORE NULLS) OVER (PARTITION BY tenant ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS previous FROM a""")
def policy_history(spark, d):
    """Decisions in order; a rollback counts only to a version that was in force before."""
    e, i = table(spark, d, "events"), F.col("event_id")
    rows = e.select(i, (F.col("user_id") % 3).alias("tenant"), F.when(i % 5 == 0, "rollback").otherwise("promote").alias("action"), (i % 37).alias("version"))
    first = rows.filter("action = 'promote'").groupBy("tenant", "version").agg(F.min("event_id").alias("first"))
    rows = rows.join(first, ["tenant", "version"], "left")
    rows = rows.withColumn("accepted", (F.col("action") == "promote") | F.coalesce(F.col("first") < i, F.lit(False))).withColumn("b", ranges.bucket("event_id"))
    out = ranges.before(rows, ["tenant"], ["b"], ["event_id"], {"previous": F.when(F.col("accepted"), F.col("version"))})
    return out.select("event_id", "tenant", "action", "version", "accepted", F.when(F.col("accepted"), F.col("previous")).alias("previous"))


ENERGIES = "SELECT event_type, event_id, value / (value + 50e0) AS gold, (value + event_id % 3) / (value + 50e0 + event_id % 3) AS missing, CASE WHEN event_id % 4 = 0 THEN value / (value + 60e0) ELSE value / (value + 50e0) END AS duplicated FROM events"


@query("energy_diagnostics", f"SELECT event_type, count(*) AS examples, round(avg(gold), 6) AS gold_mean, round(median(gold), 6) AS gold_median, round(avg((missing > gold + 1e-9)::INT), 6) AS missing_rate, round(avg((duplicated >= gold - 1e-9)::INT), 6) AS duplicate_rate FROM ({ENERGIES}) GROUP BY event_type")
def energy_diagnostics(spark, d):
    v, i = F.col("value"), F.col("event_id")
    e = table(spark, d, "events").select("event_type", (v / (v + 50)).alias("gold"), ((v + i % 3) / (v + 50 + i % 3)).alias("missing"), F.when(i % 4 == 0, v / (v + 60)).otherwise(v / (v + 50)).alias("duplicated"))
    rate = lambda test: F.round(F.avg(test.cast("int")), 6)
    return e.groupBy("event_type").agg(
        F.count("*").alias("examples"),
        F.round(F.avg("gold"), 6).alias("gold_mean"),
        F.round(F.median("gold"), 6).alias("gold_median"),
        rate(F.col("missing") > F.col("gold") + EPSILON).alias("missing_rate"),
        rate(F.col("duplicated") >= F.col("gold") - EPSILON).alias("duplicate_rate"),
    )


@query("intervention_rollup", "SELECT CASE WHEN grouping(event_type) = 1 THEN 'all_hard' ELSE event_type END AS family, event_id % 5 AS policy, count(*) AS runs, round(avg((event_id % 3 <> 0)::INT), 6) AS final_accuracy, round(avg(event_id % 7), 6) AS mean_cycles, round(avg(value), 6) AS mean_visited FROM events GROUP BY GROUPING SETS ((event_type, event_id % 5), (event_id % 5))")
def intervention_rollup(spark, d):
    """Every family by policy, and every policy over all families, in one pass."""
    i = F.col("event_id")
    e = table(spark, d, "events").select(F.col("event_type").alias("f"), (i % 5).alias("policy"), (i % 3 != 0).cast("int").alias("right"), (i % 7).alias("cycles"), "value")
    out = e.groupingSets([[F.col("f"), F.col("policy")], [F.col("policy")]], F.col("f"), F.col("policy")).agg(F.grouping("f").alias("g"), F.count("*").alias("runs"), *[F.round(F.avg(a), 6).alias(b) for a, b in (("right", "final_accuracy"), ("cycles", "mean_cycles"), ("value", "mean_visited"))])
    return out.select(F.when(F.col("g") == 1, "all_hard").otherwise(F.col("f")).alias("family"), "policy", "runs", "final_accuracy", "mean_cycles", "mean_visited")


#: Fixed values of the paired bootstrap.
SEED, RESAMPLES, ALPHA = 20261006, 10_000, 0.05


def paired_bootstrap(pairs, seed=SEED, resamples=RESAMPLES, alpha=ALPHA):
    """(n_pairs, control_mean, treatment_mean, delta, ci_low, ci_high) of (control, treatment) rows.

    Resampling rows is a multinomial draw over distinct pairs, so only their counts are needed: exact in distribution.
    Distinct pairs must be few (binary outcomes have four); they are carried to every resample.
    """
    kinds = pairs.groupBy("control", "treatment").agg(F.count("*").alias("k"))
    packed = kinds.agg(F.array_sort(F.collect_list(F.struct((F.col("treatment") - F.col("control")).cast("double").alias("delta"), "k"))).alias("kinds"))

    @F.pandas_udf("double")
    def draw(number: pd.Series, deltas: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for i, x, k in zip(number, deltas, counts, strict=True):
            n = int(np.sum(k))
            out.append(float(np.random.default_rng([seed, i]).multinomial(n, np.asarray(k) / n) @ np.asarray(x) / n) if n else None)
        return pd.Series(out, dtype=float)

    spark = pairs.sparkSession
    runs = spark.range(resamples).crossJoin(F.broadcast(packed)).select(draw("id", F.col("kinds.delta"), F.col("kinds.k")).alias("delta"))  # one row
    ends = runs.agg(F.percentile("delta", F.lit(alpha / 2)).alias("ci_low"), F.percentile("delta", F.lit(1 - alpha / 2)).alias("ci_high"))
    means = pairs.agg(F.count("*").alias("n_pairs"), F.avg("control").alias("control_mean"), F.avg("treatment").alias("treatment_mean"))
    return means.crossJoin(F.broadcast(ends)).withColumn("delta", F.col("treatment_mean") - F.col("control_mean"))


@query("paired_bootstrap")
def paired_bootstrap_query(spark, d):
    return paired_bootstrap(table(spark, d, "labels").select(F.col("quality").alias("control"), (1 - F.col("toxic")).alias("treatment")))


#: Decisions at each step by integer rules: the hypothesis in force, whether it is resolved, what an oracle expects.
DECIDED = "dc AS (SELECT episode, step, event_id, kind, 'H' || (event_id % 3 % 2 + 1) AS operative, event_id % 7 < 3 AS resolved, CASE WHEN episode % 5 = 0 THEN NULL ELSE 'H' || (episode % 2 + 1) END AS expected, step = max(step) OVER (PARTITION BY episode) AS last FROM t)"


def decided(spark, d):
    s, i = steps(spark, d), F.col("event_id")
    return s.select("episode", "step", "event_id", "kind", F.concat(F.lit("H"), (i % 3 % 2 + 1).cast("string")).alias("operative"), (i % 7 < 3).alias("resolved"), F.when(F.col("episode") % 5 != 0, F.concat(F.lit("H"), (F.col("episode") % 2 + 1).cast("string"))).alias("expected"), (F.col("step") == F.max("step").over(Window.partitionBy("episode"))).alias("last"))


@query("process_metrics", f"WITH {STEPS}, {DECIDED} SELECT count(*) AS episodes, round(avg((operative IS NOT DISTINCT FROM expected)::INT), 9) AS accuracy, round(avg(resolved::INT), 9) AS committed_coverage, round(avg((operative IS NOT DISTINCT FROM expected)::INT) FILTER (resolved), 9) AS committed_accuracy, round(avg((operative IS DISTINCT FROM expected)::INT) FILTER (resolved), 9) AS false_commitment, round(avg((NOT resolved)::INT) FILTER (expected IS NULL), 9) AS abstention, (SELECT round(avg((kind = 'refute')::INT), 9) FROM dc) AS challenge_rate FROM dc WHERE last")
def process_metrics(spark, d):
    rows = decided(spark, d)
    right = F.col("operative").eqNullSafe(F.col("expected"))
    share = lambda test, of=F.lit(True): F.round(F.avg(F.when(F.col("last") & of, test.cast("int"))), 9)
    done = F.col("resolved")
    return rows.agg(F.count_if("last").alias("episodes"), share(right).alias("accuracy"), share(done).alias("committed_coverage"), share(right, done).alias("committed_accuracy"), share(~right, done).alias("false_commitment"), share(~done, F.col("expected").isNull()).alias("abstention"), F.round(F.avg((F.col("kind") == "refute").cast("int")), 9).alias("challenge_rate"))


LEAST_FAMILIES = 2
_SUP = "su AS (SELECT h.episode, h.bears_on AS hypothesis, s.step, count(DISTINCT a.family) FILTER (a.kind = 'support' AND a.independent) AS families, coalesce(bool_or(a.kind IN ('refute', 'revoke') AND a.decisive), false) AS refuted FROM (SELECT DISTINCT episode, bears_on FROM t) h JOIN t s ON s.episode = h.episode LEFT JOIN act a ON a.episode = s.episode AND a.at_ = s.step AND a.bears_on = h.bears_on GROUP BY ALL)"


@query("convergence_audit", f"""WITH {STEPS}, {DECIDED}, {_SUP} SELECT dc.episode, count(*) FILTER (resolved) AS resolved_decisions, count(*) FILTER (resolved AND (o.families IS NULL OR o.families < 2 OR o.refuted)) AS violations, count(*) FILTER (last AND x.families >= 2 AND NOT x.refuted) AS opportunities, count(*) FILTER (last AND x.families >= 2 AND NOT x.refuted AND resolved AND operative = expected) AS earned
 FROM dc LEFT JOIN su o ON o.episode = dc.episode AND o.step = dc.step AND o.hypothesis = dc.operative LEFT JOIN su x ON x.episode = dc.episode AND x.step = dc.step AND x.hypothesis = dc.expected GROUP BY dc.episode""")
def convergence_audit(spark, d):
    """Resolutions without enough independent support or against a standing refutation, and those that were earned."""
    support = process.step_support(steps(spark, d))
    own = support.select("episode", "step", F.col("hypothesis").alias("operative"), F.col("families").alias("f1"), F.col("refuted").alias("r1"))
    due = support.select("episode", "step", F.col("hypothesis").alias("expected"), F.col("families").alias("f2"), F.col("refuted").alias("r2"))
    rows = decided(spark, d).join(own, ["episode", "step", "operative"], "left").join(due, ["episode", "step", "expected"], "left")
    weak = F.col("f1").isNull() | (F.col("f1") < LEAST_FAMILIES) | F.col("r1")
    able = F.col("last") & (F.col("f2") >= LEAST_FAMILIES) & ~F.col("r2")
    return rows.groupBy("episode").agg(F.count_if("resolved").alias("resolved_decisions"), F.count_if(F.col("resolved") & weak).alias("violations"), F.count_if(able).alias("opportunities"), F.count_if(able & F.col("resolved") & (F.col("operative") == F.col("expected"))).alias("earned"))


def _walk(name, edges, hops):
    return f"""{name} AS (SELECT id AS anchor, id AS at_, [id] AS nodes, []::BIGINT[] AS edges, root FROM vn WHERE symptom UNION ALL SELECT x.anchor, e.src, list_append(x.nodes, e.src), list_append(x.edges, e.edge_id), p.root FROM {name} x JOIN {edges} e ON e.dst = x.at_ JOIN vn p ON p.id = e.src WHERE NOT x.root AND len(x.edges) < {hops} AND NOT list_contains(x.nodes, e.src))"""


@query("retrieval_scorecard", duck("""SELECT anchor, count(DISTINCT root) FILTER (due) AS expected_roots, count(DISTINCT root) FILTER (root_due AND root_got) AS matched_roots, count(*) FILTER (due) AS expected_paths, count(*) FILTER (due AND got) AS matched_paths, count(*) FILTER (got) AS returned_paths, count(*) FILTER (got AND NOT due) + count(DISTINCT root) FILTER (root_got AND NOT root_due) AS inadmissible
 FROM (SELECT *, bool_or(due) OVER (PARTITION BY anchor, root) AS root_due, bool_or(got) OVER (PARTITION BY anchor, root) AS root_got FROM (SELECT anchor, root, path, bool_or(due) AS due, bool_or(got) AS got FROM (SELECT anchor, at_ AS root, array_to_string(edges, ',') AS path, true AS due, false AS got FROM w1 WHERE root UNION ALL SELECT anchor, at_, array_to_string(edges, ','), false, true FROM w2 WHERE root) GROUP BY ALL)) GROUP BY anchor""", "be AS (SELECT * FROM ve WHERE origin <> 'hypothetical')", _walk("w1", "ve", 3), _walk("w2", "be", 4), recursive=True))
def retrieval_scorecard(spark, d):
    """Paths returned (no hypothetical edge, four hops) against those expected (any edge, three hops)."""
    n, e = visible(spark, d)
    anchors = n.filter("symptom").select(F.col("id").alias("anchor"))
    side = lambda es, hops, due: expand.evidence_paths(anchors, n, es, hops).select("anchor", F.col("at").alias("root"), F.array_join("edges", ",").alias("path"), F.lit(due).alias("due"), F.lit(not due).alias("got"))
    both = side(e, 3, True).unionByName(side(e.filter("origin <> 'hypothetical'"), 4, False))
    paths = both.groupBy("anchor", "root", "path").agg(F.bool_or("due").alias("due"), F.bool_or("got").alias("got"))
    roots = paths.groupBy("anchor", "root").agg(F.count_if("due").alias("p"), F.count_if(F.col("due") & F.col("got")).alias("m"), F.count_if("got").alias("g"), F.count_if(F.col("got") & ~F.col("due")).alias("x"))
    has = lambda c: (F.col(c) > 0).cast("bigint")
    return roots.groupBy("anchor").agg(F.sum(has("p")).alias("expected_roots"), F.sum(has("p") * has("g")).alias("matched_roots"), F.sum("p").alias("expected_paths"), F.sum("m").alias("matched_paths"), F.sum("g").alias("returned_paths"), (F.sum("x") + F.sum(has("g") * (1 - has("p")))).alias("inadmissible"))


GATES = {"multi_root": 0.25, "contradiction": 0.20, "temporal": 0.20, "hyperedge": 0.10, "no_evidence": 0.10}
_SHARES = " UNION ALL ".join(f"SELECT '{g}' AS gate, round(avg({g}::INT), 9) AS share, avg({g}::INT) >= {v} AS passed FROM gg" for g, v in GATES.items())


@query("coverage_gate", duck(_SHARES, "gg AS (SELECT incident, count(*) FILTER (root) > 1 AS multi_root, bool_or(id % 10 = 0) AS hyperedge, coalesce(bool_or(contradiction), false) AS contradiction, coalesce(bool_or(temporal), false) AS temporal, coalesce(bool_or(no_evidence), false) AS no_evidence FROM vn LEFT JOIN (SELECT src, bool_or(role = 'contradicts') AS contradiction, bool_or(valid_from <> '') AS temporal, bool_or(source_id = '') AS no_evidence FROM ve GROUP BY src) ON src = id GROUP BY incident)"))
def coverage_gate(spark, d):
    """Shares of incidents that show each feature, against the least share wanted."""
    n, e = visible(spark, d)
    marks = e.groupBy(F.col("src").alias("id")).agg(F.bool_or(F.col("role") == "contradicts").alias("contradiction"), F.bool_or(F.col("valid_from") != "").alias("temporal"), F.bool_or(F.col("source_id") == "").alias("no_evidence"))
    g = n.join(marks, "id", "left").groupBy("incident").agg((F.count_if("root") > 1).alias("multi_root"), F.bool_or(F.col("id") % 10 == 0).alias("hyperedge"), *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("contradiction", "temporal", "no_evidence")])
    shares = g.agg(*[F.avg(F.col(k).cast("int")).alias(k) for k in GATES])
    return shares.select(F.inline(F.array(*[F.struct(F.lit(k).alias("gate"), F.round(k, 9).alias("share"), (F.col(k) >= v).alias("passed")) for k, v in GATES.items()])))


@query("quantize_predictive")
def quantize_predictive(spark, d):
    """Per block of 64 vectors, each coded after the one before it."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("vec_id")
        x = np.stack(block["v"].to_list())
        codes, decoded, _ = predictive_codes(x)
        return pd.DataFrame({"vec_id": block["vec_id"].to_numpy(), "code_sum": codes.sum(1).astype(np.int64), "exceptions": (codes == -128).sum(1).astype(np.int64), "error": np.abs(decoded - x).max(1)})

    e = table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 64).alias("b"), F.col("embedding").cast("array<double>").alias("v"))
    return e.groupBy("b").applyInPandas(run, "vec_id bigint, code_sum bigint, exceptions bigint, error double")


RECODE = """qe AS (SELECT min(list_min(embedding::DOUBLE[])) AS lo, (max(list_max(embedding::DOUBLE[])) - min(list_min(embedding::DOUBLE[]))) / 255 AS sc FROM embeddings),
qr AS (SELECT id, vec AS v, list_transform(vec, lambda x: lo + sc * round_even((x - lo) / sc, 0)) AS vec FROM n, qe)"""
_NEAR = "SELECT query_id, node_id FROM (SELECT a.id AS query_id, b.id AS node_id, row_number() OVER (PARTITION BY a.id ORDER BY {c} DESC, b.id) AS rank FROM n a, {t} b WHERE a.id % 20 = 0) WHERE rank <= 10"
_NEARS = f"({_NEAR.format(c=COS, t='n')}) x JOIN ({_NEAR.format(c=COS, t='qr')}) y USING (query_id, node_id)"


@query("quantize_metrics", duck(f"SELECT round(mse, 9) AS mse, round(mse / var, 9) AS normalized, round(2e0 * tp / (2 * tp + fp + fn), 9) AS f1_at_zero, (SELECT count(*) FROM {_NEARS}) / (10e0 * (SELECT count(*) FROM n WHERE id % 20 = 0)) AS top10_overlap FROM (SELECT avg((x - y) * (x - y)) AS mse, var_pop(x) AS var, count(*) FILTER (x >= 0 AND y >= 0) AS tp, count(*) FILTER (x < 0 AND y >= 0) AS fp, count(*) FILTER (x >= 0 AND y < 0) AS fn FROM (SELECT unnest(v) AS x, unnest(vec) AS y FROM qr))", RECODE))
def quantize_metrics(spark, d):
    """What 8-bit codes over the common range lose: squared error, sign agreement, neighbours kept."""
    n = P.nodes(spark, d).select("id", "vec")
    ends = n.agg(F.min(F.array_min("vec")).alias("lo"), ((F.max(F.array_max("vec")) - F.min(F.array_min("vec"))) / 255).alias("sc"))
    coded = n.crossJoin(F.broadcast(ends)).select("id", F.col("vec").alias("v"), F.transform("vec", lambda x: F.col("lo") + F.col("sc") * F.rint((x - F.col("lo")) / F.col("sc"))).alias("vec"))  # one row
    x, y = F.col("p.v"), F.col("p.vec")
    tp, fp, fn = F.count_if((x >= 0) & (y >= 0)), F.count_if((x < 0) & (y >= 0)), F.count_if((x >= 0) & (y < 0))
    figures = coded.select(F.explode(F.arrays_zip("v", "vec")).alias("p")).agg(F.avg((x - y) * (x - y)).alias("mse"), F.var_pop(x).alias("var"), (2.0 * tp / (2 * tp + fp + fn)).alias("f1"))
    q = query_vectors(spark, d)
    keys = ["query_id", "node_id"]
    kept = retrieve.knn(n, q, 10).select(*keys).join(retrieve.knn(coded.select("id", "vec"), q, 10).select(*keys), keys).agg(F.count("*").alias("kept"))
    asked = q.agg(F.count("*").alias("asked"))
    return figures.crossJoin(kept).crossJoin(asked).select(F.round("mse", 9).alias("mse"), F.round(F.col("mse") / F.col("var"), 9).alias("normalized"), F.round("f1", 9).alias("f1_at_zero"), (F.col("kept") / (10.0 * F.col("asked"))).alias("top10_overlap"))  # one row each
