"""Provenance, ingestion, learning, evaluation and encodings over the projected tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evigraph import project as P
from evigraph.functions import scalar as S
from evigraph.operators import ranges, resolve, retrieve, store
from evigraph.plans.basics import BOND, RFC, SPIRAL, VC, cells, visible
from evigraph.project import duck, table
from evigraph.registry import query
from evigraph.schema import LIFECYCLES, RELATIONS

KNOWN = ", ".join(f"'{x}'" for x in LIFECYCLES)
FINDINGS = f"""CASE WHEN lifecycle NOT IN ({KNOWN}) THEN 'INVALID_EVIDENCE_STATE' END, CASE WHEN origin IN ('observed', 'discovered') AND source_id = '' THEN 'MISSING_EVIDENCE' END,
 CASE WHEN origin = 'inferred' AND derivation = '' THEN 'INFERRED_WITHOUT_DERIVATION' END, CASE WHEN role = 'compressed' AND derivation = '' THEN 'COMPRESSED_WITHOUT_MECHANISM' END, CASE WHEN valid_from <> '' AND NOT regexp_matches(valid_from, '{RFC}') THEN 'INVALID_TEMPORAL_METADATA' END"""


def findings():
    """Codes of what is wrong with an edge's provenance, in a fixed order."""
    c = F.col
    return F.array_compact(
        F.array(
            F.when(~c("lifecycle").isin(*LIFECYCLES), "INVALID_EVIDENCE_STATE"),
            F.when(c("origin").isin("observed", "discovered") & (c("source_id") == ""), "MISSING_EVIDENCE"),
            F.when((c("origin") == "inferred") & (c("derivation") == ""), "INFERRED_WITHOUT_DERIVATION"),
            F.when((c("role") == "compressed") & (c("derivation") == ""), "COMPRESSED_WITHOUT_MECHANISM"),
            F.when((c("valid_from") != "") & S.rfc3339(c("valid_from")).isNull(), "INVALID_TEMPORAL_METADATA"),
        )
    )


@query("edge_provenance", duck(f"SELECT edge_id, CASE WHEN lifecycle IN ({KNOWN}) THEN lifecycle ELSE 'invalidated' END AS state, array_to_string(list_filter([{FINDINGS}], lambda x: x IS NOT NULL), ',') AS findings FROM ve"))
def edge_provenance(spark, d):
    state = F.when(F.col("lifecycle").isin(*LIFECYCLES), F.col("lifecycle")).otherwise("invalidated")
    return visible(spark, d)[1].select("edge_id", state.alias("state"), F.concat_ws(",", findings()).alias("findings"))


@query("provenance_report", duck(f"SELECT code, count(*) AS n FROM (SELECT unnest([{FINDINGS}]) AS code FROM ve) WHERE code IS NOT NULL GROUP BY code"))
def provenance_report(spark, d):
    return visible(spark, d)[1].select(F.explode(findings()).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("lattice_quality", duck("SELECT round((SELECT avg(list_dot_product(x.vec, y.vec) / (sqrt(list_dot_product(x.vec, x.vec)) * sqrt(list_dot_product(y.vec, y.vec)))) FROM vc a JOIN vc b ON a.id < b.id AND greatest(abs(a.q - b.q), abs(a.r - b.r), abs(a.q - b.q + a.r - b.r)) = 1 JOIN vn x ON x.id = a.id JOIN vn y ON y.id = b.id), 6) AS neighbour_cosine, (SELECT avg((greatest(abs(a.q - b.q), abs(a.r - b.r), abs(a.q - b.q + a.r - b.r)) <= 2)::INT) FROM ve e JOIN vc a ON a.id = e.src JOIN vc b ON b.id = e.dst) AS near_edges", SPIRAL, VC))
def lattice_quality(spark, d):
    n, e = visible(spark, d)
    c = cells(spark, d)
    pairs = store.hex_neighbours(c).filter("id < neighbour")
    v = n.select("id", "vec")
    cos = pairs.join(v, "id").join(v.select(F.col("id").alias("neighbour"), F.col("vec").alias("other")), "neighbour").agg(F.round(F.avg(S.cosine(F.col("vec"), F.col("other"))), 6).alias("neighbour_cosine"))
    a, b = c.select(F.col("id").alias("src"), F.col("q").alias("q1"), F.col("r").alias("r1")), c.select(F.col("id").alias("dst"), F.col("q").alias("q2"), F.col("r").alias("r2"))
    near = e.join(a, "src").join(b, "dst").agg(F.avg((S.hex_distance(F.col("q1"), F.col("r1"), F.col("q2"), F.col("r2")) <= 2).cast("int")).alias("near_edges"))
    return cos.join(near)


@query("lattice_placement", "SELECT vec_id AS id, lag(vec_id) OVER (PARTITION BY label % 3 ORDER BY label, vec_id) AS chained_from, CASE WHEN lag(label) OVER (PARTITION BY label % 3 ORDER BY label, vec_id) = label THEN 'sigma' WHEN lag(label) OVER (PARTITION BY label % 3 ORDER BY label, vec_id) IS NULL THEN NULL ELSE 'synthetic' END AS bond, row_number() OVER (PARTITION BY label % 3 ORDER BY label, vec_id) - 1 AS place FROM embeddings")
def lattice_placement(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), (F.col("label") % 3).alias("layer"), ranges.bucket("vec_id").alias("b"))
    rows = ranges.before(rows, ["layer"], ["label", "b"], ["label", "id"], {"chained_from": F.col("id"), "last_label": F.col("label")}, count="place")
    bond = F.when(F.col("last_label") == F.col("label"), "sigma").when(F.col("last_label").isNotNull(), "synthetic")
    return rows.select("id", "chained_from", bond.alias("bond"), "place")


ACT = "act0 AS (SELECT id, 1.0::DOUBLE AS a FROM vn WHERE symptom)"


def _act(k):
    return f"act{k} AS (SELECT id, max(a) AS a FROM (SELECT id, a FROM act{k - 1} UNION ALL SELECT f.t, p.a * f.w FROM act{k - 1} p JOIN f ON f.s = p.id) GROUP BY id)"


@query("lattice_activation", duck("SELECT id, round(a, 9) AS activation FROM act3", f"f AS (SELECT src AS s, dst AS t, {BOND} AS w FROM ve UNION ALL SELECT dst, src, {BOND} FROM ve)", ACT, *[_act(k) for k in (1, 2, 3)]))
def lattice_activation(spark, d):
    """Three rounds of the strongest signal over bonds in either direction."""
    n, e = visible(spark, d)
    seeds = n.filter("symptom").select("id", F.lit(1.0).alias("a"))
    return retrieve.activate(seeds, e).select("id", F.round("a", 9).alias("activation"))


@query("hyperedge_expand", duck("SELECT 'h' || g AS hyperedge_group_id, unnest([id, id + 1, id + 2]) AS src, id + 3 AS dst, 3 AS arity FROM (SELECT id, id // 10 AS g FROM n WHERE id % 10 = 0 AND id + 3 < (SELECT n FROM s))"))
def hyperedge_expand(spark, d):
    n = P.nodes(spark, d)
    last = F.lit(table(spark, d, "embeddings").count())
    i = F.col("id")
    h = n.filter((i % 10 == 0) & (i + 3 < last)).select(F.concat(F.lit("h"), F.floor(i / 10).cast("string")).alias("hyperedge_group_id"), F.array(i, i + 1, i + 2).alias("sources"), (i + 3).alias("dst"))
    return h.select("hyperedge_group_id", F.explode("sources").alias("src"), "dst", F.lit(3).alias("arity"))


@query("hyperedge_complete", duck("SELECT g, list_sort(list(src)) = list_sort(any_value(declared)) AS complete FROM (SELECT id AS src, id // 10 AS g FROM vn WHERE id % 10 < 3) JOIN (SELECT id // 10 AS g, CASE WHEN id % 70 = 0 THEN [id, id + 1] ELSE [id, id + 1, id + 2] END AS declared FROM n WHERE id % 10 = 0) USING (g) GROUP BY g"))
def hyperedge_complete(spark, d):
    """Visible sources of each joint cause against those it declares; every seventh declares one less than it has."""
    i = F.col("id")
    declared = P.nodes(spark, d).filter(i % 10 == 0).select(F.floor(i / 10).alias("g"), F.when(i % 70 == 0, F.array(i, i + 1)).otherwise(F.array(i, i + 1, i + 2)).alias("declared"))
    members = visible(spark, d)[0].filter(i % 10 < 3).select(F.floor(i / 10).alias("g"), i.alias("src"))
    have = members.groupBy("g").agg(F.array_sort(F.collect_set("src")).alias("have"))
    return have.join(declared, "g").select("g", (F.col("have") == F.array_sort("declared")).alias("complete"))


@query("extract_chain", "SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS from_turn, CASE WHEN lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL THEN 'root' WHEN lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL THEN 'impact' ELSE 'node' END AS kind FROM conversations")
def extract_chain(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    before, after = F.lag("turn").over(w), F.lead("turn").over(w)
    return table(spark, d, "conversations").select("conv_id", "turn", before.alias("from_turn"), F.when(before.isNull(), "root").when(after.isNull(), "impact").otherwise("node").alias("kind"))


def _upsert(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("size"))
    old = c.filter(F.col("turn") % 2 == 0)
    new = c.withColumn("size", F.when(F.col("turn") % 4 == 2, F.col("size") + 1).otherwise(F.col("size"))).withColumn("seq", F.col("turn"))
    return store.upsert(old, new, ["conv_id", "turn"], ["role", "size"])


@query("extraction_upsert", "SELECT CASE WHEN turn % 2 = 1 THEN 'insert' WHEN turn % 4 = 2 THEN 'conflict' ELSE 'replay' END AS outcome, count(*) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations) GROUP BY 1")
def extraction_upsert(spark, d):
    parts = [p.agg(F.count("*").alias("n")).select(F.lit(k).alias("outcome"), "n") for p, k in zip(_upsert(spark, d), ("insert", "replay", "conflict"), strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("n > 0")


@query("extraction_conflicts", "SELECT conv_id, turn, length(text) AS stored, length(text) + 1 AS requested FROM conversations WHERE turn % 4 = 2")
def extraction_conflicts(spark, d):
    return _upsert(spark, d)[2].select("conv_id", "turn", F.col("old_size").alias("stored"), F.col("size").alias("requested"))


@query("idempotency_check", "SELECT page_id, CASE WHEN page_id % 2 = 1 THEN 201 WHEN page_id % 3 = 0 THEN 409 ELSE 200 END AS status FROM pages")
def idempotency_check(spark, d):
    """Requests by key against stored ones: an unknown key is new (201), the same text a replay (200), another a conflict
    (409). Of a text only its hash is stored."""
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("key-"), F.col("page_id").cast("string")).alias("key"), F.coalesce("url", F.lit("")).alias("url"))
    stored = p.filter("page_id % 2 = 0").select("key", S.fnv1a(F.col("url")).alias("hash"))
    sent = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("!"))).otherwise(F.col("url"))
    asked = p.select("page_id", "key", S.fnv1a(sent).alias("hash"), F.col("page_id").alias("seq"))
    new, same, other = store.upsert(stored, asked, ["key"], ["hash"])
    status = new.select("key", F.lit(201).alias("status")).unionByName(same.select("key", F.lit(200).alias("status"))).unionByName(other.select("key", F.lit(409).alias("status")))
    return asked.join(status, "key").select("page_id", "status")


LINES = "CASE page_id % 3 WHEN 0 THEN 'P' || page_id || chr(9) || 'hosted_in' || chr(9) || 'H' || (page_id % 7) WHEN 1 THEN '# note ' || page_id ELSE 'P' || page_id || chr(9) || 'Calls' END"


@query("relations_parse", f"SELECT page_id, p[1] AS subject, p[2] AS predicate, CASE WHEN len(p) >= 3 THEN p[3] END AS object, CASE WHEN len(p) < 3 THEN 'line ' || page_id || ': three columns expected' END AS error FROM (SELECT page_id, string_split(x, chr(9)) AS p FROM (SELECT page_id, {LINES} AS x FROM pages) WHERE x NOT LIKE '#%' AND trim(x) <> '')")
def relations_parse(spark, d):
    i = F.col("page_id").cast("string")
    line = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("P"), i, F.lit("\thosted_in\tH"), (F.col("page_id") % 7).cast("string"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("# note "), i)).otherwise(F.concat(F.lit("P"), i, F.lit("\tCalls")))
    rows = table(spark, d, "pages").select("page_id", line.alias("x")).filter("x NOT LIKE '#%' AND trim(x) <> ''").select("page_id", F.split("x", "\t").alias("p"))
    return rows.select("page_id", F.get("p", F.lit(0)).alias("subject"), F.get("p", F.lit(1)).alias("predicate"), F.get("p", F.lit(2)).alias("object"), F.when(F.size("p") < 3, F.concat(F.lit("line "), F.col("page_id").cast("string"), F.lit(": three columns expected"))).alias("error"))


PREDICATES = ["Deployed To", "calls", "Was-Directed-By", "married_to", "resulted in", "unknown thing"]
_ALIASES = ", ".join(f"('{a}', '{r}', '{dom}', '{ran}')" for r, (aliases, dom, ran) in RELATIONS.items() for a in (r, *aliases))


@query("ontology_validate", f"SELECT c_custkey, al.r AS relation, CASE WHEN al.r IS NULL THEN 'UNKNOWN_RELATION' WHEN al.dom <> '' AND al.dom <> t THEN 'DOMAIN_TYPE_MISMATCH' WHEN al.ran <> '' AND al.ran <> 'person' THEN 'RANGE_TYPE_MISMATCH' ELSE '' END AS warning FROM (SELECT c_custkey, {PREDICATES}[c_custkey % 6 + 1] AS p, CASE WHEN c_custkey % 2 = 0 THEN 'work' ELSE 'person' END AS t FROM customer) LEFT JOIN (VALUES {_ALIASES}) al(a, r, dom, ran) ON al.a = regexp_replace(lower(p), '[^a-z0-9]+', '_', 'g')")
def ontology_validate(spark, d):
    c = table(spark, d, "customer").select("c_custkey", P.pick(PREDICATES, F.col("c_custkey") % 6).alias("p"), F.when(F.col("c_custkey") % 2 == 0, "work").otherwise("person").alias("t"))
    c = c.select("c_custkey", S.canonical_relation(F.col("p")).alias("relation"), "t")
    kind = lambda k: F.create_map(*[F.lit(x) for r, v in RELATIONS.items() for x in (r, v[k])])[F.col("relation")]
    warning = F.when(F.col("relation").isNull(), "UNKNOWN_RELATION").when((kind(1) != "") & (kind(1) != F.col("t")), "DOMAIN_TYPE_MISMATCH").when((kind(2) != "") & (kind(2) != "person"), "RANGE_TYPE_MISMATCH").otherwise("")
    return c.select("c_custkey", "relation", warning.alias("warning"))


RESOLVE = """rec AS (SELECT n_nationkey AS id, n_name AS name, 'country' AS type, [substr(n_name, 1, 3), 'Republic of ' || n_name] AS aliases, n_regionkey AS ctx FROM nation UNION ALL SELECT 100 + r_regionkey, r_name, 'region', ['The ' || r_name], r_regionkey FROM region
 UNION ALL SELECT 200 + n_nationkey, n_name, 'team', ['Team ' || n_name], 9 FROM nation WHERE n_nationkey % 4 = 0),
nm AS (SELECT id, type, ctx, needle, max(w) AS lexical FROM (SELECT id, type, ctx, lower(name) AS needle, 1e0 AS w FROM rec UNION ALL SELECT id, type, ctx, lower(unnest(aliases)), 0.98e0 FROM rec) GROUP BY ALL),
mn AS (SELECT n_nationkey AS mention_id, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN substr(n_name, 1, 3) ELSE 'The ' || r_name END AS text, CASE n_nationkey % 5 WHEN 1 THEN 'country' WHEN 2 THEN 'city' ELSE '' END AS type, n_regionkey AS ctx FROM nation JOIN region ON n_regionkey = r_regionkey),
sc AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, id) AS k, lead(score) OVER (PARTITION BY mention_id ORDER BY score DESC, id) AS second FROM (SELECT mention_id, id, round(0.72 * lexical + 0.18 * CASE WHEN m.type = '' THEN 0.5 WHEN m.type = nm.type THEN 1 ELSE 0 END + 0.10 * (m.ctx = nm.ctx)::INT, 12) AS score FROM mn m JOIN nm ON nm.needle = lower(m.text)))"""


@query("entity_resolve", f"WITH {RESOLVE} SELECT mention_id, CASE WHEN score >= 0.65 AND NOT coalesce(score - second <= 0.05, false) THEN id END AS resolved, coalesce(score >= 0.65 AND score - second <= 0.05, false) AS ambiguous, score FROM mn LEFT JOIN (SELECT * FROM sc WHERE k = 1) USING (mention_id)")
def entity_resolve(spark, d):
    """Countries, regions and teams by name or alias; the type expected and shared context decide between equal names."""
    c, r = table(spark, d, "nation"), table(spark, d, "region")
    text = lambda *parts: F.concat(*[F.lit(p) if p[0].isupper() else F.col(p) for p in parts])
    ctx = lambda c: F.array(F.concat(F.lit("r"), F.col(c).cast("string"))) if isinstance(c, str) else F.array(F.lit(f"r{c}"))
    key = lambda c, k: (F.col(c) + k).cast("bigint").alias("id")
    records = c.select(key("n_nationkey", 0), F.col("n_name").alias("name"), F.lit("country").alias("type"), F.array(F.substring("n_name", 1, 3), text("Republic of ", "n_name")).alias("aliases"), ctx("n_regionkey").alias("context"))
    records = records.unionByName(r.select(key("r_regionkey", 100), F.col("r_name").alias("name"), F.lit("region").alias("type"), F.array(text("The ", "r_name")).alias("aliases"), ctx("r_regionkey").alias("context")))
    records = records.unionByName(c.filter("n_nationkey % 4 = 0").select(key("n_nationkey", 200), F.col("n_name").alias("name"), F.lit("team").alias("type"), F.array(text("Team ", "n_name")).alias("aliases"), ctx(9).alias("context")))
    i = F.col("n_nationkey")
    said = F.when(i % 3 == 0, F.col("n_name")).when(i % 3 == 1, F.substring("n_name", 1, 3)).otherwise(text("The ", "r_name"))
    mentions = c.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(i.alias("mention_id"), said.alias("text"), F.when(i % 5 == 1, "country").when(i % 5 == 2, "city").otherwise("").alias("type"), ctx("n_regionkey").alias("context"))
    return resolve.resolve(mentions, records)


EPISODES = """ep AS (SELECT event_id AS id, user_id % 3 AS tenant, event_type AS domain, CASE WHEN event_id % 10 < 6 THEN 'training' WHEN event_id % 10 < 9 THEN 'development' ELSE 'evaluation' END AS split, event_id % 4 AS version, event_id % 7 <> 0 AS verified, event_id % 3 <> 0 AS success,
 (event_id % 11) / 10.0::DOUBLE AS f1, (event_id % 9) / 8.0::DOUBLE AS coverage, (event_id % 5) / 10.0::DOUBLE AS calibration, (event_id % 400)::DOUBLE AS latency, event_id % 97 = 0 AND event_id % 4 = 3 AS unsafe, event_id % 41 = 0 AS hold, event_id % 4 AS dec_total, event_id % 4 AS dec_kept, event_id % 53 = 0 AS expired FROM events),
eu AS (SELECT *, CASE WHEN unsafe THEN -1.0 ELSE greatest(-1.0, least(1.0, 0.35 * success::INT + 0.20 * f1 + 0.15 * coverage + 0.10 + 0.10 + 0.10 * (1 - calibration) - least(0.05, latency * 0.00001))) END AS utility FROM ep),
ec AS (SELECT *, CASE WHEN unsafe THEN 'harmful' WHEN expired THEN 'stale' WHEN NOT verified OR split = 'evaluation' OR hold THEN 'never_eligible' WHEN success AND dec_total > 0 AND dec_kept = dec_total THEN 'decisive' WHEN NOT success AND coverage >= 0.75 THEN 'misleading' WHEN utility >= 0.55 OR success THEN 'useful' ELSE 'redundant' END AS class FROM eu)"""


def episodes(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select(
        i.alias("id"), (F.col("user_id") % 3).alias("tenant"), F.col("event_type").alias("domain"),
        F.when(i % 10 < 6, "training").when(i % 10 < 9, "development").otherwise("evaluation").alias("split"),
        (i % 4).alias("version"), (i % 7 != 0).alias("verified"), (i % 3 != 0).alias("success"), ((i % 11) / 10.0).alias("f1"), ((i % 9) / 8.0).alias("coverage"),
        ((i % 5) / 10.0).alias("calibration"), (i % 400).cast("double").alias("latency"), ((i % 97 == 0) & (i % 4 == 3)).alias("unsafe"), (i % 41 == 0).alias("hold"),
        (i % 4).alias("dec_total"), (i % 4).alias("dec_kept"), (i % 53 == 0).alias("expired"),
    )
    c = F.col
    benefit = 0.35 * c("success").cast("int") + 0.20 * c("f1") + 0.15 * c("coverage") + 0.10 * F.when(c("dec_total") > 0, c("dec_kept") / c("dec_total")).otherwise(1.0) + 0.10 + 0.10 * (1 - c("calibration"))
    e = e.withColumn("utility", F.when(c("unsafe"), -1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), benefit - F.least(F.lit(0.05), c("latency") * 0.00001)))))
    kind = (
        F.when(c("unsafe"), "harmful").when(c("expired"), "stale").when(~c("verified") | (c("split") == "evaluation") | c("hold"), "never_eligible")
        .when(c("success") & (c("dec_total") > 0) & (c("dec_kept") == c("dec_total")), "decisive").when(~c("success") & (c("coverage") >= 0.75), "misleading")
        .when((c("utility") >= 0.55) | c("success"), "useful").otherwise("redundant")
    )
    return e.withColumn("class", kind)


@query("learning_utility", f"WITH {EPISODES} SELECT id, round(utility, 6) AS utility FROM eu")
def learning_utility(spark, d):
    return episodes(spark, d).select("id", F.round("utility", 6).alias("utility"))


@query("utility_class", f"WITH {EPISODES} SELECT class, count(*) AS n FROM ec GROUP BY class")
def utility_class(spark, d):
    return episodes(spark, d).groupBy("class").agg(F.count("*").alias("n"))


@query("training_episodes", f"WITH {EPISODES} SELECT tenant, id FROM ec WHERE split = 'training' AND verified AND NOT hold AND NOT unsafe")
def training_episodes(spark, d):
    return episodes(spark, d).filter("split = 'training' AND verified AND NOT hold AND NOT unsafe").select("tenant", "id")


@query("retention_decisions", f"WITH {EPISODES} SELECT id, class, verified AND split = 'training' AND NOT unsafe AND NOT hold AS retain, class NOT IN ('decisive', 'useful') AS archive FROM ec WHERE tenant = 1 ORDER BY id LIMIT 1000")
def retention_decisions(spark, d):
    e = episodes(spark, d).filter("tenant = 1").orderBy("id").limit(1000)
    return e.select("id", "class", F.expr("verified AND split = 'training' AND NOT unsafe AND NOT hold").alias("retain"), (~F.col("class").isin("decisive", "useful")).alias("archive"))


@query("data_policy_metrics", f"WITH {EPISODES} SELECT tenant, count(*) AS episodes, coalesce(sum(dec_kept)::DOUBLE / nullif(sum(dec_total), 0), 1.0) AS decisive_retention, avg(expired::INT) AS expired_rate FROM ec GROUP BY tenant")
def data_policy_metrics(spark, d):
    kept = F.coalesce(F.try_divide(F.sum("dec_kept").cast("double"), F.sum("dec_total").cast("double")), F.lit(1.0))
    return episodes(spark, d).groupBy("tenant").agg(F.count("*").alias("episodes"), kept.alias("decisive_retention"), F.avg(F.col("expired").cast("int")).alias("expired_rate"))


POLICY = """pm AS (SELECT tenant, version, count(*) FILTER (split = 'training') AS n_train, count(*) FILTER (split = 'development') AS n_dev, round(coalesce(avg(utility) FILTER (split = 'training'), 0), 6) AS train_utility, round(coalesce(avg(utility) FILTER (split = 'development'), 0), 6) AS dev_utility, count(*) FILTER (unsafe) AS violations FROM ec WHERE verified AND NOT hold AND split <> 'evaluation' GROUP BY ALL),
dm AS (SELECT tenant, version, domain, avg(success::INT) AS rate FROM ec WHERE verified AND NOT hold AND split = 'development' GROUP BY ALL),
rg AS (SELECT c.tenant, c.version, round(greatest(0, max(b.rate - c.rate)), 6) AS regression FROM dm c JOIN dm b ON b.tenant = c.tenant AND b.domain = c.domain AND b.version = 0 WHERE c.version <> 0 GROUP BY ALL)"""


def policy_parts(spark, d):
    e = episodes(spark, d).filter("verified AND NOT hold AND split <> 'evaluation'")
    of = lambda s: F.round(F.coalesce(F.avg(F.when(F.col("split") == s, F.col("utility"))), F.lit(0.0)), 6)
    pm = e.groupBy("tenant", "version").agg(F.count_if(F.col("split") == "training").alias("n_train"), F.count_if(F.col("split") == "development").alias("n_dev"), of("training").alias("train_utility"), of("development").alias("dev_utility"), F.count_if("unsafe").alias("violations"))
    dm = e.filter("split = 'development'").groupBy("tenant", "version", "domain").agg(F.avg(F.col("success").cast("int")).alias("rate"))
    base = dm.filter("version = 0").select("tenant", "domain", F.col("rate").alias("base"))
    rg = dm.filter("version <> 0").join(base, ["tenant", "domain"]).groupBy("tenant", "version").agg(F.round(F.greatest(F.lit(0.0), F.max(F.col("base") - F.col("rate"))), 6).alias("regression"))
    return pm, rg


@query("policy_metrics", f"WITH {EPISODES}, {POLICY} SELECT * FROM pm")
def policy_metrics(spark, d):
    return policy_parts(spark, d)[0]


@query("domain_regression", f"WITH {EPISODES}, {POLICY} SELECT * FROM rg")
def domain_regression(spark, d):
    return policy_parts(spark, d)[1]


@query("policy_evaluate", f"WITH {EPISODES}, {POLICY} SELECT pm.tenant, pm.version, dev_utility, CASE WHEN n_train < 2 THEN 'insufficient training samples' WHEN n_dev < 1 THEN 'insufficient development samples' WHEN violations > 0 THEN 'policy has safety-negative episodes' WHEN regression > 0.02 THEN 'development domain regression exceeds configured limit' ELSE '' END AS reason FROM pm LEFT JOIN rg ON rg.tenant = pm.tenant AND rg.version = pm.version")
def policy_evaluate(spark, d):
    pm, rg = policy_parts(spark, d)
    reason = F.when(F.col("n_train") < 2, "insufficient training samples").when(F.col("n_dev") < 1, "insufficient development samples").when(F.col("violations") > 0, "policy has safety-negative episodes").when(F.col("regression") > 0.02, "development domain regression exceeds configured limit").otherwise("")
    return pm.join(rg, ["tenant", "version"], "left").select("tenant", "version", "dev_utility", reason.alias("reason"))


@query("policy_recommend", f"WITH {EPISODES}, {POLICY} SELECT tenant, arg_max(version, (dev_utility, -version)) AS recommended FROM (SELECT pm.*, b.dev_utility AS base FROM pm JOIN rg ON rg.tenant = pm.tenant AND rg.version = pm.version JOIN pm b ON b.tenant = pm.tenant AND b.version = 0 WHERE pm.n_train >= 2 AND pm.n_dev >= 1 AND pm.violations = 0 AND regression <= 0.02) WHERE dev_utility - base >= 0.02 GROUP BY tenant")
def policy_recommend(spark, d):
    pm, rg = policy_parts(spark, d)
    base = pm.filter("version = 0").select("tenant", F.col("dev_utility").alias("base"))
    ok = pm.join(rg, ["tenant", "version"]).join(base, "tenant").filter("n_train >= 2 AND n_dev >= 1 AND violations = 0 AND regression <= 0.02 AND dev_utility - base >= 0.02")
    return ok.groupBy("tenant").agg(F.max(F.struct("dev_utility", (-F.col("version")).alias("v"))).alias("x")).select("tenant", (-F.col("x.v")).alias("recommended"))


@query("current_policy", f"WITH {EPISODES} SELECT tenant, arg_max(version, id) AS version FROM ep GROUP BY tenant")
def current_policy(spark, d):
    return episodes(spark, d).groupBy("tenant").agg(F.max_by("version", "id").alias("version"))


@query("episode_validate", f"WITH {EPISODES} SELECT split, count(*) AS n, count(*) FILTER (f1 BETWEEN 0 AND 1 AND coverage BETWEEN 0 AND 1 AND latency >= 0 AND dec_kept <= dec_total) AS valid FROM ep GROUP BY split")
def episode_validate(spark, d):
    ok = F.expr("f1 BETWEEN 0 AND 1 AND coverage BETWEEN 0 AND 1 AND latency >= 0 AND dec_kept <= dec_total")
    return episodes(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.count_if(ok).alias("valid"))


TRAJ = "tr AS (SELECT user_id, event_id, round(value / (value + 50.0::DOUBLE), 9) AS energy, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), dl AS (SELECT *, energy - lag(energy) OVER (PARTITION BY user_id ORDER BY i) AS delta FROM tr)"
#: Fixed values of the trajectory test.
EQUILIBRIUM, EPSILON = 0.15, 1e-9


def trajectory(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("user_id", "event_id", F.round(F.col("value") / (F.col("value") + 50.0), 9).alias("energy"), (F.row_number().over(w) - 1).alias("i"))
    rows = rows.withColumn("delta", F.col("energy") - F.lag("energy").over(Window.partitionBy("user_id").orderBy("i")))
    e, dl = F.col("energy"), F.col("delta")
    regime = F.when(dl.isNull(), F.when(e <= EQUILIBRIUM, "equilibrium").otherwise("insufficient_history")).when(dl > EPSILON, "diverging").when(e <= EQUILIBRIUM, "equilibrium").when(dl < -EPSILON, "descending").otherwise("marginal")
    return rows.withColumn("regime", regime)


REGIME = f"CASE WHEN delta IS NULL THEN CASE WHEN energy <= {EQUILIBRIUM} THEN 'equilibrium' ELSE 'insufficient_history' END WHEN delta > {EPSILON} THEN 'diverging' WHEN energy <= {EQUILIBRIUM} THEN 'equilibrium' WHEN delta < -{EPSILON} THEN 'descending' ELSE 'marginal' END"


@query("lyapunov_trajectory", f"WITH {TRAJ} SELECT user_id, i, energy, round(delta, 9) AS delta, {REGIME} AS regime FROM dl")
def lyapunov_trajectory(spark, d):
    return trajectory(spark, d).select("user_id", "i", "energy", F.round("delta", 9).alias("delta"), "regime")


@query("lyapunov_certificate", f"WITH {TRAJ} SELECT user_id, arg_min(energy, i) AS first_energy, arg_max(energy, i) AS last_energy, count(*) FILTER (delta > {EPSILON}) AS diverging, max(i) - coalesce(max(i) FILTER (energy > {EQUILIBRIUM}), -1) AS dwell, arg_max(energy, i) <= {EQUILIBRIUM} AS goal FROM dl GROUP BY user_id")
def lyapunov_certificate(spark, d):
    t = trajectory(spark, d)
    last = F.max_by("energy", "i")
    return t.groupBy("user_id").agg(F.min_by("energy", "i").alias("first_energy"), last.alias("last_energy"), F.count_if(F.col("delta") > EPSILON).alias("diverging"), (F.max("i") - F.coalesce(F.max(F.when(F.col("energy") > EQUILIBRIUM, F.col("i"))), F.lit(-1))).alias("dwell"), (last <= EQUILIBRIUM).alias("goal"))


@query("mcnemar", "SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS b, count(*) FILTER (quality = 0 AND toxic = 0) AS c FROM labels")
def mcnemar(spark, d):
    """Discordant pairs of control (quality) and treatment (1 - toxic)."""
    return table(spark, d, "labels").agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("b"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("c"))


@query("holm_adjust", "SELECT test, round(max(p * (m - k + 1)) OVER (ORDER BY k), 9) AS adjusted FROM (SELECT l_linenumber AS test, 0.001 * l_linenumber * l_linenumber AS p, row_number() OVER (ORDER BY l_linenumber) AS k, count(*) OVER () AS m FROM (SELECT DISTINCT l_linenumber FROM lineitem))")
def holm_adjust(spark, d):
    """Step-down adjusted levels of one p value a test: a handful of rows."""
    t = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("test")).distinct().withColumn("p", 0.001 * F.col("test") * F.col("test"))
    w = Window.orderBy("p")
    t = t.withColumn("k", F.row_number().over(w)).withColumn("m", F.count("*").over(Window.partitionBy()))
    return t.select("test", F.round(F.max(F.col("p") * (F.col("m") - F.col("k") + 1)).over(w), 9).alias("adjusted"))


@query("quantize_global", "SELECT vec_id, len(list_filter(list_transform(embedding::DOUBLE[], lambda v: round_even((v - lo) / ((hi - lo) / 255), 0)), lambda q: q > 127)) AS above, list_sum(list_transform(embedding::DOUBLE[], lambda v: round_even((v - lo) / ((hi - lo) / 255), 0)))::BIGINT AS code_sum FROM embeddings, (SELECT min(list_min(embedding::DOUBLE[])) AS lo, max(list_max(embedding::DOUBLE[])) AS hi FROM embeddings)")
def quantize_global(spark, d):
    """8-bit codes over the common range, rounded half to even."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    ends = e.agg(F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi"))
    codes = F.transform("v", lambda x: F.rint((x - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 255)))
    e = e.join(F.broadcast(ends)).select("vec_id", codes.alias("q"))  # one row
    return e.select("vec_id", F.size(F.filter("q", lambda x: x > 127)).cast("bigint").alias("above"), F.aggregate("q", F.lit(0.0), lambda s, x: s + x).cast("bigint").alias("code_sum"))


@query("target_strength", duck("SELECT dst AS target, round(1 - list_product(list_transform(list(confidence), lambda c: 1 - greatest(0.0, least(1.0, c)))), 9) AS strength FROM ve GROUP BY dst"))
def target_strength(spark, d):
    """One minus the product of what each edge leaves open, folded in sorted order."""
    left = F.aggregate(F.array_sort(F.collect_list(S.clamp(F.col("confidence")))), F.lit(1.0), lambda s, x: s * (1 - x))
    return visible(spark, d)[1].groupBy(F.col("dst").alias("target")).agg(F.round(1 - left, 9).alias("strength"))


@query("target_ranking", duck("SELECT target, row_number() OVER (ORDER BY belief DESC, families DESC, best DESC, target) AS rk FROM (SELECT dst AS target, round((1 - exp(-0.7 * count(DISTINCT family) FILTER (role <> 'contradicts'))) * (1 - coalesce(max(confidence) FILTER (role = 'contradicts'), 0)), 9) AS belief, count(DISTINCT family) AS families, max(confidence) AS best FROM ve GROUP BY dst) ORDER BY rk LIMIT 50"))
def target_ranking(spark, d):
    e = visible(spark, d)[1]
    own = F.col("role") != "contradicts"
    t = e.groupBy(F.col("dst").alias("target")).agg(F.count_distinct(F.when(own, F.col("family"))).alias("support"), F.coalesce(F.max(F.when(~own, F.col("confidence"))), F.lit(0.0)).alias("against"), F.count_distinct("family").alias("families"), F.max("confidence").alias("best"))
    t = t.withColumn("belief", F.round((1 - F.exp(-0.7 * F.col("support"))) * (1 - F.col("against")), 9))
    top = t.orderBy(F.desc("belief"), F.desc("families"), F.desc("best"), "target").limit(50)  # a top-k report
    return top.select("target", F.row_number().over(Window.orderBy(F.desc("belief"), F.desc("families"), F.desc("best"), "target")).alias("rk"))
