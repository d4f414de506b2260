"""Scans, filters, joins, scalars and retrieval over the projected tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evigraph import project as P
from evigraph.functions import scalar as S
from evigraph.operators import retrieve, store
from evigraph.project import duck, table
from evigraph.registry import query

FLAT = "edge_id, src, dst, origin, role"


def visible(spark, d):
    v = P.snapshot(spark, d)
    n = P.nodes(spark, d)
    return store.snapshot_nodes(n, v), store.snapshot_edges(P.edges(spark, d), n, v)


def flat(e):
    return e.select("edge_id", "src", "dst", "origin", "role")


@query("snapshot_nodes", duck("SELECT id, incident, signature, root, created FROM vn"))
def snapshot_nodes(spark, d):
    return visible(spark, d)[0].select("id", "incident", "signature", "root", "created")


@query("snapshot_edges", duck(f"SELECT {FLAT}, confidence FROM ve"))
def snapshot_edges(spark, d):
    return visible(spark, d)[1].select("edge_id", "src", "dst", "origin", "role", "confidence")


@query("point_lookup", duck("SELECT id, incident, signature FROM n WHERE id IN (3, 17, 40, -1)"))
def point_lookup(spark, d):
    return P.nodes(spark, d).filter(F.col("id").isin(3, 17, 40, -1)).select("id", "incident", "signature")


@query("metadata_search", duck("SELECT edge_id, source_id FROM ve WHERE source_id = 'src3'"))
def metadata_search(spark, d):
    e = visible(spark, d)[1].withColumn("metadata", F.create_map(F.lit("source_id"), F.col("source_id")))
    return e.filter(F.col("metadata")["source_id"] == "src3").select("edge_id", "source_id")


AS_OF = "2024-01-15T00:00:00Z"
RFC = S.RFC3339.replace("'", "''")
VALID = f"(valid_from = '' OR (regexp_matches(valid_from, '{RFC}') AND try_cast(valid_from AS TIMESTAMPTZ) <= TIMESTAMPTZ '{AS_OF}'))"


@query("as_of_filter", duck(f"SELECT edge_id, valid_from FROM ve WHERE {VALID}"))
def as_of_filter(spark, d):
    e = visible(spark, d)[1]
    return e.filter((F.col("valid_from") == "") | (S.rfc3339(F.col("valid_from")) <= F.to_timestamp(F.lit(AS_OF)))).select("edge_id", "valid_from")


@query("temporal_page", duck(f"SELECT edge_id FROM ve WHERE source_id = 'src2' AND {VALID} ORDER BY edge_id LIMIT 20 OFFSET 5"))
def temporal_page(spark, d):
    e = visible(spark, d)[1].filter("source_id = 'src2'")
    ok = (F.col("valid_from") == "") | (S.rfc3339(F.col("valid_from")) <= F.to_timestamp(F.lit(AS_OF)))
    return e.filter(ok).orderBy("edge_id").offset(5).limit(20).select("edge_id")


EMP = "origin IN ('observed', 'discovered') AND role <> 'analogical'"


@query("mode_filter_core", duck(f"SELECT 'empirical' AS mode, edge_id FROM ve WHERE {EMP} UNION ALL SELECT 'balanced', edge_id FROM ve WHERE origin <> 'hypothetical' UNION ALL SELECT 'theoretical', edge_id FROM ve"))
def mode_filter_core(spark, d):
    return _modes(spark, d, lambda m: S.mode_core(F.col("origin"), F.col("role"), m), ("empirical", "balanced", "theoretical"))


def _modes(spark, d, test, modes):
    e = visible(spark, d)[1]
    mode = F.array_compact(F.array(*[F.when(test(m), m) for m in modes]))
    return e.select(F.explode(mode).alias("mode"), "edge_id")


@query("mode_filter_expand", duck(f"SELECT 'empirical' AS mode, edge_id FROM ve WHERE {EMP} AND (role <> 'compressed' OR derivation <> '') UNION ALL SELECT 'balanced', edge_id FROM ve WHERE origin <> 'hypothetical' UNION ALL SELECT 'theoretical', edge_id FROM ve"))
def mode_filter_expand(spark, d):
    return _modes(spark, d, lambda m: S.mode_expand(F.col("origin"), F.col("role"), F.col("derivation"), m), ("empirical", "balanced", "theoretical"))


@query("mode_filter_http", duck("SELECT 'empirical' AS mode, edge_id FROM ve WHERE origin IN ('observed', 'discovered') UNION ALL SELECT 'balanced', edge_id FROM ve WHERE origin <> 'hypothetical' UNION ALL SELECT 'exploratory', edge_id FROM ve"))
def mode_filter_http(spark, d):
    return _modes(spark, d, lambda m: S.mode_http(F.col("origin"), m), ("empirical", "balanced", "exploratory"))


@query("search_edge_filter", duck(f"SELECT edge_id, lifecycle FROM ve WHERE lifecycle IN ('active', 'refuted') AND {EMP} AND (role <> 'compressed' OR derivation <> '')"))
def search_edge_filter(spark, d):
    return visible(spark, d)[1].filter(S.search_allowed(F.col("origin"), F.col("role"), F.col("derivation"), F.col("lifecycle"), "empirical")).select("edge_id", "lifecycle")


QSIG = (1 << 3) | (1 << 20)


@query("signature_plane", duck(f"SELECT id, signature FROM vn WHERE bit_count(signature & {QSIG}::BIGINT) >= greatest(1, bit_count({QSIG}::BIGINT) - 1)"))
def signature_plane(spark, d):
    return visible(spark, d)[0].filter(S.matches_plane(F.col("signature"), F.lit(QSIG).cast("bigint"))).select("id", "signature")


@query("signature_match", duck(f"SELECT q, count(*) AS n FROM vn, (SELECT unnest([0, {QSIG}]::BIGINT[]) AS q) WHERE q = 0 OR signature = 0 OR bit_count(signature & q) >= greatest(1, bit_count(q) - 1) GROUP BY q"))
def signature_match(spark, d):
    n = visible(spark, d)[0].withColumn("q", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(QSIG).cast("bigint"))))
    return n.filter(S.matches_signature(F.col("signature"), F.col("q"))).groupBy("q").agg(F.count("*").alias("n"))


@query("incoming_edges", duck("SELECT n.id, e.edge_id, e.src FROM vn n JOIN ve e ON e.dst = n.id WHERE n.symptom"))
def incoming_edges(spark, d):
    n, e = visible(spark, d)
    return n.filter("symptom").join(e, F.col("dst") == F.col("id")).select("id", "edge_id", "src")


@query("outgoing_edges", duck("SELECT n.id, e.edge_id, e.dst FROM vn n JOIN ve e ON e.src = n.id WHERE n.root"))
def outgoing_edges(spark, d):
    n, e = visible(spark, d)
    return n.filter("root").join(e, F.col("src") == F.col("id")).select("id", "edge_id", "dst")


SPIRAL = """sp AS (SELECT i, k, CASE WHEN i = 0 THEN 0 ELSE (i - 1 - 3 * k * (k - 1)) // greatest(k, 1) END AS side, CASE WHEN i = 0 THEN 0 ELSE (i - 1 - 3 * k * (k - 1)) % greatest(k, 1) END AS st
 FROM (SELECT i, CASE WHEN i = 0 THEN 0 ELSE ceil((sqrt(12.0 * i + 9) - 3) / 6)::BIGINT END AS k FROM (SELECT vec_id AS i FROM embeddings))),
cell AS (SELECT i, CASE side WHEN 0 THEN k WHEN 1 THEN k - st WHEN 2 THEN -st WHEN 3 THEN -k WHEN 4 THEN -k + st ELSE st END AS q, CASE side WHEN 0 THEN -st WHEN 1 THEN -k WHEN 2 THEN -k + st WHEN 3 THEN st WHEN 4 THEN k ELSE k - st END AS r FROM sp)"""


def cells(spark, d, layered=False):
    n = visible(spark, d)[0]
    q, r = S.hex_spiral(F.col("id"))
    return n.select("id", q.alias("q"), r.alias("r"), (F.col("layer") if layered else F.lit(0)).alias("layer"))


@query("hex_spiral", duck("SELECT i, q, r FROM cell", SPIRAL))
def hex_spiral(spark, d):
    q, r = S.hex_spiral(F.col("vec_id"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), q.alias("q"), r.alias("r"))


@query("hex_ordinal", duck("SELECT i, count(*) OVER (ORDER BY r, q) - 1 AS ordinal FROM cell WHERE greatest(abs(q), abs(r), abs(q + r)) <= 5", SPIRAL))
def hex_ordinal(spark, d):
    q, r = S.hex_spiral(F.col("vec_id"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), S.disk_ordinal(q, r, 5).alias("ordinal")).filter("ordinal IS NOT NULL")


@query("hex_distance", duck("SELECT e.edge_id, greatest(abs(a.q - b.q), abs(a.r - b.r), abs(a.q - b.q + a.r - b.r)) AS distance FROM ve e JOIN cell a ON a.i = e.src JOIN cell b ON b.i = e.dst", SPIRAL))
def hex_distance(spark, d):
    e, c = visible(spark, d)[1], cells(spark, d)
    a, b = c.select(F.col("id").alias("src"), F.col("q").alias("q1"), F.col("r").alias("r1")), c.select(F.col("id").alias("dst"), F.col("q").alias("q2"), F.col("r").alias("r2"))
    return e.join(a, "src").join(b, "dst").select("edge_id", S.hex_distance(F.col("q1"), F.col("r1"), F.col("q2"), F.col("r2")).alias("distance"))


VC = "vc AS (SELECT n.id, c.q, c.r, n.layer FROM vn n JOIN cell c ON c.i = n.id)"


@query("hex_neighbors", duck("SELECT a.id, b.id AS neighbour FROM vc a JOIN vc b ON (b.q - a.q, b.r - a.r) IN ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))", SPIRAL, VC))
def hex_neighbors(spark, d):
    return store.hex_neighbours(cells(spark, d))


@query("cross_layer_neighbors", duck("SELECT a.id, b.id AS neighbour FROM vc a JOIN vc b ON abs(b.q - a.q) <= 1 AND abs(b.r - a.r) <= 1 AND a.layer <> b.layer", SPIRAL, VC))
def cross_layer_neighbors(spark, d):
    return store.cross_layer_neighbours(cells(spark, d, True))


@query("lattice_cells", duck("SELECT a.id, a.q, a.r, a.layer, count(b.id) AS neighbours FROM vc a LEFT JOIN vc b ON (b.q - a.q, b.r - a.r) IN ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)) AND a.layer = b.layer GROUP BY ALL", SPIRAL, VC))
def lattice_cells(spark, d):
    c = cells(spark, d, True)
    k = store.hex_neighbours(c).groupBy("id").agg(F.count("*").alias("neighbours"))
    return c.join(k, "id", "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))


def KHOP(steps: str, hops: int) -> str:  # noqa: N802
    return f"SELECT id, node, min(h) AS hops FROM (WITH RECURSIVE kh AS (SELECT id, id AS node, 0 AS h FROM vn WHERE id % 20 = 0 UNION SELECT kh.id, u.b, kh.h + 1 FROM kh JOIN {steps} u ON u.a = kh.node WHERE kh.h < {hops}) SELECT * FROM kh) WHERE node <> id GROUP BY ALL"


ADJACENT = "(SELECT a.id AS a, b.id AS b FROM vc a JOIN vc b ON a.layer = b.layer AND (b.q - a.q, b.r - a.r) IN ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)))"


@query("lattice_khop_physical", duck(KHOP(ADJACENT, 2), SPIRAL, VC))
def lattice_khop_physical(spark, d):
    """Nodes within two steps between held cells that touch."""
    touch = store.hex_neighbours(cells(spark, d, True)).select(F.col("id").alias("src"), F.col("neighbour").alias("dst"))
    return retrieve.khop(visible(spark, d)[0].filter(F.col("id") % 20 == 0).select("id"), touch, 2)


UND = "u AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM ve UNION ALL SELECT dst, src FROM ve))"


@query("lattice_khop_bond", duck(KHOP("u", 3), UND))
def lattice_khop_bond(spark, d):
    n, e = visible(spark, d)
    return retrieve.khop(n.filter(F.col("id") % 20 == 0).select("id"), e, 3)


@query("lattice_capacity", "SELECT r, 1 + 3 * r * (r + 1) AS capacity, n, (n::DOUBLE / (1 + 3 * r * (r + 1))) AS utilization, ceil((-3 + sqrt(12.0 * n - 3)) / 6)::BIGINT AS minimum_radius FROM (SELECT unnest([5, 10, 20, 50]) AS r, (SELECT count(*) FROM embeddings) AS n)")
def lattice_capacity(spark, d):
    n = table(spark, d, "embeddings").agg(F.count("*").alias("n"))
    cap = 1 + 3 * F.col("r") * (F.col("r") + 1)
    return n.select(F.explode(F.array(*map(F.lit, (5, 10, 20, 50)))).alias("r"), "n").select("r", cap.alias("capacity"), "n", (F.col("n") / cap).alias("utilization"), F.ceil((F.sqrt(12.0 * F.col("n") - 3) - 3) / 6).alias("minimum_radius"))


@query("reopen_seeds", duck("SELECT DISTINCT e.dst AS seed FROM ve e JOIN vn n ON n.id = e.src WHERE n.root AND n.incident = 3"))
def reopen_seeds(spark, d):
    n, e = visible(spark, d)
    return n.filter("root AND incident = 3").join(e, F.col("src") == F.col("id")).select(F.col("dst").alias("seed")).distinct()


@query("unobserved_frontier", duck("SELECT DISTINCT e.dst AS node FROM ve e WHERE e.lifecycle = 'active' AND e.dst NOT IN (SELECT src FROM ve WHERE origin = 'observed')"))
def unobserved_frontier(spark, d):
    e = visible(spark, d)[1]
    seen = e.filter("origin = 'observed'").select(F.col("src").alias("node"))
    return e.filter("lifecycle = 'active'").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")


@query("attached_contradictions", duck("SELECT DISTINCT edge_id FROM ve WHERE role = 'contradicts' AND (src IN (SELECT id FROM vn WHERE incident < 4) OR dst IN (SELECT id FROM vn WHERE incident < 4))"))
def attached_contradictions(spark, d):
    n, e = visible(spark, d)
    e, ids = e.filter("role = 'contradicts'"), n.filter("incident < 4").select("id")
    return e.join(ids, F.col("src") == F.col("id")).select("edge_id").union(e.join(ids, F.col("dst") == F.col("id")).select("edge_id")).distinct()


@query("edge_validate", duck("SELECT edge_id, 'ENDPOINT_NOT_VISIBLE' AS faults FROM e WHERE src NOT IN (SELECT id FROM vn) OR dst NOT IN (SELECT id FROM vn)"))
def edge_validate(spark, d):
    return store.edge_faults(P.edges(spark, d), P.nodes(spark, d), P.snapshot(spark, d))


@query("tombstone_visibility", duck("SELECT e.edge_id FROM e WHERE created <= (SELECT v FROM s) AND edge_id NOT IN (SELECT edge_id FROM ve)"))
def tombstone_visibility(spark, d):
    e = P.edges(spark, d).filter(store.visible(P.snapshot(spark, d)))
    return e.join(visible(spark, d)[1].select("edge_id"), "edge_id", "left_anti").select("edge_id")


@query("compact_snapshot", duck("SELECT 'nodes' AS kind, count(*) AS kept, max(id) AS last FROM vn UNION ALL SELECT 'edges', count(*), max(edge_id) FROM ve"))
def compact_snapshot(spark, d):
    n, e = store.compact(P.nodes(spark, d), P.edges(spark, d), P.snapshot(spark, d))
    agg = lambda df, kind, c: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("kept"), F.max(c).alias("last"))
    return agg(n, "nodes", "id").unionByName(agg(e, "edges", "edge_id"))


@query("inspect_stats", duck("SELECT (SELECT count(*) FROM vn) AS nodes, (SELECT count(*) FROM ve) AS edges, (SELECT count(*) FROM n) - (SELECT count(*) FROM vn) AS hidden_nodes, (SELECT count(DISTINCT signature) FROM vn) AS signatures, (SELECT count(*) FROM vn WHERE root) AS roots"))
def inspect_stats(spark, d):
    n, e = visible(spark, d)
    a = n.agg(F.count("*").alias("nodes"), F.count_distinct("signature").alias("signatures"), F.count_if("root").alias("roots"))
    b = e.agg(F.count("*").alias("edges"))
    c = P.nodes(spark, d).agg(F.count("*").alias("k"))
    return a.join(b).join(c).select("nodes", "edges", (F.col("k") - F.col("nodes")).alias("hidden_nodes"), "signatures", "roots")


@query("validate_report", duck("SELECT 'VECTOR_DIMENSION' AS code, count(*) AS n FROM n WHERE len(vec) <> 64 UNION ALL SELECT 'EDGE_ENDPOINT', count(*) FROM e WHERE src NOT IN (SELECT id FROM n) OR dst NOT IN (SELECT id FROM n) UNION ALL SELECT 'CONFIDENCE', count(*) FROM e WHERE NOT confidence BETWEEN 0 AND 1 UNION ALL SELECT 'DUPLICATE_ID', count(*) FROM (SELECT id FROM n GROUP BY id HAVING count(*) > 1)"))
def validate_report(spark, d):
    n, e = P.nodes(spark, d), P.edges(spark, d)
    bad = lambda df, code: df.agg(F.lit(code).alias("code"), F.count("*").alias("n"))
    ids = n.select("id")
    loose = e.join(ids, F.col("src") == F.col("id"), "left_anti").select("edge_id").union(e.join(ids, F.col("dst") == F.col("id"), "left_anti").select("edge_id")).distinct()
    return bad(n.filter(F.size("vec") != 64), "VECTOR_DIMENSION").union(bad(loose, "EDGE_ENDPOINT")).union(bad(e.filter(~F.col("confidence").between(0, 1)), "CONFIDENCE")).union(bad(n.groupBy("id").count().filter("count > 1"), "DUPLICATE_ID"))


def query_vectors(spark, d):
    """The stated query set of searches: every node whose id is divisible by 20."""
    return P.nodes(spark, d).filter(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "vec")


COS = "list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec)))"


@query("vector_topk", duck(f"SELECT b.id AS node_id, round({COS}, 6) AS score FROM n a, vn b WHERE a.id = 7 ORDER BY {COS} DESC, b.id LIMIT 10"))
def vector_topk(spark, d):
    v = P.nodes(spark, d).filter("id = 7").select("vec").first()[0]
    return retrieve.top_k(visible(spark, d)[0], v, 10).withColumn("score", F.round("score", 6))


KNN = lambda rows, k, extra="": f"SELECT query_id, node_id, round(score, 6) AS score, rank FROM (SELECT a.id AS query_id, b.id AS node_id, {COS} AS score, row_number() OVER (PARTITION BY a.id ORDER BY {COS} DESC, b.id) AS rank FROM n a, {rows} b WHERE a.id % 20 = 0) WHERE rank <= {k} {extra}"


@query("vector_topk_snapshot", duck(KNN("vn", 5, "AND score >= -0.5")))
def vector_topk_snapshot(spark, d):
    return retrieve.knn(visible(spark, d)[0], query_vectors(spark, d), 5, -0.5).withColumn("score", F.round("score", 6))


@query("vector_knn_join", duck(KNN("n", 10)))
def vector_knn_join(spark, d):
    return retrieve.knn(P.nodes(spark, d), query_vectors(spark, d), 10).withColumn("score", F.round("score", 6))


@query("recall_at_k", duck(f"SELECT x.query_id, count(y.node_id) / 10.0 AS recall FROM ({KNN('n', 10)}) x LEFT JOIN ({KNN('vn', 10)}) y ON x.query_id = y.query_id AND x.node_id = y.node_id GROUP BY x.query_id"))
def recall_at_k(spark, d):
    q = query_vectors(spark, d)
    truth, got = retrieve.knn(P.nodes(spark, d), q, 10).select("query_id", "node_id"), retrieve.knn(visible(spark, d)[0], q, 10).select("query_id", "node_id", F.lit(1).alias("hit"))
    return truth.join(got, ["query_id", "node_id"], "left").groupBy("query_id").agg((F.count("hit") / 10.0).alias("recall"))


@query("candidate_set", duck(f"SELECT DISTINCT id FROM (SELECT id FROM vn WHERE bit_count(signature & {QSIG}::BIGINT) >= 1 UNION ALL (SELECT b.id FROM n a, vn b WHERE a.id = 7 ORDER BY {COS} DESC, b.id LIMIT 64))"))
def candidate_set(spark, d):
    n = visible(spark, d)[0]
    v = P.nodes(spark, d).filter("id = 7").select("vec").first()[0]
    return n.filter(S.matches_plane(F.col("signature"), F.lit(QSIG).cast("bigint"))).select("id").union(retrieve.top_k(n, v, retrieve.CANDIDATE_FLOOR).select("node_id")).distinct()


@query("anchor_rank", duck(f"SELECT b.id, round({COS} + CASE WHEN b.symptom OR b.impact THEN 0.15 ELSE 0 END, 6) AS anchor_score FROM n a, vn b WHERE a.id = 7 ORDER BY {COS} + CASE WHEN b.symptom OR b.impact THEN 0.15 ELSE 0 END DESC, b.id LIMIT 12"))
def anchor_rank(spark, d):
    v = P.nodes(spark, d).filter("id = 7").select("vec").first()[0]
    score = S.cosine(F.col("vec"), F.array(*map(F.lit, v))) + F.when(F.col("symptom") | F.col("impact"), 0.15).otherwise(0.0)
    return visible(spark, d)[0].select("id", score.alias("s")).orderBy(F.desc("s"), "id").limit(12).select("id", F.round("s", 6).alias("anchor_score"))


@query("incident_concentration", duck(f"SELECT max(k)::DOUBLE / sum(k) AS share FROM (SELECT incident, count(*) AS k FROM (SELECT b.incident FROM n a, vn b WHERE a.id = 7 ORDER BY {COS} DESC, b.id LIMIT 12) GROUP BY incident)"))
def incident_concentration(spark, d):
    n = visible(spark, d)[0]
    v = P.nodes(spark, d).filter("id = 7").select("vec").first()[0]
    top = retrieve.top_k(n, v, 12).join(n, F.col("node_id") == F.col("id"))
    return top.groupBy("incident").agg(F.count("*").alias("k")).agg((F.max("k") / F.sum("k")).alias("share"))


FNV = "list_reduce(list_transform(range(octet_length(encode(x))), lambda i: ('0x' || substr(hex(encode(x)), 2 * i + 1, 2))::UHUGEINT), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 1469598103934665603::UHUGEINT)"


@query("fnv1a_hash", f"SELECT id, CASE WHEN h >= 9223372036854775808 THEN (h::HUGEINT - 18446744073709551616)::BIGINT ELSE h::BIGINT END AS hash FROM (SELECT id, {FNV} AS h FROM (SELECT page_id AS id, url AS x FROM pages))")
def fnv1a_hash(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), S.fnv1a(F.col("url")).alias("hash"))


@query("text_signature", f"SELECT id, (1::BIGINT << (h % 16)::INT) | (1::BIGINT << (16 + (h // 256) % 16)::INT) AS signature FROM (SELECT id, {FNV} AS h FROM (SELECT page_id AS id, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) AS x FROM pages))")
def text_signature(spark, d):
    h = S.fnv1a(S.entity_name(F.col("url")))
    one = F.lit(1).cast("bigint")
    sig = F.call_function("shiftleft", one, h.bitwiseAND(F.lit(15)).cast("int")).bitwiseOR(F.call_function("shiftleft", one, (16 + F.shiftright(h, 8).bitwiseAND(F.lit(15))).cast("int")))
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), sig.alias("signature"))


@query("normalise_names", "SELECT page_id, trim(regexp_replace(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) AS entity, regexp_replace(regexp_replace(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS relation FROM pages")
def normalise_names(spark, d):
    return table(spark, d, "pages").select("page_id", S.entity_name(F.col("url")).alias("entity"), S.relation_name(F.col("url")).alias("relation"))


TOK = "list_distinct(list_filter(string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''))"


@query("token_jaccard", f"SELECT a, b, CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) ELSE 0 END AS overlap FROM (SELECT item_id AS a, item_id + 1 AS b, {TOK} AS x, lead({TOK}) OVER (ORDER BY item_id) AS y FROM benchmark) WHERE y IS NOT NULL")
def token_jaccard(spark, d):
    b = table(spark, d, "benchmark").select("item_id", S.tokens(F.col("text")).alias("t"))
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return b.join(nxt, "item_id").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), S.jaccard(F.col("t"), F.col("u")).alias("overlap"))


@query("rfc3339_parse", f"SELECT event_id, epoch(try_cast(x AS TIMESTAMPTZ))::BIGINT AS seconds FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+02:00') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS x FROM events) WHERE regexp_matches(x, '{RFC}')")
def rfc3339_parse(spark, d):
    e = table(spark, d, "events")
    fmt = lambda f: F.date_format("ts", f)
    x = F.when(F.col("event_id") % 4 == 0, fmt("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 4 == 1, fmt("yyyy-MM-dd")).when(F.col("event_id") % 4 == 2, F.concat(fmt("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).otherwise(fmt("yyyy-MM-dd'T'HH:mm:ss"))
    return e.select("event_id", F.unix_timestamp(S.rfc3339(x)).alias("seconds")).filter("seconds IS NOT NULL")


@query("metadata_codec", duck("SELECT edge_id, 'source_id=' || lower(hex(source_id)) || ';family=' || lower(hex(family)) AS encoded, source_id AS decoded FROM ve"))
def metadata_codec(spark, d):
    enc = F.concat(F.lit("source_id="), F.lower(F.hex("source_id")), F.lit(";family="), F.lower(F.hex("family")))
    e = visible(spark, d)[1].select("edge_id", enc.alias("encoded"))
    return e.withColumn("decoded", F.unhex(F.str_to_map("encoded", F.lit(";"), F.lit("="))["source_id"]).cast("string"))


def causal_queries(spark, d):
    return P.nodes(spark, d).filter("symptom").select(F.col("id").alias("query_id"), "vec", "signature")


REV = """walk AS (SELECT id AS anchor, id AS at_, []::BIGINT[] AS rev, 1.0::DOUBLE AS score, false AS con, 0 AS depth, [id] AS seen FROM vn WHERE {anchors}
 UNION ALL SELECT w.anchor, e.src, list_append(w.rev, e.edge_id), w.score * e.confidence, w.con OR e.role = 'contradicts', w.depth + 1, list_append(w.seen, e.src) FROM walk w JOIN n x ON x.id = w.at_ AND NOT x.root JOIN {edges} e ON e.dst = w.at_ WHERE NOT list_contains(w.seen, e.src)),
won AS (SELECT anchor, arg_min(at_, (depth, rev)) AS root, min(depth) AS depth, arg_min(rev, (depth, rev)) AS rev_edges, arg_min(score, (depth, rev)) AS score, arg_min(con, (depth, rev)) AS con, arg_min(seen, (depth, rev)) AS path FROM walk w JOIN n x ON x.id = w.at_ WHERE x.root GROUP BY anchor)"""


@query("reverse_root", duck("SELECT anchor, root, depth, rev_edges, round(score, 6) AS score FROM won", REV.format(anchors="symptom", edges="ve"), recursive=True))
def reverse_root(spark, d):
    n, e = visible(spark, d)
    return retrieve.reverse_roots(n.filter("symptom").select(F.col("id").alias("anchor")), e, n).select("anchor", "root", "depth", "rev_edges", F.round("score", 6).alias("score"))


def causal(signal: str) -> list[str]:
    """Common tables of causal search; ``signal`` is what bonds add to a root's score."""
    return [
        "qs AS (SELECT id AS query_id, vec, signature FROM n WHERE symptom)",
        "nr AS MATERIALIZED (SELECT a.query_id, b.id, b.incident, b.symptom OR b.impact AS boosted, bit_count(b.signature & a.signature) >= greatest(1, bit_count(a.signature) - 1) AS pl, score, row_number() OVER (PARTITION BY a.query_id ORDER BY score DESC, b.id) AS rk FROM (SELECT a.query_id, a.signature, b.id AS bid, " + COS + " AS score FROM qs a, vn b) a JOIN vn b ON b.id = a.bid)",
        "cand AS (SELECT * FROM (SELECT *, count(*) FILTER (pl) OVER (PARTITION BY query_id) AS k FROM nr) WHERE pl OR (k < 64 AND rk <= 64))",
        "anc AS MATERIALIZED (SELECT * FROM (SELECT query_id, id AS anchor, incident, round(score + CASE WHEN boosted THEN 0.15 ELSE 0 END, 9) AS sc, row_number() OVER (PARTITION BY query_id ORDER BY round(score + CASE WHEN boosted THEN 0.15 ELSE 0 END, 9) DESC, id) AS rk FROM cand) WHERE rk <= 12)",
        "ce AS (SELECT * FROM ve WHERE origin <> 'hypothetical')",
        REV.format(anchors="id IN (SELECT anchor FROM anc)", edges="ce"),
        f"bf AS (SELECT src AS s, dst AS t, {BOND} AS w FROM ce UNION ALL SELECT dst, src, {BOND} FROM ce)",
        "la0 AS (SELECT query_id, anchor AS id, sc AS a FROM anc)",
        *[f"la{k} AS (SELECT query_id, id, max(a) AS a FROM (SELECT * FROM la{k - 1} UNION ALL SELECT query_id, t, a * w FROM la{k - 1} JOIN bf ON s = id) GROUP BY ALL)" for k in (1, 2, 3)],
        "sg AS (SELECT query_id, root, max(a) AS signal FROM (SELECT query_id, root, unnest(path) AS id FROM anc JOIN won USING (anchor)) JOIN la3 USING (query_id, id) WHERE a > 0 GROUP BY ALL)",
        f"br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, root) AS k FROM (SELECT query_id, root, deg, round(base + {signal}, 9) AS raw FROM (SELECT query_id, root, count(*) AS deg, 0.35 * least(1.0, count(*) / 3.0::DOUBLE) + 0.25 * least(1.0, len(list_distinct(flatten(list(rev_edges)))) / count(*)::DOUBLE / 4) - 0.25 * avg(con::INT) + sum(sc * score) / count(*) AS base FROM anc JOIN won USING (anchor) GROUP BY query_id, root) LEFT JOIN sg USING (query_id, root)))",
        "sh AS (SELECT query_id, max(k)::DOUBLE / sum(k) AS share, max(top) AS top FROM (SELECT query_id, incident, count(*) AS k, max(sc) AS top FROM anc GROUP BY ALL) GROUP BY query_id)",
        "re AS (SELECT q.query_id, b.root, b.deg, greatest(0.0, least(1.0, b.raw)) AS conf, CASE WHEN top IS NULL OR top < 0.42 THEN 'NO_STABLE_ANCHOR' WHEN top < 0.97 AND share < 0.34 THEN 'AMBIGUOUS' WHEN b.root IS NULL THEN 'NO_PATH' WHEN b.raw < 0.45 THEN 'LOW_STABILITY' ELSE '' END AS reason FROM qs q LEFT JOIN sh USING (query_id) LEFT JOIN br b ON b.query_id = q.query_id AND b.k = 1)",
    ]


#: The share of a signal that a bond hands on.
BOND = "0.65 * least(1.0, greatest(0.0, bond_strength)) * (CASE WHEN bond = 'defect' THEN 0.4 ELSE 1 END) * (CASE WHEN cross_layer THEN 0.25 ELSE 1 END)"
ANSWER = "SELECT query_id, reason <> '' AS abstain, reason, CASE WHEN reason IN ('', 'LOW_STABILITY') THEN root END AS target, CASE WHEN reason IN ('', 'LOW_STABILITY') THEN round(conf, 6) END AS confidence, CASE WHEN reason IN ('', 'LOW_STABILITY') THEN deg END AS degeneracy FROM re"


def _causal(spark, d, **options):
    n, e = visible(spark, d)
    return retrieve.causal_search(causal_queries(spark, d), n, e.filter(S.mode_core(F.col("origin"), F.col("role"), "balanced")), **options)


@query("causal_search", duck(ANSWER, *causal("0"), recursive=True))
def causal_search(spark, d):
    return _causal(spark, d)


@query("causal_search_lattice", duck(ANSWER, *causal("0.25 * least(1.0, coalesce(signal, 0))"), recursive=True))
def causal_search_lattice(spark, d):
    """With the signal that bonds carry from the anchors to the nodes of a path."""
    return _causal(spark, d, lattice=True)


@query("paths_per_root", duck("SELECT root, anchor, rk FROM (SELECT root, anchor, row_number() OVER (PARTITION BY root ORDER BY depth, rev_edges, anchor) AS rk FROM won) WHERE rk <= 2", REV.format(anchors="symptom", edges="ve"), recursive=True))
def paths_per_root(spark, d):
    n, e = visible(spark, d)
    w = Window.partitionBy("root").orderBy("depth", "rev_edges", "anchor")
    found = retrieve.reverse_roots(n.filter("symptom").select(F.col("id").alias("anchor")), e, n)
    return found.select("root", "anchor", F.row_number().over(w).alias("rk")).filter("rk <= 2")
