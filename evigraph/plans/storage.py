"""Single-node inserts and their placement, saved copies, codes, relation lines, claims and what streams carry."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from evigraph import project as P
from evigraph.functions import encode, json
from evigraph.functions import scalar as S
from evigraph.operators import placement, store, world
from evigraph.plans.basics import COS, FNV, SPIRAL, VC, cells, visible
from evigraph.plans.evaluation import _SIGNED
from evigraph.plans.evidence import EPISODES, episodes
from evigraph.plans.reasoning import EXPAND, symptom_paths
from evigraph.project import duck, table
from evigraph.registry import query
from evigraph.shared import materialize, shared_dir
from evigraph.sources import relations
from evigraph.streaming import replay, state


def own_path(spark, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"


@query(
    "put_nodes",
    duck("""SELECT seq, CASE WHEN code = '' THEN n + row_number() OVER (PARTITION BY code = '' ORDER BY seq) - 1 END AS id, code FROM (SELECT seq, n, CASE WHEN code IS NOT NULL THEN code WHEN min(seq) FILTER (code IS NULL) OVER (PARTITION BY c) < seq THEN 'DUPLICATE_CELL' ELSE '' END AS code
 FROM (SELECT id AS seq, n, n // 2 + id // 2 AS c, CASE WHEN id % 17 = 3 OR id % 19 = 5 THEN 'DIMENSION_MISMATCH' WHEN n // 2 + id // 2 < n THEN 'DUPLICATE_CELL' WHEN id % 23 = 7 THEN 'CONTENT_TOO_LARGE' END AS code FROM n, s))"""),
)
def put_nodes(spark, d):
    """New nodes in the cells from the middle of the spiral on, two a cell; some have short or infinite vectors or long content."""
    n, last = P.nodes(spark, d), table(spark, d, "embeddings").count()
    q, r = S.hex_spiral(F.col("id"))
    held = n.select(q.alias("q"), r.alias("r"), F.lit(0).alias("layer"))
    i, cell = F.col("id"), F.floor(F.lit(last) / 2) + F.floor(F.col("id") / 2)
    q, r = S.hex_spiral(cell)
    vec = F.when(i % 17 == 3, F.slice("vec", 1, 10)).when(i % 19 == 5, F.transform("vec", lambda _: F.lit(float("inf")))).otherwise(F.col("vec"))
    new = n.select(i.alias("seq"), F.when(i % 23 == 7, "0123456789").otherwise("short").alias("content"), vec.alias("vec"), q.alias("q"), r.alias("r"), F.lit(0).alias("layer"))
    return store.put_nodes(held, new, 64, last, most_content=8)


@query("adapter_stamp", "SELECT page_id, 'adapter=evigraph-lines-v1;external_id=page/' || page_id || ';service=p' || (page_id % 3) || ';type=page' AS metadata FROM pages")
def adapter_stamp(spark, d):
    i = F.col("page_id")
    own = F.create_map(F.lit("service"), F.concat(F.lit("p"), (i % 3).cast("string")), F.lit("adapter"), F.lit("forged"))
    rows = store.stamped(table(spark, d, "pages").select("page_id", F.concat(F.lit("page/"), i.cast("string")).alias("external_id"), F.lit("page").alias("type"), own.alias("metadata")), "evigraph-lines-v1")
    pairs = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("page_id", F.array_join(pairs, ";").alias("metadata"))


@query("backup_verify", duck("SELECT 'nodes' AS name, count(*) AS rows, true AS same FROM vn UNION ALL SELECT 'edges', count(*), true FROM ve"))
def backup_verify(spark, d):
    """Visible nodes and edges, written, read back and held against the manifest; ``same`` compares with what was written."""
    n, e = visible(spark, d)
    path = own_path(spark, "backup")
    store.backup({"nodes": n, "edges": e}, path)
    out = None
    for name, df in store.restore(spark, path).items():
        lost = {"nodes": n, "edges": e}[name].exceptAll(df.select(*df.columns)).agg(F.count("*").alias("lost"))
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows")).crossJoin(F.broadcast(lost)).select("name", "rows", (F.col("lost") == 0).alias("same"))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


@query("quarantine_episodes", f"WITH {EPISODES}, rq AS (SELECT tenant, id FROM ep UNION ALL SELECT tenant + 100, id FROM ep WHERE split = 'evaluation') SELECT r.tenant, r.id, CASE WHEN e.id IS NULL THEN 'not_found' WHEN e.hold THEN 'legal_hold' ELSE 'quarantined' END AS outcome FROM rq r LEFT JOIN ep e USING (tenant, id)")
def quarantine_episodes(spark, d):
    e = episodes(spark, d)
    asked = e.select("tenant", "id").unionByName(e.filter("split = 'evaluation'").select((F.col("tenant") + 100).alias("tenant"), "id"))
    return store.quarantine(e, asked)


@query("quantize_half", "SELECT vec_id, i - 1 AS place, CASE WHEN x = 0 THEN 0e0 ELSE sign(x) * round_even(abs(x) / p, 0) * p END AS half FROM (SELECT vec_id, i, x, pow(2e0, greatest(floor(log2(abs(x))), -14) - 10) AS p FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings))")
def quantize_half(spark, d):
    """32-bit numbers of a vector as 16-bit ones."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("place", "x"))
    return e.select("vec_id", "place", encode.half(F.col("x")).alias("half"))


@query("segment_codec")
def segment_codec(spark, d):
    """Nodes in segments of 1024 ids each: packed, read back, and whether they came back equal."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id")
        rows = [(int(i), int(s), c, dict(m)) for i, s, c, m in zip(block["id"], block["signature"], block["content"], block["metadata"], strict=True)]
        data = encode.pack_segment(rows)
        return pd.DataFrame({"segment": [int(block["segment"].iloc[0])], "rows": [len(rows)], "bytes": [len(data)], "same": [encode.unpack_segment(data) == rows]})

    n = P.nodes(spark, d)
    meta = F.create_map(F.lit("incident"), F.col("incident").cast("string"), F.lit("kind"), F.when(F.col("root"), "root").when(F.col("symptom"), "symptom").otherwise("other"))
    rows = n.select(F.floor(F.col("id") / 1024).alias("segment"), "id", "signature", F.concat(F.lit("node "), F.col("id").cast("string")).alias("content"), meta.alias("metadata"))
    return rows.groupBy("segment").applyInPandas(run, "segment bigint, rows bigint, bytes bigint, same boolean")


@query("json_codec", "SELECT page_id, to_json(url || chr(10) || chr(9) || '\"' || chr(92) || chr(1)) AS quoted, url || chr(10) || chr(9) || '\"' || chr(92) || chr(1) AS back, 2 AS depth FROM pages WHERE url IS NOT NULL")
def json_codec(spark, d):
    """Urls with characters that need an escape, as a field of an object in a list, and read back from it."""
    text = F.concat("url", F.lit('\n\t"\\\x01'))
    quoted = F.concat(F.lit('"'), json.escaped(text), F.lit('"'))
    doc = F.concat(F.lit('[{"x{[":'), quoted, F.lit("}]"))
    p = table(spark, d, "pages").filter("url IS NOT NULL").select("page_id", quoted.alias("quoted"), doc.alias("doc"))
    return p.select("page_id", "quoted", F.try_variant_get(json.parsed(F.col("doc")), "$[0]['x{[']", "string").alias("back"), json.depth(F.col("doc")).alias("depth"))


_RELS = {
    "tsv": ("'P' || page_id || chr(9) || ' Calls ' || chr(9) || 'H' || (page_id % 7) || chr(9) || 'page'", "'P' || page_id || chr(9) || 'Calls'"),
    "pipe": ("'P' || page_id || ' | Calls | H' || (page_id % 7) || '|page'", "'P' || page_id || '|Calls'"),
    "rdf": ("'<P' || page_id || '> <Calls> H' || (page_id % 7) || ' .'", "'<P' || page_id || '> <Calls>'"),
    "token": ("'REL=wrong SUBJ=P' || page_id || ' P=Calls O=H' || (page_id % 7)", "'SUBJ=P' || page_id || ' REL=Calls'"),
}


@query("relation_formats", " UNION ALL ".join(f"SELECT '{k}' AS format, page_id, CASE WHEN page_id % 5 <> 1 THEN 'P' || page_id END AS subject, CASE WHEN page_id % 5 <> 1 THEN 'Calls' END AS predicate, CASE WHEN page_id % 5 <> 1 THEN 'H' || (page_id % 7) END AS object, CASE WHEN page_id % 5 <> 1 THEN '{'page' if k in ('tsv', 'pipe') else ''}' END AS subject_type, CASE WHEN page_id % 5 = 1 THEN 'line ' || (page_id + 1) || ': cannot parse {k} relation' END AS error FROM pages WHERE page_id % 5 <> 0" for k in _RELS))
def relation_formats(spark, d):
    """One line a page in each of four formats; every fifth is a comment, every fifth lacks its object."""
    out = None
    for fmt, (whole, cut) in _RELS.items():
        sql = lambda x: x.replace("chr(9)", "'\\t'")
        line = F.expr(f"CASE WHEN page_id % 5 = 0 THEN '# left out' WHEN page_id % 5 = 1 THEN {sql(cut)} ELSE {sql(whole)} END")
        rows = relations.parse(table(spark, d, "pages").select("page_id", (F.col("page_id") + 1).alias("line_number"), line.alias("value")), fmt)
        rows = rows.select(F.lit(fmt).alias("format"), "page_id", "subject", "predicate", "object", "subject_type", "error")
        out = rows if out is None else out.unionByName(rows)
    return out


CERTIFIED = "edge_id % 8 = 1"
CERTIFIED_BY = "edge_id % 3 <> 0"


def verified_paths(paths, marks):
    """(path, verified) of paths (path, edges, contra): verified where some edge is no bridge, all such edges carry a
    certificate and no step contradicts; ``marks`` is (edge_id, bridge, certificate)."""
    steps = paths.select("path", F.explode("edges").alias("edge_id")).join(marks, "edge_id", "left")
    real = ~F.coalesce("bridge", F.lit(False))
    seen = steps.groupBy("path").agg(F.count_if(real).alias("real"), F.count_if(real & ~F.coalesce(F.col("certificate") == "verified", F.lit(False))).alias("open"))
    out = paths.join(seen, "path", "left")
    return out.select("path", (F.coalesce(F.col("real") > 0, F.lit(False)) & (F.col("open") == 0) & ~F.col("contra")).alias("verified"))


@query("verify_certificates", duck(f"SELECT path, coalesce(bool_and({CERTIFIED_BY}) FILTER (NOT ({CERTIFIED})), false) AND NOT any_value(contra) AS verified FROM (SELECT array_to_string(edges, ',') AS path, unnest(edges) AS edge_id, contra FROM found) GROUP BY path", EXPAND, recursive=True))
def verify_certificates(spark, d):
    paths, e = symptom_paths(spark, d)
    marks = e.select("edge_id", F.expr(CERTIFIED).alias("bridge"), F.expr(f"CASE WHEN {CERTIFIED_BY} THEN 'verified' ELSE 'pending' END").alias("certificate"))
    return verified_paths(paths.select(F.array_join("edges", ",").alias("path"), "edges", "contra"), marks).filter("path <> ''")


CLAIMS = """cl AS (SELECT vec_id AS id, CASE vec_id % 3 WHEN 0 THEN 'hypothesis' WHEN 1 THEN 'claim' ELSE 'observation' END AS kind, CASE WHEN vec_id % 7 = 0 THEN 'active' ELSE 'proposed' END AS status, ['observed','discovered','inferred','reinforced','hypothetical'][vec_id % 5 + 1] AS origin, vec_id % 4 AS n_evidence FROM embeddings),
rq AS (SELECT vec_id * 2 + k AS seq, vec_id AS node_id, CASE WHEN k = 1 OR vec_id % 2 = 0 THEN 'verified' ELSE 'contested' END AS status FROM embeddings, (SELECT unnest([0, 1]) AS k) WHERE vec_id % 6 <> 0),
ok AS (SELECT r.*, c.status AS was FROM rq r JOIN cl c ON c.id = r.node_id WHERE r.status <> 'verified' OR (c.origin NOT IN ('inferred', 'hypothetical') AND c.n_evidence > 0)),
up AS (SELECT row_number() OVER (ORDER BY seq) + 10 AS sequence, node_id, 'status' AS action, coalesce(lag(status) OVER (PARTITION BY node_id ORDER BY seq), was) AS before, status AS after, 'review ' || seq AS reason FROM ok),
nw AS (SELECT id, kind, origin, n_evidence, coalesce((SELECT arg_max(status, seq) FROM ok WHERE node_id = id), status) AS status FROM cl)"""


def claims(spark, d):
    i = F.col("vec_id")
    e = table(spark, d, "embeddings")
    nodes = e.select(i.alias("id"), F.when(i % 3 == 0, "hypothesis").when(i % 3 == 1, "claim").otherwise("observation").alias("kind"), F.when(i % 7 == 0, "active").otherwise("proposed").alias("status"), P.pick(P.ORIGINS, i % 5).alias("origin"), (i % 4).alias("n_evidence"))
    asked = e.filter(i % 6 != 0).select(i, F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    asked = asked.select((i * 2 + F.col("k")).alias("seq"), i.alias("node_id"), F.when((F.col("k") == 1) | (i % 2 == 0), "verified").otherwise("contested").alias("status"))
    return world.updated(nodes, asked.withColumn("reason", F.concat(F.lit("review "), F.col("seq").cast("string"))), 10)


@query("world_update", f"WITH {CLAIMS} SELECT sequence, node_id, before, after, {_SIGNED} AS checksum FROM (SELECT *, {FNV} AS h FROM (SELECT *, sequence::VARCHAR || node_id || action || before || after || reason AS x FROM up))")
def world_update(spark, d):
    return claims(spark, d)[1].select("sequence", "node_id", "before", "after", "checksum")


@query("world_roundtrip", f"WITH {CLAIMS} SELECT id, kind, status, origin, n_evidence FROM nw")
def world_roundtrip(spark, d):
    """Claims after their updates, saved and read back; the checksum of every event is verified on the way."""
    path = own_path(spark, "world")
    world.save(*claims(spark, d), path)
    return world.load(spark, path)[0].select("id", "kind", "status", "origin", "n_evidence")


MOST_FINDINGS = 40


@query(
    "world_schedule",
    f"""WITH {CLAIMS}, fi AS (SELECT id, unnest(list_filter([CASE WHEN status = 'verified' AND n_evidence = 0 THEN {{'job': 4, 'code': 'VERIFIED_WITHOUT_EVIDENCE'}} END, CASE WHEN status = 'verified' AND origin IN ('inferred', 'hypothetical') THEN {{'job': 3, 'code': 'SILENT_TRUTH_PROMOTION'}} END, CASE WHEN kind = 'hypothesis' AND status = 'active' AND n_evidence = 0 THEN {{'job': 2, 'code': 'ACTIVE_HYPOTHESIS_WITHOUT_EVIDENCE'}} END], lambda z: z IS NOT NULL)) AS f FROM nw)
SELECT f.job AS job, id, f.code AS code, (SELECT count(*) FROM fi) <= {MOST_FINDINGS} AS bounded FROM fi ORDER BY 1, 2, 3 LIMIT {MOST_FINDINGS}""",
)
def world_schedule(spark, d):
    nodes, events = claims(spark, d)
    return world.scheduled(world.audit(nodes, events), MOST_FINDINGS)


UPDATES = "SELECT user_id AS key, event_id AS seq, event_id % 3 + 1 AS node, event_id % 7 <> 3 AS answered, CASE event_id % 5 WHEN 0 THEN 'resolved' WHEN 1 THEN 'contested' WHEN 2 THEN 'open' ELSE 'provisionally_resolved' END AS status FROM events"
CARRIED = f"""WITH u AS ({UPDATES}), o AS (SELECT *, CASE WHEN answered THEN node ELSE 0 END AS o, CASE WHEN answered AND status IN ('resolved', 'provisionally_resolved') THEN node ELSE 0 END AS m FROM u),
p AS (SELECT *, lag(o) OVER w AS po, lag(m) OVER w AS pm, lag(status) OVER w AS ps, coalesce(last_value(nullif(m, 0) IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pl FROM o WINDOW w AS (PARTITION BY key ORDER BY seq))
SELECT key, seq, 'revision' AS event, po AS previous, o AS current FROM p WHERE po <> 0 AND po <> o UNION ALL SELECT key, seq, 'decommitment', pm, 0 FROM p WHERE pm <> 0 AND pm <> m
UNION ALL SELECT key, seq, 'recommitment', CASE WHEN pm <> 0 THEN pm ELSE pl END, m FROM p WHERE m <> 0 AND ((pm <> 0 AND pm <> m) OR (pm = 0 AND pl <> 0)) UNION ALL SELECT key, seq, 'resolution', 0, m FROM p WHERE ps <> 'resolved' AND status = 'resolved' AND m <> 0"""


def updates(spark, d):
    i = F.col("event_id")
    status = F.when(i % 5 == 0, "resolved").when(i % 5 == 1, "contested").when(i % 5 == 2, "open").otherwise("provisionally_resolved")
    return table(spark, d, "events").select(F.col("user_id").cast("bigint").alias("key"), i.cast("bigint").alias("seq"), (i % 3 + 1).cast("bigint").alias("node"), (i % 7 != 3).alias("answered"), status.alias("status"))


@query("epistemic_transitions", CARRIED)
def epistemic_transitions(spark, d):
    return state.transitions(state.with_prior(updates(spark, d)))


def _streamed(spark, rows, prepared, kind):
    """A stream of the files of a table, run to its end into another table."""
    source = materialize(rows)
    path = own_path(spark, kind)
    return prepared(spark.readStream.schema(rows.schema).parquet(source.table_path), path)


@query("epistemic_stream", CARRIED)
def epistemic_stream(spark, d):
    """The same transitions from a stream, with what was held carried as state."""

    def run(stream, path):
        out = state.carried(stream)
        out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{path}/rows")

    return state.transitions(_streamed(spark, updates(spark, d), run, "states"))


@query("stream_once", "SELECT DISTINCT user_id, event_type FROM events")
def stream_once(spark, d):
    """Keys of a stream that brings most of them many times, each once."""
    rows = table(spark, d, "events").select("user_id", "event_type")

    def run(stream, path):
        replay.once(stream, ["user_id", "event_type"], f"{path}/rows", f"{path}/log").start().awaitTermination()
        return spark.read.schema(rows.schema).parquet(f"{path}/rows")

    return _streamed(spark, rows, run, "once")


PLACED = f"""{SPIRAL}, {VC},
pm AS (SELECT n.id, n.vec, c.q, c.r, c.layer, n.id % 40 AS service, CASE WHEN n.id % 3 > 0 THEN '2024-0' || (1 + n.id % 6) END AS since FROM vn n JOIN vc c ON c.id = n.id),
nw AS (SELECT id AS query_id, vec, id % 40 AS service, CASE WHEN id % 3 > 0 THEN '2024-0' || (1 + id % 6) END AS since FROM n WHERE id % 20 = 0),
mt AS (SELECT DISTINCT query_id, id FROM (SELECT query_id, id FROM (SELECT a.query_id, b.id, row_number() OVER (PARTITION BY a.query_id ORDER BY {COS} DESC, b.id) AS k FROM nw a, pm b) WHERE k <= 32 UNION ALL SELECT query_id, p.id FROM nw JOIN (SELECT id, service, row_number() OVER (PARTITION BY service ORDER BY id) AS k FROM pm) p ON p.service = nw.service AND k <= 16)),
an AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rated DESC, id) AS place FROM (SELECT *, round(0.65 * sem + 0.25 * meta + 0.10 * tm, 9) AS rated FROM (SELECT m.query_id, b.id, b.q, b.r, b.layer, {COS} AS sem, (a.service = b.service)::INT::DOUBLE AS meta, CASE WHEN a.since = b.since THEN 0.6e0 ELSE 0e0 END AS tm FROM mt m JOIN nw a USING (query_id) JOIN pm b ON b.id = m.id)) WHERE rated > 0.05) WHERE place <= 24),
uu AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM ve UNION ALL SELECT dst, src FROM ve)),
o1 AS (SELECT DISTINCT query_id, id FROM (SELECT * FROM mt UNION ALL SELECT query_id, b FROM mt JOIN uu ON a = id)), o2 AS (SELECT DISTINCT query_id, id FROM (SELECT * FROM o1 UNION ALL SELECT query_id, b FROM o1 JOIN uu ON a = id)), o3 AS (SELECT DISTINCT query_id, id FROM (SELECT * FROM o2 UNION ALL SELECT query_id, b FROM o2 JOIN uu ON a = id)),
oc AS (SELECT DISTINCT query_id, q, r, layer FROM o3 JOIN pm USING (id)),
st AS (SELECT a AS dq, b AS dr, CASE WHEN a = 0 AND b = 0 THEN 0 ELSE 1 END * 100 + (a + 3) * 7 + b + 3 AS turn FROM (SELECT unnest(range(-3, 4)) AS a), (SELECT unnest(range(-3, 4)) AS b) WHERE greatest(abs(a), abs(b), abs(a + b)) <= 3),
fr AS (SELECT query_id, q, r, layer, min((place, turn)) AS o FROM (SELECT query_id, place, turn, q + dq AS q, r + dr AS r, layer FROM an, st) f WHERE NOT EXISTS (SELECT 1 FROM oc WHERE oc.query_id = f.query_id AND oc.q = f.q AND oc.r = f.r AND oc.layer = f.layer) GROUP BY ALL),
sc AS (SELECT query_id, f.q, f.r, f.layer, o, round(sum((0.45 * sem + 0.25 * meta + 0.15 * tm) / (1 + dist)) - 0.025 * greatest(0, count(*) - 6), 9) AS score FROM (SELECT f.*, a.sem, a.meta, a.tm, greatest(abs(f.q - a.q), abs(f.r - a.r), abs(f.q - a.q + f.r - a.r)) AS dist FROM fr f JOIN an a ON a.query_id = f.query_id AND a.layer = f.layer) f WHERE dist <= 4 GROUP BY ALL),
wn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o) AS k FROM sc) WHERE k = 1 AND score > 0.02)"""


@query("placement_score", duck("SELECT a.query_id, q, r, layer, round(score, 6) AS score FROM nw a LEFT JOIN wn USING (query_id)", PLACED))
def placement_score(spark, d):
    """A cell for a new node like each one whose id is divisible by 20, among the visible nodes."""
    i = F.col("id")
    service = F.create_map(F.lit("service"), (i % 40).cast("string"))
    since = F.when(i % 3 > 0, F.create_map(F.lit("valid_from"), F.concat(F.lit("2024-0"), (1 + i % 6).cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
    meta = F.map_concat(service, since).alias("metadata")
    n, e = visible(spark, d)
    here = materialize(n.select("id", "vec", meta).join(cells(spark, d, True), "id"))
    new = materialize(P.nodes(spark, d).filter(i % 20 == 0).select(i.alias("query_id"), "vec", meta))
    return placement.place(new, here, e).withColumn("score", F.round("score", 6))
