"""Files of lines, batches of changes, relations, hashed texts and approximate neighbours."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from evigraph import project as P
from evigraph.functions import embed
from evigraph.functions import scalar as S
from evigraph.operators import cells, retrieve
from evigraph.plans.basics import FNV, SPIRAL, query_vectors, visible
from evigraph.project import duck, table
from evigraph.registry import query
from evigraph.shared import shared_dir
from evigraph.sources import lines


def written(df):
    """A text file of the lines of ``df`` in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/lines/{uuid.uuid4().hex}"
    df.write.text(path)
    return path


def text(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


_KIND = "CASE vec_id % 4 WHEN 0 THEN 'root' WHEN 1 THEN 'symptom' WHEN 2 THEN 'impact' ELSE 'node' END"


@query("import_tsv", "SELECT 'node ' || vec_id AS content, (vec_id % 7) + (vec_id % 5) * 0.5e0 AS total, vec_id * 3 AS signature, label AS incident, vec_id % 4 = 0 AS root, vec_id % 4 = 1 AS symptom FROM embeddings WHERE vec_id % 11 <> 10")
def import_tsv(spark, d):
    i = F.col("vec_id")
    kind = F.when(i % 4 == 0, "root").when(i % 4 == 1, "symptom").when(i % 4 == 2, "impact").otherwise("node")
    vec = F.concat_ws(",", text(i % 7), text((i % 5) * 0.5))
    line = F.when(i % 11 == 10, "# left out").otherwise(F.concat_ws("\t", F.concat(F.lit("node "), text(i)), vec, text(i * 3), text("label"), kind))
    good, _ = lines.nodes(spark, written(table(spark, d, "embeddings").select(line.alias("value"))))
    return good.select("content", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x).alias("total"), "signature", "incident", "root", "symptom")


@query("adapter_tsv", "SELECT 'page/' || page_id AS external_id, url AS content, 'p' || (page_id % 3) AS service, page_id % 2 = 0 AS root FROM pages WHERE url IS NOT NULL AND page_id % 7 <> 6")
def adapter_tsv(spark, d):
    i = F.col("page_id")
    meta = F.concat(F.lit("source=web;service=p"), text(i % 3))
    line = F.concat_ws("\t", F.concat(F.lit("page/"), text(i)), F.lit("page"), text(i), text(i % 5), F.when(i % 2 == 0, "1").otherwise("0"), F.lit("0"), F.lit("1,0"), F.when(i % 7 == 6, "zz").otherwise(F.lower(F.hex(F.encode("url", "UTF-8")))), F.lower(F.hex(F.encode(meta, "UTF-8"))))
    good, _ = lines.records(spark, written(table(spark, d, "pages").filter("url IS NOT NULL").select(line.alias("value"))))
    return good.select("external_id", "content", F.col("metadata")["service"].alias("service"), "root")


@query("wal_replay", "SELECT vec_id // 4 AS txid, 'PUT_NODE' AS op, vec_id::VARCHAR AS rest FROM embeddings WHERE (vec_id // 4) % 5 <> 4 AND vec_id % 9 <> 8")
def wal_replay(spark, d):
    """Four puts a transaction; each fifth one has no COMMIT and each ninth frame a wrong checksum."""
    i = F.col("vec_id")
    tx = F.floor(i / 4)
    put = lines.frame(F.concat_ws("\t", F.lit("PUT_NODE"), text(tx), text(i)))
    e = table(spark, d, "embeddings")
    puts = e.select(F.when(i % 9 == 8, F.regexp_replace(put, r"^(\d+)\|(\d)", "$1|9$2")).otherwise(put).alias("value"))
    ends = e.select(tx.alias("tx")).distinct()
    begin, commit = (ends.filter(c).select(lines.frame(F.concat_ws("\t", F.lit(w), text("tx"))).alias("value")) for w, c in (("BEGIN", "true"), ("COMMIT", "tx % 5 <> 4")))
    return lines.replay(spark, written(puts.unionByName(begin).unionByName(commit)))[0]


@query("bulk_generate", duck("SELECT i, 'bulk node ' || i AS content, q, r FROM cell", SPIRAL))
def bulk_generate(spark, d):
    q, r = S.hex_spiral(F.col("id"))
    n = table(spark, d, "embeddings").count()
    return spark.range(n).select(F.col("id").alias("i"), F.concat(F.lit("bulk node "), text("id")).alias("content"), q.alias("q"), r.alias("r"))


BATCH = """del AS (SELECT id, v + row_number() OVER (ORDER BY id) AS version FROM vn, s WHERE id % 10 = 9),
put AS (SELECT n + row_number() OVER (ORDER BY id) - 1 AS id, id AS cell, v + (SELECT count(*) FROM del) + row_number() OVER (ORDER BY id) AS version FROM del, s),
lnk AS (SELECT p.id AS src, p.cell - 1 AS dst FROM put p WHERE p.cell - 1 IN (SELECT id FROM vn))"""


def apply_batch(nodes, deletes, puts, links, version):
    """(kind, id, ref, outcome) of a batch: versions are given to deletions first, then to new nodes.

    A deletion must name a visible node once; a new node's cell must be free or freed by the batch; an edge's ends must be
    visible after it. One fault refuses the whole batch, so every row then says 'refused'. A batch is one request, which
    bounds its rows.
    """
    ids, cells = nodes.select("id"), nodes.select(F.col("cell"), F.col("id").alias("holder"))
    gone = deletes.groupBy("id").agg(F.count("*").alias("k"))
    w = Window.orderBy("id")
    first = gone.join(ids.withColumn("known", F.lit(True)), "id", "left").select(F.lit("delete").alias("kind"), "id", F.col("id").alias("ref"), (version + F.row_number().over(w)).alias("version"), ((F.col("k") == 1) & F.col("known").isNotNull()).alias("ok"))
    held = cells.join(gone.select(F.col("id").alias("holder")), "holder", "left_anti").select("cell", F.lit(True).alias("held"))
    alone = F.count("*").over(Window.partitionBy("cell")) == 1
    new = puts.join(held, "cell", "left").select(F.lit("put").alias("kind"), "id", F.col("cell").alias("ref"), (version + gone.count() + F.row_number().over(w)).alias("version"), (F.col("held").isNull() & alone).alias("ok"))
    live = ids.join(gone, "id", "left_anti").unionByName(puts.select("id"))
    ends = links
    for c in ("src", "dst"):
        ends = ends.join(live.select(F.col("id").alias(c), F.lit(True).alias(f"has_{c}")), c, "left")
    edges = ends.select(F.lit("link").alias("kind"), F.col("src").alias("id"), F.col("dst").alias("ref"), F.lit(None).cast("bigint").alias("version"), (F.col("has_src").isNotNull() & F.col("has_dst").isNotNull()).alias("ok"))
    every = first.unionByName(new).unionByName(edges)
    fault = every.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("all_ok"))
    return every.crossJoin(F.broadcast(fault)).select("kind", "id", "ref", F.when(F.col("all_ok"), F.col("version")).alias("version"), F.when(F.col("all_ok"), "applied").when(F.col("ok"), "refused").otherwise("fault").alias("outcome"))  # one row


@query("batch_apply", duck("SELECT 'delete' AS kind, id, id AS ref, version, 'applied' AS outcome FROM del UNION ALL SELECT 'put', id, cell, version, 'applied' FROM put UNION ALL SELECT 'link', src, dst, NULL, 'applied' FROM lnk", BATCH))
def batch_apply(spark, d):
    """Every tenth node makes way for one in its own cell, with an edge to the cell before where that is held."""
    n = visible(spark, d)[0].select("id", F.col("id").alias("cell"))
    last, version = table(spark, d, "embeddings").count(), P.snapshot(spark, d)
    out = n.filter("id % 10 = 9")
    puts = out.select((last + F.row_number().over(Window.orderBy("id")) - 1).cast("bigint").alias("id"), "cell")
    links = puts.join(n.select((F.col("id") + 1).alias("cell")), "cell").select(F.col("id").alias("src"), (F.col("cell") - 1).alias("dst"))
    return apply_batch(n, out.select("id"), puts, links, version)


@query("relations_ingest", """WITH known AS (SELECT n_nationkey AS id, lower(n_name) AS k FROM nation UNION ALL SELECT 1000 + n_nationkey, lower(n_name) FROM nation WHERE n_nationkey % 7 = 0),
one AS (SELECT k, count(*) AS c, min(id) AS id FROM known GROUP BY k)
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'located_in' WHEN 1 THEN 'depends_on' ELSE 'near_by' END AS relation, CASE WHEN c = 1 THEN id END AS object, CASE WHEN c > 1 THEN 'RELATION_SKIPPED_AMBIGUOUS_ENTITY' WHEN s_suppkey % 3 = 2 THEN 'UNKNOWN_RELATION_PRESERVED' ELSE '' END AS warning, least(1, (s_suppkey % 15) / 10e0) AS confidence FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN one ON k = lower(n_name)""")
def relations_ingest(spark, d):
    """Predicates by alias, entities by key: one match is taken, several are skipped, none makes a node."""
    s, nation = table(spark, d, "supplier"), table(spark, d, "nation")
    known = nation.select(F.col("n_nationkey").cast("bigint").alias("id"), S.entity_name(F.col("n_name")).alias("key"))
    known = known.unionByName(known.filter("id % 7 = 0").withColumn("id", F.col("id") + 1000))
    one = known.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("id"))
    said = F.when(F.col("s_suppkey") % 3 == 0, "Hosted In").when(F.col("s_suppkey") % 3 == 1, "calls").otherwise("Near-By")
    rows = s.join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", said.alias("said"), S.entity_name(F.col("n_name")).alias("key"), S.clamp((F.col("s_suppkey") % 15) / 10.0).alias("confidence"))
    rows = rows.join(one, "key", "left").withColumn("core", S.canonical_relation(F.col("said")))
    warning = F.when(F.col("c") > 1, "RELATION_SKIPPED_AMBIGUOUS_ENTITY").when(F.col("core").isNull(), "UNKNOWN_RELATION_PRESERVED").otherwise("")
    return rows.select("s_suppkey", F.coalesce("core", S.relation_name(F.col("said"))).alias("relation"), F.when(F.col("c") == 1, F.col("id")).alias("object"), warning.alias("warning"), "confidence")


@query("embed_bytes")
def embed_bytes(spark, d):
    return table(spark, d, "pages").select("page_id", embed.embed_bytes(F.col("url"), 64).alias("vec"))


DIM = 24


@query("embed_words", f"""SELECT page_id, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY page_id)), 6) AS value FROM (SELECT page_id, (h % {DIM})::INT AS slot, sum(CASE WHEN h % 2 = 1 THEN 1e0 ELSE -1e0 END) AS v FROM (SELECT page_id, {FNV} AS h FROM (SELECT page_id, unnest(list_filter(string_split(regexp_replace(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')) AS x FROM pages)) GROUP BY ALL) WHERE v <> 0""")
def embed_words(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.posexplode(embed.embed_words(F.col("url"), DIM)).alias("slot", "v"))
    return rows.filter("v <> 0").select("page_id", "slot", F.round("v", 6).alias("value"))


@query("hybrid_search")
def hybrid_search(spark, d):
    """Nearest nodes of each benchmark text whose id is divisible by 20, by its hashed vector (no words are compared)."""
    q = table(spark, d, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), embed.embed_bytes(F.col("text"), 64).cast("array<double>").alias("vec"))
    return retrieve.knn(visible(spark, d)[0], q, 5).withColumn("score", F.round("score", 6))


#: Cosine below which the approximate index reports no neighbour.
FAR = -0.5


@query("vector_topk_lsh")
def vector_topk_lsh(spark, d):
    """Approximate neighbours on the unit sphere by bucketed projections; exact search is the default elsewhere.

    Every node is indexed; the projections are drawn, how many buckets a query looks into is fitted on a sample. Of the nodes
    met those whose cosine is FAR or more count; tests hold the recall of the ten nearest against exact search at 0.9.
    """
    narrow = F.col("vec").cast("array<float>")  # as the table has them
    near = cells.near(P.nodes(spark, d).select("id", narrow.alias("vec")), query_vectors(spark, d).select("query_id", narrow.alias("vec")), 10, FAR)
    return near.select("query_id", "node_id", F.round("score", 6).alias("score"), "rank")
