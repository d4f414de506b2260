"""Correlated paths of each root, their groups and the support that is left."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evigraph.operators import fibers
from evigraph.plans.reasoning import EXPAND, symptom_paths
from evigraph.project import duck
from evigraph.registry import query
from evigraph.shared import materialize

LINKS = """p AS (SELECT array_to_string(edges, ',') AS path, edges, at_ AS root, contra, round(score, 9) AS score FROM found),
pe AS (SELECT path, root, contra, e.* EXCLUDE (role) FROM (SELECT path, root, contra, unnest(edges) AS edge_id FROM p) JOIN ve e USING (edge_id)),
tok AS (SELECT DISTINCT path, root, contra, token FROM (SELECT path, root, contra, unnest(['s' || nullif(source_id, ''), 'f' || nullif(family, ''), 'd' || nullif(derivation, ''), 'p' || path]) AS token FROM pe) WHERE token IS NOT NULL),
reach AS (SELECT path, path AS other FROM p UNION SELECT r.path, b.path FROM reach r JOIN tok a ON a.path = r.other JOIN tok b ON b.root = a.root AND b.contra = a.contra AND b.token = a.token),
comp AS (SELECT path, min(other) AS component FROM reach GROUP BY path)"""
GROUPS = """g AS (SELECT root, contra, component, count(*) AS paths, first(path ORDER BY score >= 0.5 DESC, score DESC, path) AS representative, first(score ORDER BY score >= 0.5 DESC, score DESC, path) AS quality FROM p JOIN comp USING (path) GROUP BY ALL),
gf AS (SELECT component, string_agg(DISTINCT family, ',' ORDER BY family) AS families FROM pe JOIN comp USING (path) GROUP BY component)"""


def parts(spark, d):
    found, e = symptom_paths(spark, d)
    paths = materialize(found.select(F.array_join("edges", ",").alias("path"), "edges", F.col("at").alias("root"), "contra", F.round("score", 9).alias("score")))
    steps = paths.select("path", "root", "contra", F.explode("edges").alias("edge_id")).join(e.select("edge_id", "source_id", "family", "derivation"), "edge_id")
    named = [F.when(F.col(c) != "", F.concat(F.lit(c[0]), c)) for c in ("source_id", "family", "derivation")]
    own = F.concat(F.lit("p"), "path")  # a path without any lineage stays alone
    tokens = steps.select("path", F.struct("root", "contra").alias("scope"), F.explode(F.array_compact(F.array(*named, own))).alias("token")).distinct()
    return paths, steps, fibers.path_components(materialize(tokens))


def grouped(spark, d):
    paths, steps, components = parts(spark, d)
    ranked = paths.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy("path")))
    return fibers.groups(ranked, steps.filter("family <> ''"), components)


@query("path_components", duck("SELECT path, component FROM comp", EXPAND, LINKS, recursive=True))
def path_components(spark, d):
    return parts(spark, d)[2].select("path", "component")


@query("fiber_groups", duck("SELECT root, contra, component, paths, families, representative, quality FROM g JOIN gf USING (component)", EXPAND, LINKS, GROUPS, recursive=True))
def fiber_groups(spark, d):
    return grouped(spark, d)


@query("fiber_summary", duck("SELECT root, count(*) FILTER (quality >= 0.5 AND NOT contra AND families <> '') AS independent, round(1 - exp(-0.7 * count(*) FILTER (quality >= 0.5 AND NOT contra AND families <> '')), 9) AS support, coalesce(max(quality) FILTER (quality >= 0.5 AND contra), 0) AS contradiction_mass FROM g JOIN gf USING (component) GROUP BY root", EXPAND, LINKS, GROUPS, recursive=True))
def fiber_summary(spark, d):
    return fibers.summary(grouped(spark, d))
