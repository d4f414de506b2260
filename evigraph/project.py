"""The driver's tables as nodes, edges, facts, relations and episodes, by integer rules; the same rules in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.ranges import bucket
from .schema import FOREVER, ORIGINS, ROLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(names, index):
    return F.element_at(F.array(*map(F.lit, names)), (index + 1).cast("int"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    n, v = F.lit(e.count()), F.col("vec_id")
    one = F.lit(1).cast("bigint")
    return e.select(
        v.alias("id"),
        F.col("embedding").cast("array<double>").alias("vec"),
        F.col("label").alias("incident"),
        F.call_function("shiftleft", one, (F.col("label") % 16).cast("int")).bitwiseOR(F.call_function("shiftleft", one, (16 + v % 16).cast("int"))).alias("signature"),
        (v % 5 == 0).alias("root"),
        (v % 5 == 3).alias("impact"),
        (v % 5 == 4).alias("symptom"),
        (v + 1).alias("created"),
        F.when(v % 37 == 36, n + v).otherwise(FOREVER).alias("deleted"),
        (F.col("label") % 3).cast("int").alias("layer"),
    )


def _following(rows: DataFrame) -> DataFrame:
    """(vec_id, n1, n2): the next two ids of the same label. Windows hold a bucket of ids each, since labels are few; a
    label's buckets, one row each, tell where the next rows are if they lie beyond."""
    rows = rows.withColumn("b", bucket("vec_id"))
    w = Window.partitionBy("label", "b").orderBy("vec_id")
    own = rows.withColumns({"n1": F.lead("vec_id", 1).over(w), "n2": F.lead("vec_id", 2).over(w)})
    # The first two of each bucket: its least id, and the id after that.
    heads = own.groupBy("label", "b").agg(F.min("vec_id").alias("h1"), F.min_by("n1", "vec_id").alias("h2"))
    over = Window.partitionBy("label").orderBy("b")
    heads = heads.select(F.col("label").alias("__l"), F.col("b").alias("__b"), F.lead("h1").over(over).alias("m1"), F.coalesce(F.lead("h2").over(over), F.lead("h1", 2).over(over)).alias("m2"))
    out = own.join(heads, F.col("label").eqNullSafe(F.col("__l")) & (F.col("b") == F.col("__b")), "left")
    return out.select("vec_id", F.coalesce("n1", "m1").alias("n1"), F.coalesce("n2", F.when(F.col("n1").isNotNull(), F.col("m1")).otherwise(F.col("m2"))).alias("n2"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    both = _following(e.select("label", "vec_id"))
    out = both.select("vec_id", F.inline(F.array(F.struct(F.lit(0).alias("k"), F.col("n1").alias("dst")), F.struct(F.lit(1).alias("k"), F.when(v % 3 == 0, F.col("n2")).alias("dst"))))).filter("dst IS NOT NULL")
    source = F.when(v % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("src"), (v % 7).cast("string")))
    return out.select(
        (v * 2 + F.col("k")).alias("edge_id"),
        v.alias("src"),
        "dst",
        pick(ORIGINS, v % 5).alias("origin"),
        F.when(v % 11 == 0, "contradicts").otherwise(pick(ROLES[:5], F.floor(v / 5) % 5)).alias("role"),
        ((60 + v % 40) / F.lit(100.0)).alias("confidence"),
        ((50 + v % 50) / F.lit(100.0)).alias("bond_strength"),
        F.when(v % 17 == 0, "defect").otherwise("sigma").alias("bond"),
        (v % 9 == 0).alias("cross_layer"),
        (v + 2).alias("created"),
        F.lit(FOREVER).alias("deleted"),
        source.alias("source_id"),
        F.concat(F.lit("fam"), (v % 4).cast("string")).alias("family"),
        F.when((v % 6 == 2) | (v % 5 == 1), F.concat(F.lit("drv"), (v % 10).cast("string"))).otherwise("").alias("derivation"),
        F.when(v % 19 == 0, "refuted").when(v % 23 == 0, "revoked").when(v % 29 == 0, "odd").otherwise("active").alias("lifecycle"),
        F.when(v % 31 == 0, "2024-01-02").when(v % 4 == 0, F.concat(F.lit("2024-01-"), F.lpad((1 + v % 28).cast("string"), 2, "0"), F.lit("T10:00:00Z"))).otherwise("").alias("valid_from"),
    )


def snapshot(spark: SparkSession, sf_dir: str) -> int:
    """A version half-way through the deletions."""
    return table(spark, sf_dir, "embeddings").count() * 3 // 2


_ORIGIN = "['" + "','".join(ORIGINS) + "']"
_ROLE = "['" + "','".join(ROLES[:5]) + "']"
#: The same rules for DuckDB: n (nodes), e (edges), s (the snapshot).
DUCK = f"""s AS (SELECT count(*) * 3 // 2 AS v, count(*) AS n FROM embeddings),
n AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label AS incident, (1::BIGINT << (label % 16)) | (1::BIGINT << (16 + vec_id % 16)) AS signature, vec_id % 5 = 0 AS root, vec_id % 5 = 3 AS impact, vec_id % 5 = 4 AS symptom,
 vec_id + 1 AS created, CASE WHEN vec_id % 37 = 36 THEN (SELECT n FROM s) + vec_id ELSE {FOREVER} END AS deleted, (label % 3)::INT AS layer FROM embeddings),
e0 AS (SELECT vec_id AS v, lead(vec_id, 1) OVER (PARTITION BY label ORDER BY vec_id) AS n1, lead(vec_id, 2) OVER (PARTITION BY label ORDER BY vec_id) AS n2 FROM embeddings),
e AS (SELECT v * 2 + k AS edge_id, v AS src, dst, {_ORIGIN}[v % 5 + 1] AS origin, CASE WHEN v % 11 = 0 THEN 'contradicts' ELSE {_ROLE}[(v // 5) % 5 + 1] END AS role, (60 + v % 40) / 100.0::DOUBLE AS confidence, (50 + v % 50) / 100.0::DOUBLE AS bond_strength,
 CASE WHEN v % 17 = 0 THEN 'defect' ELSE 'sigma' END AS bond, v % 9 = 0 AS cross_layer, v + 2 AS created, {FOREVER} AS deleted,
 CASE WHEN v % 13 = 0 THEN '' ELSE 'src' || (v % 7) END AS source_id, 'fam' || (v % 4) AS family, CASE WHEN v % 6 = 2 OR v % 5 = 1 THEN 'drv' || (v % 10) ELSE '' END AS derivation,
 CASE WHEN v % 19 = 0 THEN 'refuted' WHEN v % 23 = 0 THEN 'revoked' WHEN v % 29 = 0 THEN 'odd' ELSE 'active' END AS lifecycle,
 CASE WHEN v % 31 = 0 THEN '2024-01-02' WHEN v % 4 = 0 THEN '2024-01-' || lpad((1 + v % 28)::VARCHAR, 2, '0') || 'T10:00:00Z' ELSE '' END AS valid_from
 FROM (SELECT v, 0 AS k, n1 AS dst FROM e0 UNION ALL SELECT v, 1, n2 FROM e0 WHERE v % 3 = 0) WHERE dst IS NOT NULL),
vn AS (SELECT * FROM n WHERE created <= (SELECT v FROM s) AND (SELECT v FROM s) < deleted),
ve AS (SELECT * FROM e WHERE created <= (SELECT v FROM s) AND (SELECT v FROM s) < deleted AND src IN (SELECT id FROM vn) AND dst IN (SELECT id FROM vn))"""


def duck(body: str, *more: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([DUCK, *more]) + "\n" + body
