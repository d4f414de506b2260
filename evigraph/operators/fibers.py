"""Groups of paths that share sources, families or derivations: such paths don't corroborate each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.shared import materialize

#: Least quality of a path that counts, and how fast independent groups add up.
ELIGIBLE, RATE = 0.5, 0.7


def path_components(tokens: DataFrame) -> DataFrame:
    """(path, component): least path reachable through shared (scope, token). Labels meet at tokens, so no pairs arise.

    Each round is one aggregation by token and one by path, until no label falls; rounds are written out.
    """
    label = materialize(tokens.groupBy("path").agg(F.min("path").alias("component")))
    while True:
        low = tokens.join(label, "path").groupBy("scope", "token").agg(F.min("component").alias("low"))
        new = materialize(tokens.join(low, ["scope", "token"]).groupBy("path").agg(F.min("low").alias("component")))
        moved = new.join(label.withColumnRenamed("component", "old"), "path").filter("component <> old")
        if moved.isEmpty():
            return new
        label = new


def groups(paths: DataFrame, families: DataFrame, components: DataFrame) -> DataFrame:
    """(root, contra, component, paths, families, representative, quality): best path of each group, counting ones first."""
    own = paths.join(components, "path")
    best = F.max_by(F.struct("path", "score"), F.struct((F.col("score") >= ELIGIBLE).alias("a"), F.col("score").alias("b"), (-F.col("rank")).alias("c")))
    heads = own.groupBy("root", "contra", "component").agg(F.count("*").alias("paths"), best.alias("x"))
    kinds = families.join(components, "path").groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"))
    return heads.join(kinds, "component").select("root", "contra", "component", "paths", "families", F.col("x.path").alias("representative"), F.col("x.score").alias("quality"))


def summary(found: DataFrame) -> DataFrame:
    """(root, independent, support, contradiction_mass) of groups()."""
    counts = (F.col("quality") >= ELIGIBLE) & ~F.col("contra") & (F.col("families") != "")
    mass = F.coalesce(F.max(F.when((F.col("quality") >= ELIGIBLE) & F.col("contra"), F.col("quality"))), F.lit(0.0))
    out = found.groupBy("root").agg(F.count_if(counts).alias("independent"), mass.alias("contradiction_mass"))
    return out.withColumn("support", F.round(1 - F.exp(-RATE * F.col("independent")), 9))
