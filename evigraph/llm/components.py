"""Connected components of verified links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the least node id reached.

    Rounds of least neighbouring label and of following labels, until none changes; each round is written to the shared
    folder. Labels are pre-aggregated before each shuffle, so a hub costs one row a task.
    """
    pairs = edges.select("a", "b").filter("a <> b")
    sym = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = materialize(sym.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = sym.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        step = label.join(near, label["node"] == near["a"]).select("node", "component", F.least("component", "m").alias("new"))
        up = label.select(F.col("node").alias("new"), F.col("component").alias("above"))
        after = materialize(step.join(up, "new").select("node", F.least("new", "above").alias("next"), (F.col("component") != F.least("new", "above")).alias("changed")))
        label = after.select("node", F.col("next").alias("component"))
        if after.filter("changed").isEmpty():
            return label
