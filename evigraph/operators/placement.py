"""Cells for new nodes by meaning, shared metadata and time, each against one snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions.scalar import cosine, hex_distance
from evigraph.operators import blocks
from evigraph.operators.retrieve import khop

#: Nodes met by vector and by each metadata key, anchors kept, weights, reach and thresholds.
NEAREST, PER_KEY, MOST_ANCHORS, RADIUS, REACH, BOND_HOPS = 32, 16, 24, 3, 4, 3
KEYS = ("account", "service", "incident", "repo", "source")
ANCHOR_WEIGHTS, CELL_WEIGHTS = (0.65, 0.25, 0.10), (0.45, 0.25, 0.15)
LEAST_ANCHOR, LEAST_CELL, CROWD, CROWDING = 0.05, 0.02, 6, 0.025
#: Metadata that says when, not what.
TIMES = ("placement_policy", "valid_from", "valid_until")


def _ring() -> list[tuple[int, int]]:
    """The cell itself, then those at most RADIUS away in order of their offsets."""
    r = range(-RADIUS, RADIUS + 1)
    return [(0, 0), *[(a, b) for a in r for b in r if max(abs(a), abs(b), abs(a + b)) <= RADIUS]]


def anchors(new: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(met, anchors): all nodes (query_id, id) that a new node (query_id, vec, metadata) meets, and the best of them with
    their cells and how alike they are. Nodes are (id, vec, metadata, q, r, layer)."""
    near = blocks.nearest(nodes, new, NEAREST).select("query_id", F.col("node_id").alias("id"))
    pairs = lambda df, i: df.select(F.col(i), F.explode(F.map_filter("metadata", lambda k, v: k.isin(*KEYS))).alias("k", "v"))
    first = Window.partitionBy("k", "v").orderBy("id")
    listed = pairs(nodes, "id").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= PER_KEY).drop("n")
    met = near.unionByName(pairs(new, "query_id").join(listed, ["k", "v"]).select("query_id", "id")).distinct()
    other = nodes.select("id", F.col("vec").alias("own_vec"), F.col("metadata").alias("own"), "q", "r", "layer").filter("q IS NOT NULL")
    rows = met.join(other, "id").join(new, "query_id")
    shared = F.filter(F.array_intersect(F.map_keys("metadata"), F.map_keys("own")), lambda k: ~k.isin(*TIMES))
    equal = F.size(F.filter(shared, lambda k: F.col("metadata")[k] == F.col("own")[k]))
    month = lambda k: (F.length(F.col("metadata")[k]) >= 7) & (F.length(F.col("own")[k]) >= 7) & (F.substring(F.col("metadata")[k], 1, 7) == F.substring(F.col("own")[k], 1, 7))
    alike = rows.select(
        "query_id", "id", "q", "r", "layer",
        F.greatest(F.lit(-1.0), cosine(F.col("vec"), F.col("own_vec"))).alias("sem"),
        F.when(F.size(shared) > 0, equal / F.size(shared)).otherwise(0.0).alias("meta"),
        (F.when(F.coalesce(month("valid_from"), F.lit(False)), 0.6).otherwise(0.0) + F.when(F.coalesce(month("valid_until"), F.lit(False)), 0.4).otherwise(0.0)).alias("time"),
    )
    a, b, c = ANCHOR_WEIGHTS
    alike = alike.withColumn("rated", F.round(a * F.col("sem") + b * F.col("meta") + c * F.col("time"), 9)).filter(F.col("rated") > LEAST_ANCHOR)
    w = Window.partitionBy("query_id").orderBy(F.desc("rated"), "id")
    return met, alike.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= MOST_ANCHORS)


def place(new: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, q, r, layer, score): the free cell near the anchors of a new node that scores best, null where none does
    well enough (the caller then takes the next cell of the spiral). Each new node is placed as if it were the only one.

    Cells of the nodes met, and of those up to three bonds from them, are taken. Ties go to the better anchor's cells, and
    there to the first in order.
    """
    met, best = anchors(new, nodes)
    cells = nodes.select("id", "q", "r", "layer").filter("q IS NOT NULL")
    taken = met.join(cells, "id").select("query_id", "id", "q", "r", "layer")
    around = khop(taken.select("query_id", "id"), edges, BOND_HOPS, by=("query_id",)).select("query_id", F.col("node").alias("id")).join(cells, "id")
    taken = taken.unionByName(around.select(*taken.columns)).select("query_id", "q", "r", "layer").distinct()
    ring = F.array(*[F.struct(F.lit(a).alias("dq"), F.lit(b).alias("dr"), F.lit(k).alias("turn")) for k, (a, b) in enumerate(_ring())])
    free = best.select("query_id", "place", "layer", "q", "r", F.inline(ring))
    free = free.select("query_id", (F.col("q") + F.col("dq")).alias("q"), (F.col("r") + F.col("dr")).alias("r"), "layer", F.struct("place", "turn").alias("order"))
    free = free.join(taken, ["query_id", "q", "r", "layer"], "left_anti").groupBy("query_id", "q", "r", "layer").agg(F.min("order").alias("order"))
    judge = best.select("query_id", "layer", F.col("q").alias("q2"), F.col("r").alias("r2"), "sem", "meta", "time")
    apart = hex_distance(F.col("q"), F.col("r"), F.col("q2"), F.col("r2"))
    a, b, c = CELL_WEIGHTS
    value = (a * F.col("sem") + b * F.col("meta") + c * F.col("time")) / (1 + F.col("apart"))
    rated = free.join(judge, ["query_id", "layer"]).withColumn("apart", apart).filter(F.col("apart") <= REACH)
    rated = rated.groupBy("query_id", "q", "r", "layer", "order").agg(F.sum(value).alias("sum"), F.count("*").alias("n"))
    rated = rated.withColumn("score", F.round(F.col("sum") - CROWDING * F.greatest(F.lit(0), F.col("n") - CROWD), 9))
    won = rated.groupBy("query_id").agg(F.max_by(F.struct("q", "r", "layer", "score"), F.struct("score", (-F.col("order.place")).alias("p"), (-F.col("order.turn")).alias("t"))).alias("x"))
    out = new.select("query_id").join(won, "query_id", "left")
    good = F.col("x.score") > LEAST_CELL
    return out.select("query_id", *[F.when(good, F.col(f"x.{k}")).alias(k) for k in ("q", "r", "layer")], F.when(good, F.col("x.score")).alias("score"))
