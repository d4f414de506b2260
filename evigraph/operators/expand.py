"""Path expansion: simple reverse paths to roots within budgets, and forward bundles; one join a hop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions.scalar import clamp
from evigraph.schema import MOST_HOPS, MOST_PATHS, MOST_VISITED
from evigraph.shared import materialize

COLUMNS = ["anchor", "at", "nodes", "edges", "score", "contra"]


def _start(anchors: DataFrame) -> DataFrame:
    none = F.array().cast("array<bigint>")
    return anchors.select("anchor", F.col("anchor").alias("at"), F.array("anchor").alias("nodes"), none.alias("edges"), F.lit(1.0).alias("score"), F.lit(False).alias("contra"))


def _step(paths: DataFrame, edges: DataFrame, here: str, there: str, also: tuple[str, ...] = ()) -> DataFrame:
    hop = edges.select(F.col(here).alias("at"), F.col(there).alias("to"), "edge_id", clamp(F.col("confidence")).alias("c"), (F.col("role") == "contradicts").alias("against"))
    out = paths.join(hop, "at").filter(~F.array_contains("nodes", F.col("to")))
    return out.select(
        "anchor",
        F.col("to").alias("at"),
        F.concat("nodes", F.array("to")).alias("nodes"),
        F.concat("edges", F.array("edge_id")).alias("edges"),
        (F.col("score") * F.col("c")).alias("score"),
        (F.col("contra") | F.col("against")).alias("contra"),
        *also,
    )


def budgeted(anchors: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int, most_visited: int = MOST_VISITED, most_paths: int = MOST_PATHS) -> tuple[DataFrame, DataFrame]:
    """(found, cut): every simple path against the edges that ends at its first root, as (anchor, at, nodes, edges, score,
    contra), and the anchors whose search a budget ended.

    A search looks at states in order of depth, then of edge lists; after ``most_visited`` states or ``most_paths`` paths it
    stops. The budgets hold inside each hop, so no hop grows beyond them times the edges of a node.
    """
    roots = materialize(nodes.filter("root").select(F.col("id").alias("at"), F.lit(True).alias("is_root")))
    edges = materialize(edges.select("edge_id", "src", "dst", "confidence", "role"))  # read by every hop
    front = _start(anchors).withColumns({"looked": F.lit(0).cast("bigint"), "had": F.lit(0).cast("bigint")})
    queue, found, cut = Window.partitionBy("anchor").orderBy("edges"), None, None
    last = min(hops, MOST_HOPS)
    for depth in range(last + 1):
        rows = front.join(roots, "at", "left").withColumn("is_root", F.coalesce("is_root", F.lit(False)))
        rows = rows.withColumns({"place": F.col("looked") + F.row_number().over(queue), "ended": F.col("had") + F.sum(F.col("is_root").cast("int")).over(queue.rowsBetween(Window.unboundedPreceding, 0))})
        inside = (F.col("place") <= most_visited) & (F.col("ended") - F.col("is_root").cast("int") < most_paths)
        rows = materialize(rows.withColumn("inside", inside))
        own = rows.filter("inside")
        hit, over = own.filter("is_root").select(*COLUMNS), rows.filter("NOT inside").select("anchor").distinct()
        found = hit if found is None else found.unionByName(hit)
        cut = over if cut is None else cut.unionByName(over)
        if depth == last or own.isEmpty():
            break
        each = Window.partitionBy("anchor")
        on = own.withColumns({"looked": F.max("place").over(each), "had": F.max("ended").over(each)}).filter("NOT is_root")
        front = _step(on, edges, "dst", "src", ("looked", "had"))
    return found, cut.distinct()


def evidence_paths(anchors: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int, **budgets: int) -> DataFrame:
    """The paths of budgeted()."""
    return budgeted(anchors, nodes, edges, hops, **budgets)[0]


def joint_hops(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hops (at, to, ids, needs, c, against) of joint causes from (group, edge_id, src, dst, confidence, role, arity).

    A group counts only whole, with all its sources visible; then each source is reached over all member edges at once,
    at the geometric mean of their confidences.
    """
    seen = members.join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    whole = seen.groupBy("group", F.col("dst").alias("at")).agg(
        F.array_sort(F.collect_list("src")).alias("needs"),
        F.array_sort(F.collect_list("edge_id")).alias("ids"),
        F.pow(F.aggregate(F.array_sort(F.collect_list(clamp(F.col("confidence")))), F.lit(1.0), lambda s, x: s * x), 1 / F.count("*")).alias("c"),
        F.bool_or(F.col("role") == "contradicts").alias("against"),
        F.max("arity").alias("arity"),
    )
    whole = whole.filter((F.size("needs") == F.col("arity")) & (F.size("needs") >= 2))
    return whole.select("at", F.explode("needs").alias("to"), "ids", "needs", "c", "against")


def joint_paths(anchors: DataFrame, nodes: DataFrame, edges: DataFrame, members: DataFrame, hops: int) -> DataFrame:
    """evidence_paths() over edges and joint causes; a joint cause is one hop of several edges."""
    single = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.array("edge_id").alias("ids"), F.array("src").alias("needs"), clamp(F.col("confidence")).alias("c"), (F.col("role") == "contradicts").alias("against"))
    hop = materialize(single.unionByName(joint_hops(members, nodes)))
    roots = materialize(nodes.filter("root").select(F.col("id").alias("at")))
    front, found = _start(anchors), None
    for depth in range(min(hops, MOST_HOPS) + 1):
        front = materialize(front)
        hit = front.join(roots, "at", "left_semi")
        found = hit if found is None else found.unionByName(hit)
        if depth == min(hops, MOST_HOPS) or front.isEmpty():
            break
        on = front.join(roots, "at", "left_anti").join(hop, "at").filter(~F.arrays_overlap("nodes", "needs"))
        front = on.select("anchor", F.col("to").alias("at"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("edges", "ids").alias("edges"), (F.col("score") * F.col("c")).alias("score"), (F.col("contra") | F.col("against")).alias("contra"))
    return found


def forward_arrivals(anchors: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(anchor, at, nodes, edges, score, contra): every arrival along the edges; a node goes on once a depth, from its
    first arrival, the one with the least list of edges."""
    first = Window.partitionBy("anchor", "at").orderBy("edges")
    edges = materialize(edges.select("edge_id", "src", "dst", "confidence", "role"))
    front, found = _start(anchors), None
    for _ in range(min(hops, MOST_HOPS)):
        new = materialize(_step(front, edges, "src", "dst"))
        found = new if found is None else found.unionByName(new)
        if new.isEmpty():
            break
        front = new.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")
    return found
