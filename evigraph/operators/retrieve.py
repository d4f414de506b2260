"""Vector and causal retrieval, many queries at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions.scalar import clamp, cosine
from evigraph.operators import blocks
from evigraph.shared import discard, materialize

#: Thresholds of causal search, nodes a walk looks at, hops and weight of lattice activation.
STABLE, AMBIGUOUS_COSINE, AMBIGUOUS_SHARE, LOW = 0.42, 0.97, 0.34, 0.45
ANCHORS, CANDIDATE_FLOOR, SYMPTOM_BOOST = 12, 64, 0.15
MOST_VISITS, LATTICE_HOPS, LATTICE_WEIGHT, DECAY, DEFECT, CROSS_LAYER = 20_000, 3, 0.25, 0.65, 0.4, 0.25
#: Hops of a walk from all roots between two written tables.
AT_ONCE = 6

knn = blocks.nearest


def with_norm(rows: DataFrame) -> DataFrame:
    return rows.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)))


def top_k(nodes: DataFrame, vector: list[float], k: int) -> DataFrame:
    """(node_id, score) of one query vector, exact, ties by id."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    rows = with_norm(nodes).filter("norm > 0").select(F.col("id").alias("node_id"), cosine(F.col("vec"), q).alias("score"))
    return rows.orderBy(F.desc("score"), "node_id").limit(k)


def _hops(edges: DataFrame) -> DataFrame:
    against = (F.col("role") == "contradicts") if "role" in edges.columns else F.lit(False)
    return edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "edge_id", clamp(F.col("confidence")).alias("c"), against.alias("against"))


def root_walks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, root, depth, rev_edges, nodes, score, contra) of every node that reaches a root against the edges.

    All roots are walked from at once, so the work is that of the edges, not of edges times anchors. A queue in order of
    edge ids meets first the root at the least depth and, at equal depth, the least list of edges; that list starts with
    the least edge to a node one step nearer, so each node needs its next edge alone. A round takes AT_ONCE hops from the
    nodes that the last one found farthest out; a node that stays is a hop to itself, so one shuffle a hop is enough.
    """
    steps = _hops(edges)
    own = nodes.select(F.col("id").alias("at"), F.col("id").alias("to"), F.lit(-1).cast("bigint").alias("edge_id"), F.lit(1.0).alias("c"), F.lit(False).alias("against"))
    hops = materialize(steps.unionByName(own))
    none = F.array().cast("array<bigint>")
    front = materialize(nodes.filter("root").select("id", F.col("id").alias("root"), F.lit(0).alias("depth"), none.alias("rev_edges"), F.array("id").alias("nodes"), F.lit(1.0).alias("score"), F.lit(False).alias("contra")))
    parts, depth, new = [front], 0, F.col("edge_id") >= 0
    put = lambda first, rest: F.when(new, F.concat(F.array(first), rest)).otherwise(F.col(rest))
    while not front.isEmpty():
        depth += AT_ONCE
        for _ in range(AT_ONCE):
            met = front.withColumnRenamed("id", "at").join(hops, "at").select(
                F.col("to").alias("id"), "root", (F.col("depth") + new.cast("int")).alias("depth"), put("edge_id", "rev_edges").alias("rev_edges"), put("to", "nodes").alias("nodes"),
                (F.col("score") * F.col("c")).alias("score"), (F.col("contra") | F.col("against")).alias("contra"), "edge_id",
            )
            best = F.min_by(F.struct("root", "depth", "rev_edges", "nodes", "score", "contra"), F.struct("depth", "edge_id"))
            front = met.groupBy("id").agg(best.alias("x")).select("id", "x.*")
        part = materialize(front.join(_union(parts).select("id"), "id", "left_anti"))
        parts.append(part)
        front = part.filter(F.col("depth") == depth)
    out = materialize(_union(parts))
    discard(hops, *parts)
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _long_queues(anchors: DataFrame, edges: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """Of anchors (anchor, depth), those whose queue can have met more than ``most`` nodes by that depth: more walks of up
    to ``depth`` steps lead from it. Counting stops at the depth where no anchor is left in doubt."""
    hops, ends = materialize(_hops(edges).select("at", "to")), materialize(nodes.select("id"))
    reach, k = materialize(ends.withColumn("reach", F.lit(1.0))), 0
    left, long_ = anchors.filter("depth > 0"), []
    while not left.isEmpty():
        k += 1
        more = hops.join(reach.withColumnRenamed("id", "at"), "at").groupBy(F.col("to").alias("id")).agg(F.sum("reach").alias("more"))
        before, reach = reach, materialize(ends.join(more, "id", "left").select("id", (1 + F.coalesce("more", F.lit(0.0))).alias("reach")))
        discard(before)
        now = left.join(reach.withColumnRenamed("id", "anchor"), "anchor")
        long_.append(materialize(now.filter(F.col("reach") > most).select("anchor")))
        left = materialize(now.filter((F.col("reach") <= most) & (F.col("depth") > k)).select("anchor", "depth"))
    discard(hops, ends, reach)
    return _union(long_) if long_ else anchors.select("anchor").limit(0)


def _bounded(anchors: DataFrame, edges: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(anchor, root, depth, rev_edges, nodes, score, contra) by a queue for each anchor that looks at ``most`` nodes."""
    hops = materialize(_hops(edges))
    is_root = materialize(nodes.select(F.col("id").alias("at"), "root"))
    front = anchors.select("anchor", F.col("anchor").alias("at"), F.array().cast("array<bigint>").alias("rev_edges"), F.array("anchor").alias("path"), F.array().cast("array<double>").alias("cs"), F.lit(False).alias("contra"), F.lit(0).cast("bigint").alias("looked"))
    seen = found = None
    depth, written = 0, [hops, is_root]
    while True:
        queue = Window.partitionBy("anchor").orderBy("rev_edges")
        rows = front.join(is_root, "at").withColumn("place", F.col("looked") + F.row_number().over(queue))
        rows = rows.withColumns({"looked": F.max("place").over(Window.partitionBy("anchor")), "hit": F.min(F.when(F.col("root"), F.col("place"))).over(Window.partitionBy("anchor"))})
        rows = materialize(rows.filter(F.col("place") <= most))
        written.append(rows)
        won = rows.filter("place = hit").select("anchor", F.col("at").alias("root"), F.lit(depth).alias("depth"), "rev_edges", F.col("path").alias("nodes"), F.aggregate(F.reverse("cs"), F.lit(1.0), lambda s, x: s * x).alias("score"), "contra")
        found = won if found is None else found.unionByName(won)
        seen = rows.select("anchor", "at") if seen is None else seen.unionByName(rows.select("anchor", "at"))
        step = rows.filter("hit IS NULL").join(hops.select(F.col("to").alias("at"), F.col("at").alias("next"), "edge_id", "c", "against"), "at")
        step = step.select("anchor", F.col("next").alias("at"), F.concat("rev_edges", F.array("edge_id")).alias("rev_edges"), F.concat("path", F.array("next")).alias("path"), F.concat("cs", F.array("c")).alias("cs"), (F.col("contra") | F.col("against")).alias("contra"), "looked")
        front = step.join(seen, ["anchor", "at"], "left_anti").groupBy("anchor", "at").agg(F.min(F.struct("rev_edges", "path", "cs", "contra", "looked")).alias("x")).select("anchor", "at", "x.*")
        front = materialize(front)
        written.append(front)
        if front.isEmpty():
            break
        depth += 1
    out = materialize(found)
    discard(*written)
    return out


def reverse_roots(anchors: DataFrame, edges: DataFrame, nodes: DataFrame, most_visits: int = MOST_VISITS) -> DataFrame:
    """(anchor, root, depth, rev_edges, nodes, score, contra): the first root met breadth-first against the edges, in order
    of edge ids, among the first ``most_visits`` nodes of the queue. Anchors that are roots win with no edge.

    Only anchors whose queue may be longer than that are walked from one by one.
    """
    walks = root_walks(edges, nodes)
    own = anchors.select("anchor").distinct().join(walks.withColumnRenamed("id", "anchor"), "anchor")
    if nodes.count() <= most_visits:  # no queue can be longer
        return own
    own = materialize(own)
    far = materialize(_long_queues(own.select("anchor", "depth"), edges, nodes, most_visits))
    near = own.join(far, "anchor", "left_anti")
    return near if far.isEmpty() else near.unionByName(_bounded(far, edges, nodes, most_visits))


def bond_factors(edges: DataFrame) -> DataFrame:
    """(id, to, w): what share of a signal a bond hands on, in either direction."""
    w = DECAY * clamp(F.col("bond_strength")) * F.when(F.col("bond") == "defect", DEFECT).otherwise(1.0) * F.when(F.col("cross_layer"), CROSS_LAYER).otherwise(1.0)
    steps = edges.select(F.col("src").alias("id"), F.col("dst").alias("to"), w.alias("w"))
    return steps.unionByName(steps.select(F.col("to").alias("id"), F.col("id").alias("to"), "w"))


def activate(seeds: DataFrame, edges: DataFrame, hops: int = LATTICE_HOPS, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, id, a): the strongest signal over walks of up to ``hops`` bonds from the seeds (*by, id, a)."""
    steps, out = bond_factors(edges), seeds.select(*by, "id", "a")
    for _ in range(hops):
        out = out.unionByName(out.join(steps, "id").select(*by, F.col("to").alias("id"), (F.col("a") * F.col("w")).alias("a"))).groupBy(*by, "id").agg(F.max("a").alias("a"))
    return out


def khop(seeds: DataFrame, edges: DataFrame, hops: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, id, node, hops): nodes within so many edges (src, dst) in either direction of each seed (*by, id), itself not
    among them, at their least distance."""
    both = edges.select(F.col("src").alias("at"), F.col("dst").alias("node"))
    both = both.unionByName(both.select(F.col("node").alias("at"), F.col("at").alias("node"))).distinct()
    keys = [*by, "id", "node"]
    reached = seeds.select(*by, "id", F.col("id").alias("node"), F.lit(0).alias("hops"))
    for k in range(1, hops + 1):
        more = reached.filter(F.col("hops") == k - 1).withColumnRenamed("node", "at").join(both, "at").select(*keys, F.lit(k).alias("hops"))
        reached = reached.unionByName(more).groupBy(*keys).agg(F.min("hops").alias("hops"))
    return reached.filter("hops > 0")


def find_anchors(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, anchor, anchor_score, incident, rank): the best candidates by boosted cosine.

    Candidates are the nodes of fitting signatures; a query with fewer than the floor has the nearest nodes too.
    """
    boost = F.when(F.col("symptom") | F.col("impact"), SYMPTOM_BOOST).otherwise(0.0)
    rows = nodes.select("id", "vec", "signature", "incident", boost.alias("boost"))
    fit = materialize(blocks.in_plane(rows, queries, ANCHORS))
    met = fit.groupBy("query_id").agg(F.sum("met").alias("met"))
    few = queries.join(met, "query_id", "left").filter(F.coalesce("met", F.lit(0)) < CANDIDATE_FLOOR).select("query_id", "vec")
    near = blocks.nearest(rows, few, CANDIDATE_FLOOR)
    some = fit.select("query_id", "node_id", "rated").unionByName(near.join(rows.select(F.col("id").alias("node_id"), "boost"), "node_id").select("query_id", "node_id", F.round(F.col("score") + F.col("boost"), 9).alias("rated")))
    w = Window.partitionBy("query_id").orderBy(F.desc("anchor_score"), "node_id")
    some = some.groupBy("query_id", "node_id").agg(F.max("rated").alias("anchor_score")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= ANCHORS)
    out = some.join(rows.select(F.col("id").alias("node_id"), "incident"), "node_id").select("query_id", F.col("node_id").alias("anchor"), "anchor_score", "incident", "rank")
    out = materialize(out)
    discard(fit)
    return out


def causal_search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, mode: str = "balanced", lattice: bool = False) -> DataFrame:
    """One row a query (query_id, vec, signature): abstain, reason, target, confidence, degeneracy.

    Signature candidates (topped up by nearest ones below the floor), anchors by boosted cosine, walk to roots, score by
    root: how many paths agree, how varied their edges are, less the share that holds a contradiction, and with
    ``lattice`` the strongest signal that bonds carry from the anchors to a path's nodes. ``edges`` are those the mode
    allows. The chain's root is the answer.
    """
    anchors = find_anchors(queries, nodes)
    share = anchors.groupBy("query_id", "incident").agg(F.count("*").alias("k")).groupBy("query_id").agg((F.max("k") / F.sum("k")).alias("share"))
    best = anchors.groupBy("query_id").agg(F.max("anchor_score").alias("top"))
    walks = reverse_roots(anchors.select("anchor"), edges, nodes)
    paths = anchors.join(walks, "anchor").withColumn("path_score", F.col("anchor_score") * F.col("score"))
    by_root = paths.groupBy("query_id", "root").agg(
        F.count("*").alias("deg"),
        F.size(F.array_distinct(F.flatten(F.collect_list("rev_edges")))).alias("distinct_edges"),
        F.sum("path_score").alias("total"),
        F.avg(F.col("contra").cast("int")).alias("against"),
    )
    if lattice:
        signal = activate(anchors.select("query_id", F.col("anchor").alias("id"), F.col("anchor_score").alias("a")), edges, by=("query_id",)).filter("a > 0")
        on_path = paths.select("query_id", "root", F.explode("nodes").alias("id")).join(signal, ["query_id", "id"]).groupBy("query_id", "root").agg(F.max("a").alias("signal"))
        by_root = by_root.join(on_path, ["query_id", "root"], "left")
    one = F.lit(1.0)
    raw = 0.35 * F.least(one, F.col("deg") / 3) + 0.25 * F.least(one, F.col("distinct_edges") / F.col("deg") / 4) - 0.25 * F.col("against") + F.col("total") / F.col("deg")
    if lattice:
        raw = raw + LATTICE_WEIGHT * F.least(one, F.coalesce("signal", F.lit(0.0)))
    by_root = by_root.withColumn("raw", F.round(raw, 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("raw"), "root")
    best_root = by_root.withColumn("k", F.row_number().over(w)).filter("k = 1").select("query_id", "root", "deg", clamp(F.col("raw")).alias("confidence"))
    out = queries.select("query_id").join(best, "query_id", "left").join(share, "query_id", "left").join(best_root, "query_id", "left")
    theoretical = F.lit(mode == "theoretical")
    reason = (
        F.when(F.col("top").isNull() | (F.col("top") < STABLE), "NO_STABLE_ANCHOR")
        .when((F.col("top") < AMBIGUOUS_COSINE) & (F.col("share") < AMBIGUOUS_SHARE) & ~theoretical, "AMBIGUOUS")
        .when(F.col("root").isNull(), "NO_PATH")
        .when((F.col("confidence") < LOW) & ~theoretical, "LOW_STABILITY")
        .otherwise("")
    )
    out = out.withColumn("reason", reason).withColumn("abstain", F.col("reason") != "")
    answered = ~F.col("abstain") | (F.col("reason") == "LOW_STABILITY")
    return out.select("query_id", "abstain", "reason", F.when(answered, F.col("root")).alias("target"), F.round(F.when(answered, F.col("confidence")), 6).alias("confidence"), F.when(answered, F.col("deg")).alias("degeneracy"))
