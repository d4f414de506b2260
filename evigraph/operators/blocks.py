"""Scores of many query vectors against all nodes, block by block.

Nodes and queries are dealt into blocks; each pair of blocks is one matrix product in one task, of which only the best few
nodes a query go on. Vectors of other lengths or without a direction meet nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of nodes and of queries, queries multiplied at a time.
NODE_BLOCK, QUERY_BLOCK, AT_ONCE = 20_000, 4_000, 256
NEAR = "query_id bigint, node_id bigint, score double, rated double, met bigint"


def _matrix(column) -> np.ndarray:
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines row by row, summed in order: equal rows give equal numbers wherever they stand."""
    in_order = lambda a, b: np.cumsum(a * b, axis=1)[:, -1]
    return in_order(x, y) / (np.sqrt(in_order(x, x)) * np.sqrt(in_order(y, y)))


def best(nodes: pa.Table, queries: pa.Table, k: int, least: float | None, plane: bool) -> pa.Table:
    """The k best nodes of a block for each query: by score, or where ``plane`` by boosted score among signatures that fit."""
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    n, q = nodes.num_rows, queries.num_rows
    if n and q:
        x, y = _matrix(nodes["vec"]), _matrix(queries["vec"])
        ids, asked = nodes["id"].to_numpy(), queries["query_id"].to_numpy()
        ux, uy = _unit(x), _unit(y)
        if plane:
            boost, sig = nodes["boost"].to_numpy(), nodes["signature"].to_numpy().view(np.uint64)
            qsig, other = queries["signature"].to_numpy().view(np.uint64), queries["other"].to_numpy().view(np.uint64)
            need = np.maximum(1, np.bitwise_count(qsig).astype(np.int64) - 1)
        for lo in range(0, q, AT_ONCE):
            at = np.arange(lo, min(q, lo + AT_ONCE))
            s = uy[at] @ ux.T
            if plane:
                fits = np.bitwise_count(sig[None, :] & qsig[at, None]) >= need[at, None]
                # A node that shares both bits a query is met by is taken where it meets the first.
                fits &= (sig[None, :] & other[at, None]) == 0
                met = fits.sum(1)
                s = np.where(fits, s + boost[None, :], -np.inf)
            else:
                met = np.zeros(len(at), np.int64)
            cut = min(k, n)
            edge = np.partition(s, n - cut, axis=1)[:, n - cut] - 1e-9  # a little more than k, since products round
            i, j = np.nonzero((s >= np.maximum(edge, -1e300)[:, None]) & (s > -np.inf))
            if not len(i):
                continue
            score = exact(x[j], y[at[i]])
            rated = np.round(score + boost[j], 9) if plane else score
            order = np.lexsort((ids[j], -rated, i))
            i, j, score, rated = i[order], j[order], score[order], rated[order]
            first = np.r_[0, np.flatnonzero(np.diff(i)) + 1]
            place = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
            keep = place < k
            if least is not None:
                keep &= score >= least
            for col, v in zip(out, (asked[at[i]], ids[j], score, rated, np.where(place == 0, met[i], 0)), strict=True):
                col.append(v[keep])
    types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
    cols = [pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, types, strict=True)]
    return pa.table(cols, names=["query_id", "node_id", "score", "rated", "met"])


def _blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def _dealt(nodes: DataFrame, queries: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the numbers of their blocks: each block of one meets each of the other."""
    size = lambda df, block: _blocks(df.count(), block)
    a, b = size(nodes, NODE_BLOCK), size(queries, QUERY_BLOCK)
    own = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    all_of = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    direction = lambda df: df.withColumn("vec", F.col("vec").cast("array<double>")).filter(F.exists("vec", lambda x: x != 0)).withColumn("dim", F.size("vec"))
    return direction(nodes).withColumn("nb", own("id", a)).withColumn("qb", all_of(b)), direction(queries).withColumn("qb", own("query_id", b)).withColumn("nb", all_of(a))


def nearest(nodes: DataFrame, queries: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """(query_id, node_id, score, rank) of (id, vec) and (query_id, vec): exact cosine, ties by id, at most k a query.

    Each task reads one block of both sides; a query's best of all blocks meet in one window of k rows a block.
    """
    keys = ["nb", "qb", "dim"]
    n, q = _dealt(nodes.select("id", "vec"), queries.select("query_id", "vec"), keys)
    found = n.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(lambda a, b: best(a, b, k, least, False), NEAR)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "node_id", "score", "rank")


def _bit(signature: Column, i) -> Column:
    return F.call_function("shiftright", signature, i).bitwiseAND(F.lit(1)) == 1


def _bits(signature: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: _bit(signature, i))


def in_plane(nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, node_id, score, rated, met): for each query the k best nodes by boosted cosine whose signature holds all
    bits of the query's but one, from blocks that share a bit; a query's ``met`` add up to the number of all such nodes.

    Of any two bits of a query at least one is in such a node, so two bits (or its only one) are asked for.
    """
    keys = ["bit", "nb", "qb", "dim"]
    n, q = _dealt(nodes.select("id", "vec", "signature", "boost"), queries.select("query_id", "vec", "signature"), keys)
    n = n.withColumn("bit", F.explode(_bits(F.col("signature"))))
    asked = F.slice(_bits(F.col("signature")), 1, 2)
    q = q.select("*", F.posexplode(asked).alias("place", "bit"), asked.alias("asked"))
    mask = F.when(F.col("place") == 1, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.get("asked", F.lit(0)))).otherwise(F.lit(0).cast("bigint"))
    q = q.select("query_id", "vec", "signature", mask.alias("other"), *keys)
    return n.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(lambda a, b: best(a, b, k, None, True), NEAR)
