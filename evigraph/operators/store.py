"""Versioned scans, neighbourhoods and change application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators import ranges

#: The six neighbours of a hexagonal cell.
HEX_STEPS = [(1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)]


def visible(version: int):
    return (F.col("created") <= version) & (F.col("deleted") > version)


def snapshot_nodes(nodes: DataFrame, version: int) -> DataFrame:
    return nodes.filter(visible(version))


def snapshot_edges(edges: DataFrame, nodes: DataFrame, version: int) -> DataFrame:
    """Edges that are visible and whose ends are; deleting a node hides its edges."""
    ids = snapshot_nodes(nodes, version).select(F.col("id").alias("__id"))
    out = edges.filter(visible(version))
    out = out.join(ids, F.col("src") == F.col("__id"), "left_semi")
    return out.join(ids, F.col("dst") == F.col("__id"), "left_semi")


def hex_neighbours(cells: DataFrame) -> DataFrame:
    """(id, neighbour) of cells (id, q, r, layer) that touch in one layer: six offsets and an equi-join."""
    steps = F.array(*[F.struct(F.lit(a).alias("dq"), F.lit(b).alias("dr")) for a, b in HEX_STEPS])
    probe = cells.select("id", "q", "r", "layer", F.inline(steps)).select("id", (F.col("q") + F.col("dq")).alias("q"), (F.col("r") + F.col("dr")).alias("r"), "layer")
    return probe.join(cells.withColumnRenamed("id", "neighbour"), ["q", "r", "layer"]).select("id", "neighbour")


def cross_layer_neighbours(cells: DataFrame) -> DataFrame:
    """(id, neighbour) at most one step apart on each axis in another layer: nine offsets and an equi-join."""
    steps = F.array(*[F.struct(F.lit(a).alias("dq"), F.lit(b).alias("dr")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    probe = cells.select("id", "q", "r", "layer", F.inline(steps)).select("id", (F.col("q") + F.col("dq")).alias("q"), (F.col("r") + F.col("dr")).alias("r"), "layer")
    other = cells.select(F.col("id").alias("neighbour"), "q", "r", F.col("layer").alias("other"))
    return probe.join(other, ["q", "r"]).filter("layer <> other").select("id", "neighbour")


def edge_faults(edges: DataFrame, nodes: DataFrame, version: int) -> DataFrame:
    """(edge_id, faults) of edges that may not be stored."""
    ids = snapshot_nodes(nodes, version).select("id")
    out = edges.join(ids.select(F.col("id").alias("src"), F.lit(True).alias("has_src")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("has_dst")), "dst", "left")
    bad = lambda c: F.isnan(c) | ~F.col(c).between(0.0, 1.0)
    faults = F.filter(
        F.array(
            F.when(F.col("has_src").isNull() | F.col("has_dst").isNull(), "ENDPOINT_NOT_VISIBLE"),
            F.when(bad("confidence"), "CONFIDENCE_OUT_OF_RANGE"),
            F.when(bad("bond_strength"), "BOND_STRENGTH_OUT_OF_RANGE"),
        ),
        lambda x: x.isNotNull(),
    )
    return out.select("edge_id", F.concat_ws(",", faults).alias("faults")).filter("faults <> ''")


def compact(nodes: DataFrame, edges: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """What a checkpoint keeps: visible rows alone; earlier versions are gone."""
    return snapshot_nodes(nodes, version), snapshot_edges(edges, nodes, version)


def upsert(existing: DataFrame, request: DataFrame, keys: list[str], values: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inserts, replays, conflicts): unknown keys, keys with equal values, keys with other values. First of a key counts."""
    request = request.groupBy(*keys).agg(F.min(F.struct("seq", *values)).alias("x")).select(*keys, *[F.col(f"x.{v}").alias(v) for v in values])
    old = existing.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values])
    met = request.join(old, keys)
    same = None
    for v in values:
        test = F.col(v).eqNullSafe(F.col(f"old_{v}"))
        same = test if same is None else same & test
    return request.join(existing.select(*keys), keys, "left_anti"), met.filter(same).select(*keys, *values), met.filter(~same)


#: Fixed value: bytes of the longest content.
MOST_CONTENT = 16 * 1024 * 1024


def put_nodes(existing: DataFrame, request: DataFrame, dim: int, next_id: int, most_content: int = MOST_CONTENT, need_cell: bool = False) -> DataFrame:
    """(seq, id, code) of new nodes (seq, content, vec, q, r, layer) in order of seq, against the cells (q, r, layer) of
    existing ones.

    A vector of another size or with a number that isn't finite, content that is too long, and a cell that is held or that
    an earlier node of the request took are refused with a code and no id; the others get dense ids from ``next_id`` on.
    """
    c = F.col
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    keys = ["q", "r", "layer"]
    held = existing.select(*keys).filter("q IS NOT NULL").distinct().withColumn("held", F.lit(True))
    rows = request.join(held, keys, "left").withColumn(
        "code",
        F.when(c("vec").isNull() | (F.size("vec") != dim) | odd, "DIMENSION_MISMATCH").when(F.coalesce("held", F.lit(False)), "DUPLICATE_CELL").when(F.lit(need_cell) & c("q").isNull(), "CELL_REQUIRED").when(F.octet_length("content") > most_content, "CONTENT_TOO_LARGE"),
    )
    first = rows.filter("code IS NULL AND q IS NOT NULL").groupBy(*keys).agg(F.min("seq").alias("first"))
    rows = rows.join(first, keys, "left").withColumn("code", F.coalesce("code", F.when(c("first") < c("seq"), "DUPLICATE_CELL"), F.lit("")))
    rows = rows.select("seq", "code", F.lit(0).alias("one"), ranges.bucket("seq").alias("b"))
    good = ranges.before(rows.filter("code = ''"), ["one"], ["b"], ["seq"], {}, count="n")
    return good.select("seq", (c("n") + next_id).alias("id"), "code").unionByName(rows.filter("code <> ''").select("seq", F.lit(None).cast("bigint").alias("id"), "code"))


def quarantine(episodes: DataFrame, requests: DataFrame) -> DataFrame:
    """(tenant, id, outcome) of requests (tenant, id): a held episode stays, an unknown one is reported, any other is set
    apart."""
    known = episodes.select("tenant", "id", "hold")
    out = requests.join(known, ["tenant", "id"], "left")
    return out.select("tenant", "id", F.when(F.col("hold").isNull(), "not_found").when(F.col("hold"), "legal_hold").otherwise("quarantined").alias("outcome"))


def stamped(records: DataFrame, adapter: str) -> DataFrame:
    """Records (external_id, type, metadata) with who brought them, in their metadata; own entries of those names give way."""
    mark = F.create_map(F.lit("external_id"), F.col("external_id"), F.lit("type"), F.col("type"), F.lit("adapter"), F.lit(adapter))
    own = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("external_id", "type", "adapter"))
    return records.withColumn("metadata", F.map_concat(own, mark))


def _digest(df: DataFrame) -> DataFrame:
    """Rows of a table and two figures over the hashes of all of them, whatever their order."""
    h = F.xxhash64(*[F.to_json(F.struct(c)) if t.startswith(("map", "variant")) else F.col(c) for c, t in df.dtypes])
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("mixed"), F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("total"))


def backup(tables: dict[str, DataFrame], path: str) -> None:
    """Write tables below ``path`` with a manifest of their rows and digests."""
    manifest = None
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        row = _digest(df).withColumn("name", F.lit(name))
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")


def restore(spark, path: str) -> dict[str, DataFrame]:
    """The tables of a backup; one whose rows or digest differ from the manifest raises."""
    out = {}
    for said in spark.read.parquet(f"{path}/manifest").collect():  # a row a table
        df = spark.read.parquet(f"{path}/{said['name']}")
        got = _digest(df).first()
        if (got["rows"], got["mixed"], got["total"]) != (said["rows"], said["mixed"], said["total"]):
            raise ValueError(f"backup of {said['name']} in {path} is damaged")
        out[said["name"]] = df
    return out
