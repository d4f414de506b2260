"""A world of claims: additions, status changes, audits and a saved form whose event checksums are verified on reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions.scalar import fnv1a
from evigraph.operators import ranges

STATUSES = ("proposed", "active", "contested", "verified", "retired")
FORMAT = "MWV1"


def checksum() -> Column:
    """Hash of an event (sequence, node_id, action, before, after, reason): that of its fields' texts end to end."""
    c = F.col
    fields = (c("sequence").cast("string"), c("node_id").cast("string"), c("action"), c("before"), c("after"), c("reason"))
    return fnv1a(F.concat(*[F.coalesce(f, F.lit("")) for f in fields]))


def added(nodes: DataFrame, reason: str) -> DataFrame:
    """Events of new claims (id, status); an event's sequence is its place in the log."""
    rows = nodes.select(F.lit(0).alias("__one"), ranges.bucket("id").alias("__b"), F.col("id").alias("node_id"), F.lit("add").alias("action"), F.lit("proposed").alias("before"), F.col("status").alias("after"), F.lit(reason).alias("reason"))
    rows = ranges.before(rows, ["__one"], ["__b"], ["node_id"], {}, count="__n").withColumn("sequence", F.col("__n") + 1)
    return rows.withColumn("checksum", checksum()).select("sequence", "node_id", "action", "before", "after", "reason", "checksum")


def updated(nodes: DataFrame, requests: DataFrame, first: int) -> tuple[DataFrame, DataFrame]:
    """(nodes with their last status, events) of requests (seq, node_id, status, reason) in order of seq.

    A claim becomes verified only with evidence and an origin that is neither inferred nor hypothetical; other requests for
    it, and those for unknown claims, change nothing. ``first`` is the sequence before the first event.
    """
    known = nodes.select(F.col("id").alias("node_id"), F.col("status").alias("was"), "origin", "n_evidence")
    may = (F.col("status") != "verified") | (~F.col("origin").isin("inferred", "hypothetical") & (F.col("n_evidence") > 0))
    good = requests.join(known, "node_id").filter(may).withColumns({"__b": ranges.bucket("seq"), "__one": F.lit(0)})
    good = ranges.before(good, ["node_id"], ["__b"], ["seq"], {"__last": F.col("status")})
    good = ranges.before(good, ["__one"], ["__b"], ["seq"], {}, count="__n")
    events = good.select((F.col("__n") + 1 + first).alias("sequence"), "node_id", F.lit("status").alias("action"), F.coalesce("__last", "was").alias("before"), F.col("status").alias("after"), "reason")
    last = good.groupBy("node_id").agg(F.max_by("status", "seq").alias("__new")).withColumnRenamed("node_id", "id")
    out = nodes.join(last, "id", "left").withColumn("status", F.coalesce("__new", "status")).drop("__new")
    return out.select(*nodes.columns), events.withColumn("checksum", checksum())


def audit(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """(job, id, code) of what a world must not hold; jobs are numbered in the order of a scheduler's run."""
    c = F.col
    codes = F.array_compact(
        F.array(
            F.when((c("status") == "verified") & (c("n_evidence") == 0), F.struct(F.lit(4).alias("job"), F.lit("VERIFIED_WITHOUT_EVIDENCE").alias("code"))),
            F.when((c("status") == "verified") & c("origin").isin("inferred", "hypothetical"), F.struct(F.lit(3).alias("job"), F.lit("SILENT_TRUTH_PROMOTION").alias("code"))),
            F.when((c("kind") == "hypothesis") & (c("status") == "active") & (c("n_evidence") == 0), F.struct(F.lit(2).alias("job"), F.lit("ACTIVE_HYPOTHESIS_WITHOUT_EVIDENCE").alias("code"))),
        )
    )
    found = nodes.select("id", F.inline(codes)).select("job", "id", "code")
    broken = events.filter(~c("checksum").eqNullSafe(checksum())).select(F.lit(5).alias("job"), c("node_id").alias("id"), F.lit("EVENT_CHECKSUM_MISMATCH").alias("code"))
    return found.unionByName(broken)


def scheduled(findings: DataFrame, most: int) -> DataFrame:
    """(job, id, code, bounded): the first ``most`` findings by job, then claim; ``bounded`` says that these are all."""
    total = findings.agg((F.count("*") <= most).alias("bounded"))
    return findings.orderBy("job", "id", "code").limit(most).crossJoin(F.broadcast(total))  # one row


def save(nodes: DataFrame, events: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/{FORMAT}/nodes")
    events.write.mode("overwrite").parquet(f"{path}/{FORMAT}/events")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, events) of a saved world; an event whose checksum is off raises."""
    nodes, events = spark.read.parquet(f"{path}/{FORMAT}/nodes"), spark.read.parquet(f"{path}/{FORMAT}/events")
    if not events.filter(~F.col("checksum").eqNullSafe(checksum())).isEmpty():
        raise ValueError(f"event checksum mismatch in {path}")
    return nodes, events
