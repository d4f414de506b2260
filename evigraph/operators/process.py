"""What is in force at each step of a sequence of evidence; running sums, so that no event meets every later one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intervals(events: DataFrame) -> DataFrame:
    """Adds ``until``: the first later step that revokes the event, or null. A revocation names an event of its episode."""
    gone = events.filter("revokes IS NOT NULL").select("episode", F.col("revokes").alias("event_id"), F.col("step").alias("gone_at"))
    first = events.join(gone, ["episode", "event_id"]).filter("gone_at > step").groupBy("episode", "event_id").agg(F.min("gone_at").alias("until"))
    return events.join(first, ["episode", "event_id"], "left")


def changes(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, step, change): plus one where an event comes, minus one where it goes."""
    both = F.inline(F.array(F.struct(F.col("step").alias("at"), F.lit(1).alias("d")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("d"))))
    return rows.select(*keys, both).filter("at IS NOT NULL").groupBy(*keys, F.col("at").alias("step")).agg(F.sum("d").alias("change"))


def active_count(events: DataFrame) -> DataFrame:
    """(episode, step, active)."""
    w = Window.partitionBy("episode").orderBy("step")
    return changes(intervals(events), "episode").select("episode", "step", F.sum("change").over(w).alias("active"))


def step_support(events: DataFrame) -> DataFrame:
    """(episode, hypothesis, step, families, refuted): distinct families of independent support in force, and whether a
    decisive refutation or revocation is."""
    rows = intervals(events)
    keys = ["episode", "bears_on", "family"]
    w = Window.partitionBy(*keys).orderBy("step")
    run = changes(rows.filter("kind = 'support' AND independent"), *keys).withColumn("n", F.sum("change").over(w))
    run = run.withColumn("change", (F.col("n") > 0).cast("int") - (F.coalesce(F.lag("n").over(w), F.lit(0)) > 0).cast("int"))
    families = run.select("episode", F.col("bears_on").alias("hypothesis"), "step", F.col("change").alias("f"), F.lit(0).alias("r"))
    against = changes(rows.filter("kind IN ('refute', 'revoke') AND decisive"), "episode", "bears_on")
    against = against.select("episode", F.col("bears_on").alias("hypothesis"), "step", F.lit(0).alias("f"), F.col("change").alias("r"))
    each = events.select("episode", "step").join(events.select("episode", F.col("bears_on").alias("hypothesis")).distinct(), "episode")
    every = each.select("episode", "hypothesis", "step", F.lit(0).alias("f"), F.lit(0).alias("r"))
    total = families.unionByName(against).unionByName(every).groupBy("episode", "hypothesis", "step").agg(F.sum("f").alias("f"), F.sum("r").alias("r"))
    w = Window.partitionBy("episode", "hypothesis").orderBy("step")
    return total.select("episode", "hypothesis", "step", F.sum("f").over(w).alias("families"), (F.sum("r").over(w) > 0).alias("refuted"))


def response_latency(events: DataFrame, most: int) -> DataFrame:
    """(episode, step, latency) of decisive refutations: steps to the first downgrade at or after, null beyond ``most``."""
    ahead = Window.partitionBy("episode").orderBy("step").rowsBetween(0, Window.unboundedFollowing)
    late = F.min(F.when(F.col("downgrade"), F.col("step"))).over(ahead) - F.col("step")
    rows = events.withColumn("latency", F.when(late <= most, late))
    return rows.filter("decisive AND kind = 'refute'").select("episode", "step", "latency")
