"""Mentions of entities against records by canonical name or alias."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions.scalar import entity_name, jaccard

#: Weights of name, type and context; what an alias and an open type count; least score and margin.
NAME, TYPE, CONTEXT, ALIAS, OPEN_TYPE, LEAST, MARGIN, SAME = 0.72, 0.18, 0.10, 0.98, 0.5, 0.65, 0.05, 1e-12


def candidates(mentions: DataFrame, records: DataFrame) -> DataFrame:
    """(mention_id, id, lexical, score) of mentions (mention_id, text, type, context) and records (id, name, type, aliases,
    context) that share a normalised name: an equi-join on names and exploded aliases."""
    name = lambda c, weight: F.struct(entity_name(c).alias("needle"), F.lit(weight).alias("w"))
    names = F.concat(F.array(name(F.col("name"), 1.0)), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: name(a, ALIAS)))
    known = records.select("id", F.col("type").alias("own_type"), F.col("context").alias("own_context"), F.inline(names))
    known = known.groupBy("id", "needle").agg(F.max("w").alias("lexical"), F.first("own_type").alias("own_type"), F.first("own_context").alias("own_context"))
    asked = mentions.select("mention_id", entity_name(F.col("text")).alias("needle"), "type", "context")
    kind = F.when(F.coalesce("type", F.lit("")) == "", OPEN_TYPE).when(F.col("type") == F.col("own_type"), 1.0).otherwise(0.0)
    score = NAME * F.col("lexical") + TYPE * kind + CONTEXT * jaccard(F.col("context"), F.col("own_context"))
    return asked.join(known, "needle").select("mention_id", "id", "lexical", F.round(score, 12).alias("score"))


def resolve(mentions: DataFrame, records: DataFrame, least: float = LEAST, margin: float = MARGIN) -> DataFrame:
    """(mention_id, resolved, ambiguous, score) of every mention: the best record, unless it scores too low or another one
    comes within the margin."""
    w = Window.partitionBy("mention_id").orderBy(F.desc("score"), "id")
    found = candidates(mentions, records).withColumns({"k": F.row_number().over(w), "second": F.lead("score").over(w)}).filter("k = 1")
    out = mentions.select("mention_id").join(found, "mention_id", "left")
    high = F.coalesce(F.col("score") >= least, F.lit(False))
    tied = high & F.coalesce(F.col("score") - F.col("second") <= margin, F.lit(False))
    return out.select("mention_id", F.when(high & ~tied, F.col("id")).alias("resolved"), tied.alias("ambiguous"), "score")
