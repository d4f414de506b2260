"""Paths as evidence for targets: which count, which are one piece of evidence, how stable a bundle is, what it decides.

A bundle is all paths of one ``anchor``; a target is the ``root`` a path ends at. Every step works on many bundles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import governance as G
from evigraph.functions.scalar import clamp
from evigraph.operators import fibers
from evigraph.shared import materialize

#: Least share of each quality, contradiction that blocks, noise that is let through.
LEAST_RELEVANCE = LEAST_CONSISTENCY = LEAST_COMPLETENESS = 0.5
LEAST_PROVENANCE, MATERIAL, MOST_NOISE = 0.25, 0.15, 0.40
#: Scores of a stable state, of one that needs other evidence and of one that must not answer.
STABLE, ESCAPE, ABSTAIN, ESCAPE_ENERGY, ABSTAIN_ENERGY, EQUILIBRIUM = 0.62, 0.48, 0.25, 0.25, 0.70, 0.08
#: How near two scores are one; least confidence of an answer; opposition that asks for a wider search.
ABSOLUTE, RELATIVE, CONFIDENCE, REOPEN = 1e-9, 1e-6, 0.45, 0.25

BUNDLE, TARGET = ["anchor"], ["anchor", "root"]


def lineage() -> list[Column]:
    """Names of a path's sources, families and derivations, each kind with its own first letter."""

    def tagged(c: str) -> Column:
        mark = F.lit(c[0])
        return F.transform(c, lambda x: F.concat(mark, x))

    return [tagged(c) for c in ("sources", "families", "derivations")]


def sorted_set(c: str) -> Column:
    return F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))


def weigh(paths: DataFrame, steps: DataFrame) -> DataFrame:
    """Paths (path, anchor, root, edges, score, relevance, consistency, contra) with what their steps (path, source_id,
    family, derivation, lifecycle, timely, lost, faults) say of them: kind, coverage, provenance, completeness, whether
    they count for or against the target, and their quality."""
    seen = steps.groupBy("path").agg(
        F.count("*").alias("n"),
        F.count_if("lost").alias("lost"),
        F.sum("faults").alias("faults"),
        F.bool_and(F.col("lifecycle") == "active").alias("operative"),
        F.bool_and("timely").alias("timely"),
        sorted_set("source_id").alias("sources"),
        sorted_set("family").alias("families"),
        sorted_set("derivation").alias("derivations"),
        sorted_set("lifecycle").alias("states"),
    )
    c = F.col
    coverage = clamp(1 - c("lost") / c("n"))
    kind = F.when((c("relevance") < LEAST_RELEVANCE) | (c("consistency") < LEAST_CONSISTENCY), "noise").when(c("contra"), "opposition").otherwise("support")
    rows = paths.join(seen, "path").withColumns({"coverage": coverage, "kind": kind})
    rows = rows.withColumns({"provenance": F.least(clamp(1 - c("faults") / c("n")), c("coverage")), "completeness": F.when(c("timely"), c("coverage")).otherwise(0.0)})
    whole = c("timely") & (c("lost") == 0) & c("operative") & (c("provenance") > 0)
    return rows.withColumns(
        {
            "for_it": (c("kind") == "support") & whole & (c("completeness") >= LEAST_COMPLETENESS),
            "against": (c("kind") == "opposition") & whole,
            "quality": F.round(clamp(c("score") * c("relevance") * c("consistency") * c("completeness") * c("provenance")), 9),
        }
    )


def dedupe(rows: DataFrame) -> DataFrame:
    """Rows of one route, kind, families and states as one, with the least of every quality and every list's union."""
    least = ["score", "relevance", "consistency", "completeness", "provenance", "coverage", "quality"]
    union = ["sources", "derivations"]
    return rows.groupBy("anchor", "root", "path", "kind", "families", "states").agg(
        F.count("*").alias("copies"),
        *[F.min(c).alias(c) for c in least],
        *[F.bool_and(c).alias(c) for c in ("timely", "operative", "for_it", "against")],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in union],
    )


def representatives(rows: DataFrame) -> DataFrame:
    """The best path of each group of correlated ones (those that share a source, family or derivation within a kind)."""
    rows = rows.filter("kind <> 'noise'")
    named = lineage()
    own = F.array(F.concat(F.lit("p"), "path"))  # a path without any lineage stays alone
    tokens = rows.select("path", F.struct("anchor", "root", "kind").alias("scope"), F.explode(F.array_distinct(F.concat(*named, own))).alias("token"))
    grouped = rows.join(fibers.path_components(materialize(tokens)), "path")
    best = F.min_by(F.struct("path", "edges", "families", "score", "relevance", "consistency", "completeness", "provenance", "timely", "for_it", "against", "quality"), F.struct(~(F.col("for_it") | F.col("against")), -F.col("quality"), "path"))
    heads = grouped.groupBy(*TARGET, "kind", "component").agg(F.count("*").alias("paths"), F.bool_or(F.size("families") > 0).alias("sourced"), best.alias("x"))
    return heads.select(*TARGET, "kind", "component", "paths", "x.*", (F.col("x.for_it") & F.col("sourced")).alias("independent"))


def counts(rows: DataFrame) -> DataFrame:
    """(anchor, root, routes, relevant, noise, invalid, noise_ratio, invalid_ratio)."""
    own = F.col("kind") != "noise"
    out = rows.groupBy(*TARGET).agg(F.count("*").alias("routes"), F.count_if(own).alias("relevant"), F.count_if(~own).alias("noise"), F.count_if(own & ~F.col("for_it") & ~F.col("against")).alias("invalid"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.withColumns({"noise_ratio": share("noise", "routes"), "invalid_ratio": share("invalid", "relevant")})


def route_diversity(heads: DataFrame) -> DataFrame:
    """(anchor, root, diversity): mean share of edges that two independent representatives don't have in common.

    Pairs arise within a target only, whose paths a request bounds.
    """
    own = heads.filter("independent").select(*TARGET, "path", "edges")
    pairs = own.join(own.select(*TARGET, F.col("path").alias("other"), F.col("edges").alias("others")), TARGET).filter("path < other")
    apart = 1 - F.size(F.array_intersect("edges", "others")) / F.size(F.array_union("edges", "others"))
    return pairs.groupBy(*TARGET).agg(F.round(F.avg(apart), 9).alias("diversity"))


def union_strength(test: Column) -> Column:
    """One minus what all qualities leave open, folded in sorted order."""
    left = F.aggregate(F.array_sort(F.collect_list(F.when(test, F.col("quality")))), F.lit(1.0), lambda s, x: s * (1 - x))
    return F.round(1 - left, 9)


def targets(heads: DataFrame) -> DataFrame:
    """(anchor, root, families, supports, oppositions, support, opposition, belief, best, mass) of all targets met."""
    out = heads.groupBy(*TARGET).agg(
        F.count_if("independent").alias("families"),
        F.count_if("for_it").alias("supports"),
        F.count_if("against").alias("oppositions"),
        union_strength(F.col("independent")).alias("support"),
        union_strength(F.col("against")).alias("opposition"),
        F.coalesce(F.max(F.when(F.col("independent"), F.col("quality"))), F.lit(0.0)).alias("best"),
        F.coalesce(F.max(F.when(F.col("against"), F.col("quality"))), F.lit(0.0)).alias("mass"),
    )
    return out.withColumn("belief", F.round(clamp(F.col("support") * (1 - F.col("opposition"))), 9))


def scores(rows: DataFrame, heads: DataFrame, truncated: DataFrame) -> DataFrame:
    """One row a bundle with the coordinates of the critic; ``truncated`` (anchor, truncated) marks cut expansions."""
    own = heads.filter("for_it")
    total = F.sum("score")
    spread = F.when(F.count("*") > 1, (F.log(total) - F.sum(F.col("score") * F.log("score")) / total) / F.log(F.count("*").cast("double"))).otherwise(0.0)
    means = own.groupBy(*BUNDLE).agg(
        F.count("*").alias("n"),
        F.avg(F.col("timely").cast("double")).alias("temporal"),
        *[F.round(F.avg(c), 9).alias(c) for c in ("provenance", "relevance", "consistency", "completeness")],
        F.avg((F.size("families") == 0).cast("double")).alias("unsourced"),
        F.round(F.max("score") / total, 9).alias("top"),
        F.round(clamp(spread), 9).alias("spread"),
    )
    each = counts(rows).join(targets(heads), TARGET, "left").join(route_diversity(heads), TARGET, "left").fillna(0, ["families", "supports", "oppositions", "mass", "diversity"])
    has = F.col("supports") > 0
    whole = each.groupBy(*BUNDLE).agg(
        F.count("*").alias("targets"),
        F.max(1 - F.exp(-fibers.RATE * F.col("families"))).alias("support"),
        F.avg(F.when(has, F.col("diversity"))).alias("diversity"),
        F.avg(F.when(has, F.col("oppositions") / (F.col("supports") + F.col("oppositions")))).alias("contradiction"),
        F.max("mass").alias("material"),
        (F.sum("noise") / F.sum("routes")).alias("noise"),
    )
    out = whole.join(means, BUNDLE, "left").join(truncated, BUNDLE, "left")
    c, have = F.col, F.col("n").isNotNull()
    missing = F.when(have, clamp(c("unsourced") + (1 - c("completeness")) + F.when(c("truncated"), 0.20).otherwise(0.0))).otherwise(1.0)
    group = c("support") / F.greatest(F.lit(0.5), c("support") + 0.5)
    lock = F.when(have, clamp(0.45 * c("top") + 0.35 * (1 - c("spread")) + 0.20 * (1 - clamp(group)))).otherwise(0.0)
    zero = lambda x: F.when(have, F.round(F.coalesce(x, F.lit(0.0)), 9)).otherwise(0.0)
    names = ("temporal", "diversity", "support", "provenance", "contradiction", "relevance", "consistency", "completeness")
    return out.select("anchor", "targets", F.coalesce("n", F.lit(0)).alias("n"), *[zero(c(x)).alias(x) for x in names], F.round("material", 9).alias("material"), F.round("noise", 9).alias("noise"), F.round(missing, 9).alias("missing"), F.round(lock, 9).alias("pattern_lock"))


def assess(rows: DataFrame, mode: str) -> DataFrame:
    """scores() with total, energy and what they call for."""
    c = F.col
    plus, minus = G.stability_weights(mode)
    share = lambda w: sum(v * c(k) for k, v in w.items()) / sum(w.values())
    have = c("n") > 0
    energy = G.energy(G.errors(mode), G.energy_weights(mode))
    rows = rows.withColumns({"total": F.when(have, F.round(clamp(0.72 * share(plus) + 0.28 * (1 - share(minus))), 9)).otherwise(0.0), "energy": F.when(have, F.round(energy, 9)).otherwise(1.0)})
    blocks = c("material") >= MATERIAL
    sound = have & (c("relevance") >= LEAST_RELEVANCE) & (c("consistency") >= LEAST_CONSISTENCY) & (c("completeness") >= LEAST_COMPLETENESS) & (c("provenance") >= LEAST_PROVENANCE) & (c("noise") <= MOST_NOISE) & ~blocks
    rows = rows.withColumns({"blocks": have & blocks, "admissible": sound, "goal": have & (c("energy") <= EQUILIBRIUM)})
    return rows.withColumns(
        {
            "stable": c("admissible") & (c("total") >= STABLE) & c("goal"),
            "escape": ~c("admissible") | (c("total") < ESCAPE) | (c("energy") > ESCAPE_ENERGY) | (c("pattern_lock") > 0.70) | (c("missing") > 0.25) | (c("noise") > 0.10),
            "oppose": have & ((c("material") >= MATERIAL) | (c("contradiction") > 0) | (c("pattern_lock") > 0.55) | (c("targets") > 1)),
            "abstain": (c("total") < ABSTAIN) | (c("energy") > ABSTAIN_ENERGY) | (c("provenance") < 0.25) | (c("temporal") < 0.25) | (c("relevance") < 0.25) | (c("consistency") < 0.25),
        }
    )


def near(a: Column, b: Column) -> Column:
    """Whether two scores differ by no more than rounding."""
    return F.abs(a - b) <= F.greatest(F.lit(ABSOLUTE), RELATIVE * F.greatest(F.abs(a), F.abs(b)))


def select_target(found: DataFrame) -> DataFrame:
    """(anchor, selected, tie) from targets() with ``verified`` (a rank), over targets that some evidence supports.

    The target believed most is taken, unless it ties with the next. Where another has more support (before opposition),
    the first must have two independent families; else the other stays, or none if it is materially opposed.
    """
    found = found.filter("supports > 0 AND families > 0")
    order = [F.desc("belief"), F.desc("verified"), F.desc("families"), F.desc("best"), F.asc("root")]
    own = Window.partitionBy(*BUNDLE)
    found = found.withColumns({"place": F.row_number().over(own.orderBy(*order)), "most": F.max("support").over(own)})
    held = F.struct("root", "belief", "support", "opposition", "verified", "families", "best")
    per = found.groupBy(*BUNDLE).agg(
        F.min_by(held, "place").alias("a"),
        F.max(F.when(F.col("place") == 2, held)).alias("b"),
        F.min_by(held, F.struct(-F.col("support"), "place")).alias("s"),
        F.count_if(near(F.col("support"), F.col("most"))).alias("level"),
    )
    a, b, s = (lambda k, x=x: F.col(f"{x}.{k}") for x in "abs")
    tie = F.col("b").isNotNull() & near(a("belief"), b("belief")) & near(a("support"), b("support")) & near(a("opposition"), b("opposition")) & near(a("best"), b("best")) & (a("verified") == b("verified")) & (a("families") == b("families"))
    keep = (a("root") == s("root")) | (F.col("level") > 1) | (a("families") >= 2)
    chosen = F.when(tie, F.lit(None)).when(keep, a("root")).when(s("opposition") >= MATERIAL, F.lit(None)).otherwise(s("root"))
    return per.select("anchor", chosen.alias("selected"), F.coalesce(tie, F.lit(False)).alias("tie"))


def admissibility(rows: DataFrame, heads: DataFrame, found: DataFrame) -> DataFrame:
    """What the chosen target's own evidence allows: one row a bundle that has paths.

    Contradiction is that of the target; without one, that of materially opposed ones; and a target with fewer than two
    families also carries that of better supported targets it displaces.
    """
    chosen = rows.select("anchor").distinct().join(select_target(found), BUNDLE, "left")
    own = heads.filter("independent").join(chosen.select("anchor", F.col("selected").alias("root")), TARGET)
    means = own.groupBy(*BUNDLE).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 9).alias(c) for c in ("relevance", "consistency", "completeness", "provenance")])
    mine = found.select("anchor", F.col("root").alias("selected"), "support", "opposition", "belief", "families", "mass", "verified")
    out = chosen.join(mine, ["anchor", "selected"], "left").join(means, BUNDLE, "left").join(counts(rows).select("anchor", F.col("root").alias("selected"), F.col("noise_ratio").alias("noise")), ["anchor", "selected"], "left")
    rivals = found.filter((F.col("opposition") >= MATERIAL) & (F.col("families") > 0)).select("anchor", F.col("root").alias("rival"), F.col("support").alias("rival_support"), F.col("opposition").alias("rival_opposition"))
    weighed = out.select("anchor", "selected", "support", "families").join(rivals, BUNDLE)
    pressing = F.col("selected").isNull() | ((F.col("families") < 2) & (F.col("rival") != F.col("selected")) & (F.col("rival_support") > F.col("support")))
    pressed = weighed.filter(pressing).groupBy(*BUNDLE).agg(F.max("rival_opposition").alias("pressed"))
    c = F.col
    out = out.join(pressed, BUNDLE, "left").fillna(0, ["support", "opposition", "belief", "families", "mass", "n", "relevance", "consistency", "completeness", "provenance", "noise", "pressed"])
    out = out.withColumns({"unresolved": F.greatest("mass", "pressed"), "tie": F.coalesce("tie", F.lit(False)), "verified": F.coalesce("verified", F.lit(1))})
    out = out.withColumns({"blocks": c("unresolved") >= MATERIAL, "sufficient": c("families") >= 2})
    sound = (c("n") > 0) & (c("relevance") >= LEAST_RELEVANCE) & (c("consistency") >= LEAST_CONSISTENCY) & (c("completeness") >= LEAST_COMPLETENESS) & (c("provenance") >= LEAST_PROVENANCE) & (c("noise") <= MOST_NOISE) & ~c("blocks")
    return out.withColumns({"admissible": sound, "has_answer": c("selected").isNotNull() & (c("support") >= max(0.05, CONFIDENCE / 2))})


def opposition(heads: DataFrame, allowed: DataFrame) -> DataFrame:
    """(anchor, score, selected_score, challenged, challenge, corroborate, reopen) of every bundle in ``allowed``."""
    against = heads.filter("against").join(allowed.select("anchor", "selected", "has_answer"), BUNDLE)
    mine = F.col("has_answer") & (F.col("root") == F.col("selected"))
    by = against.groupBy(*BUNDLE).agg(F.max("quality").alias("strongest"), F.max(F.when(mine, F.col("quality"))).alias("mine"), F.array_sort(F.collect_set("root")).alias("challenged"))
    out = allowed.select("anchor", "has_answer", "unresolved", "sufficient").join(by, BUNDLE, "left")
    none = F.array().cast("array<bigint>")
    score = F.greatest(F.coalesce("strongest", F.lit(0.0)), "unresolved")
    out = out.withColumns({"score": score, "selected_score": F.when(F.col("has_answer"), F.greatest(F.coalesce("mine", F.lit(0.0)), "unresolved")).otherwise(0.0), "challenged": F.coalesce("challenged", none)})
    met = F.size("challenged") > 0
    seeds = F.array_sort(F.array_union("challenged", F.array("anchor")))
    return out.select("anchor", "score", "selected_score", "challenged", (met & (F.col("score") >= REOPEN)).alias("challenge"), (F.col("has_answer") & ~F.col("sufficient")).alias("corroborate"), F.when(met, seeds).otherwise(none).alias("reopen"))
