"""Error energy, corrective plans and the governed status as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evigraph.functions.scalar import clamp

#: Weights of the error coordinates.
ENERGY_WEIGHTS = {
    "temporal": 0.12,
    "diversity": 0.06,
    "degeneracy": 0.08,
    "provenance": 0.12,
    "contradiction": 0.16,
    "pattern_lock": 0.08,
    "missing_evidence": 0.08,
    "relevance": 0.08,
    "target_consistency": 0.06,
    "completeness": 0.08,
    "retrieval_noise": 0.08,
}


def lower_deficit(actual: Column, target: float) -> Column:
    return clamp((target - actual) / target)


def upper_excess(actual: Column, most: float) -> Column:
    return F.when(actual <= most, 0.0).otherwise(clamp((actual - most) / (1 - most)))


#: Weights of the stability score, those that add and those that take away.
PLUS = {"temporal": 0.14, "diversity": 0.08, "support": 0.10, "provenance": 0.14, "relevance": 0.08, "consistency": 0.06, "completeness": 0.08}
MINUS = {"material": 0.16, "pattern_lock": 0.08, "missing": 0.08, "noise": 0.08}
#: What each mode adds to weights.
EXTRA = {
    "empirical": {"provenance": 0.06, "temporal": 0.04, "contradiction": 0.06, "completeness": 0.04},
    "theoretical": {"diversity": 0.04, "relevance": 0.03},
}
#: Least and most of each coordinate without an error, by mode where it differs.
LEAST = {"temporal": 0.90, "diversity": 0.25, "degeneracy": 0.50, "provenance": 0.75, "relevance": 0.60, "target_consistency": 0.60, "completeness": 0.75}
MOST = {"contradiction": 0.15, "pattern_lock": 0.55, "missing_evidence": 0.10, "retrieval_noise": 0.10}
BY_MODE = {
    "empirical": {"temporal": 0.95, "provenance": 0.85, "completeness": 0.85, "relevance": 0.70, "target_consistency": 0.70, "contradiction": 0.10, "missing_evidence": 0.05, "retrieval_noise": 0.05},
    "theoretical": {"diversity": 0.35, "degeneracy": 0.50, "provenance": 0.60},
}
#: Columns of an assessment that hold the coordinates under another name.
HELD = {"degeneracy": "support", "target_consistency": "consistency", "missing_evidence": "missing", "retrieval_noise": "noise"}


def energy_weights(mode: str) -> dict[str, float]:
    return {k: w + EXTRA.get(mode, {}).get(k, 0.0) for k, w in ENERGY_WEIGHTS.items()}


def stability_weights(mode: str) -> tuple[dict[str, float], dict[str, float]]:
    extra = EXTRA.get(mode, {})
    minus = {k: w + extra.get("contradiction" if k == "material" else k, 0.0) for k, w in MINUS.items()}
    return {k: w + extra.get(k, 0.0) for k, w in PLUS.items()}, minus


def errors(mode: str) -> dict[str, Column]:
    """Error of each coordinate of an assessment row against the mode's targets."""
    own = BY_MODE.get(mode, {})
    col = lambda k: F.col(HELD.get(k, k))
    out = {k: lower_deficit(col(k), own.get(k, v)) for k, v in LEAST.items()}
    met = F.when(F.col("material") > 0, F.col("material")).otherwise(F.col("contradiction"))
    return out | {k: upper_excess(met if k == "contradiction" else col(k), own.get(k, v)) for k, v in MOST.items()}


def energy(errors: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of squared errors; contradiction, noise and irrelevance set floors that nothing else lowers."""
    weights = weights or ENERGY_WEIGHTS
    mean = sum(w * errors[k] * errors[k] for k, w in weights.items()) / sum(weights.values())
    floors = [
        F.when(errors["contradiction"] > 0, 0.35 + 0.60 * errors["contradiction"]),
        F.when(errors["retrieval_noise"] > 0, 0.15 + 0.35 * errors["retrieval_noise"]),
        F.when((errors["relevance"] > 0.5) | (errors["target_consistency"] > 0.5), 0.45),
    ]
    return clamp(F.greatest(mean, *floors))


def listed(rules: list[tuple[Column, str]]) -> Column:
    """Names of the rules that hold, in order."""
    return F.concat_ws(",", *[F.when(test, name) for test, name in rules])


def escape_plan() -> Column:
    """Corrective tasks an assessment row calls for; empty: general widening is allowed."""
    c = F.col
    return listed(
        [
            (c("noise") > 0, "prune_retrieval_noise"),
            (c("material") > 0, "search_contradiction"),
            (c("material") > 0, "generate_falsification_question"),
            ((c("completeness") < 0.75) | (c("missing") > 0), "generate_missing_evidence_query"),
            (c("support") < 0.75, "seek_independent_evidence"),
            (c("temporal") < 1, "search_temporal_neighbour"),
            ((c("pattern_lock") > 0.55) & (c("noise") == 0), "expand_minority_path"),
            (c("verify"), "verify_semantic_claim"),
            (c("theoretical") & (c("diversity") < 0.5), "explore_analogy"),
            (c("abstain") | (c("energy") > 0.7), "request_human_evidence"),
        ]
    )


def repair_plan() -> Column:
    """Safe repairs an assessment row calls for."""
    c = F.col
    return listed(
        [
            ((c("pattern_lock") > 0.55) | (c("diversity") < 0.25), "preserve_minority_path"),
            ((c("missing") > 0) | (c("provenance") < 0.75) | (c("completeness") < 0.75), "request_source_evidence"),
            ((c("material") > 0) | (c("contradiction") > 0) | (c("opposition") >= 0.5), "mark_contested"),
            (c("temporal") < 1, "search_temporal_window"),
            (c("questioned") | ~c("goal_reached"), "generate_independent_test"),
            (c("noise") > 0, "prune_retrieval_noise"),
            (c("verify"), "verify_semantic_claim"),
            (c("abstain"), "stop_and_abstain"),
        ]
    )


def governed_status() -> Column:
    """status:cause, the first case that holds."""
    c = F.col
    unanswered = (
        F.when(c("blocks"), "contested:material_contradiction_without_earned_replacement")
        .when(c("tie"), "open:unresolved_semantic_tie")
        .when(c("missing") > 0, "evidence_required:no_answer_missing_evidence")
        .otherwise("abstain:no_answer_abstain")
    )
    thin = (c("completeness") < 0.5) | (c("provenance") < 0.25)
    return (
        F.when(~c("has_answer"), unanswered)
        .when(c("verification") == "contradicted", "contested:semantic_verification_contradicted")
        .when(c("blocks"), "contested:material_contradiction_blocks_resolution")
        .when(c("opposition") >= 0.5, "contested:dialectic_opposition_blocks_resolution")
        .when(~c("admissible") & thin, "evidence_required:evidence_incomplete_or_low_provenance")
        .when(~c("admissible"), "abstain:evidence_not_admissible")
        .when(c("theoretical") & (c("verification") == "unverified"), "speculative:theoretical_claim_unverified")
        .when(c("stable") & c("sufficient") & (c("verification") == "verified") & (c("opposition") == 0), "resolved:earned_resolution")
        .otherwise("provisionally_resolved:resolution_conditions_not_fully_earned")
    )
