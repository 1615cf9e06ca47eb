"""Scoring curves as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolewise import fixed_values as V


def level_order(code: Column) -> Column:
    """CEFR code -> 1..7, 0 when unknown."""
    chain = F.lit(0)
    for name, rank in V.LANGUAGE_LEVELS.items():
        chain = F.when(F.upper(code) == name, F.lit(rank)).otherwise(chain)
    return chain


def coverage(required_years: Column, held_years: Column) -> Column:
    """Seniority on one skill; unknown years are not zero years."""
    partial = V.COVERAGE_FLOOR + (1 - V.COVERAGE_FLOOR) * (held_years / required_years)
    return (
        F.when(required_years <= 0, F.lit(1.0))
        .when(held_years <= 0, F.lit(V.UNKNOWN_YEARS_COVERAGE))
        .when(held_years >= required_years, F.lit(1.0))
        .otherwise(partial)
    )


def freshness(last_used: Column, ref_year: int) -> Column:
    """Raw recency step of a skill in `ref_year`."""
    gap = F.lit(ref_year) - last_used
    chain = F.when(last_used.isNull(), F.lit(V.UNKNOWN_RECENCY))
    for limit, value in V.RECENCY_STEPS:
        chain = chain.when(gap <= limit, F.lit(value))
    return chain.otherwise(F.lit(V.RECENCY_OLD))


def recency(last_used: Column, ref_year: int) -> Column:
    """Recency rescaled to [.80, 1]: an old skill fades, it does not vanish."""
    return 0.80 + 0.20 * (freshness(last_used, ref_year) - V.RECENCY_OLD) / (1 - V.RECENCY_OLD)


def semantic_degree(cosine: Column) -> Column:
    """Cosine above the floor as a capped degree, 0 below it."""
    scaled = V.SEMANTIC_CEILING * (cosine - V.SEMANTIC_FLOOR) / (1 - V.SEMANTIC_FLOOR)
    return F.when(
        cosine > V.SEMANTIC_FLOOR, F.least(F.lit(V.SEMANTIC_CEILING), scaled)
    ).otherwise(F.lit(0.0))


def experience_value(years: Column, required: Column) -> Column:
    """Softened ratio; null when nothing is required, no cap penalty above it."""
    ratio = years / required
    return F.when(
        required > 0,
        F.when(ratio >= 1, F.lit(1.0)).otherwise(
            F.pow(F.greatest(F.lit(0.0), ratio), F.lit(V.EXPERIENCE_EXPONENT))
        ),
    )


def education_value(obtained: Column, required: Column) -> Column:
    return F.when(
        required > 0,
        F.when(obtained >= required, F.lit(1.0)).otherwise(
            F.greatest(F.lit(0.0), obtained / required)
        ),
    )


def language_value(actual: Column, needed: Column) -> Column:
    """One requirement: 25 % lost per missing level, 0 when not spoken."""
    return (
        F.when(actual <= 0, F.lit(0.0))
        .when(actual >= needed, F.lit(1.0))
        .otherwise(
            F.greatest(F.lit(0.0), 1.0 - V.LANGUAGE_STEP_PENALTY * (needed - actual))
        )
    )


def location_value(offer_tokens: Column, held_tokens: Column, policy: Column,
                   offer_place: Column, held_place: Column, blind: Column) -> Column:
    """Null (not applicable) when blind, remote or unknown."""
    known = (F.trim(F.coalesce(offer_place, F.lit(""))) != "") & (
        F.trim(F.coalesce(held_place, F.lit(""))) != ""
    )
    return F.when(
        ~blind & (policy != "remote") & known,
        F.when(F.arrays_overlap(offer_tokens, held_tokens), F.lit(1.0))
        .when(policy == "hybrid", F.lit(V.LOCATION_HYBRID))
        .otherwise(F.lit(V.LOCATION_ONSITE)),
    )


def admissibility(required_score: Column, required_count: Column) -> Column:
    """Ramp from .2 to 1 with the coverage of the required skills."""
    ramp = V.ADMISSIBILITY_FLOOR + (1 - V.ADMISSIBILITY_FLOOR) * (
        required_score / V.ADMISSIBILITY_FULL_AT
    )
    return F.when(required_count > 0, F.least(F.lit(1.0), ramp)).otherwise(F.lit(1.0))


def effective_score(overridden: Column, overall: Column) -> Column:
    return F.coalesce(overridden, overall)


def percent(score: Column) -> Column:
    return F.bround(score * 100, 0).cast("int")


def evidence_confidence(has_span: Column, verified: Column, ratio: Column) -> Column:
    held = F.when(F.coalesce(ratio, F.lit(0.0)) == 0.0, F.lit(1.0)).otherwise(ratio)
    return (
        F.when(~has_span, F.lit(0.4))
        .when(~verified, F.lit(0.3))
        .otherwise(F.bround(F.least(F.lit(1.0), held), 2))
    )


def kappa(observed: Column, share_a: Column, share_b: Column) -> Column:
    """Cohen's kappa from shares; defined at certainty, 0 on no data."""
    expected = share_a * share_b + (1 - share_a) * (1 - share_b)
    return (
        F.when(observed.isNull(), F.lit(0.0))
        .when(expected >= 1.0, F.when(observed >= 1.0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise((observed - expected) / (1 - expected))
    )


def kappa_label(value: Column) -> Column:
    chain = F.lit(V.KAPPA_LOWEST)
    for limit, label in reversed(V.KAPPA_STEPS):
        chain = F.when(value >= limit, F.lit(label)).otherwise(chain)
    return chain


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    weight = beta * beta
    return F.coalesce(
        F.try_divide((1 + weight) * precision * recall, weight * precision + recall), F.lit(0.0)
    )
