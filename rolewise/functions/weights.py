"""Weight vectors as a struct with one double per criterion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolewise import fixed_values as V


def default_weights() -> Column:
    return F.struct(*[F.lit(w).alias(name) for name, w in V.DEFAULT_WEIGHTS.items()])


def from_map(overrides: Column) -> Column:
    """Defaults overlaid with a map of overrides, scaled to sum 1."""
    merged = {
        name: F.coalesce(F.try_element_at(overrides, F.lit(name)), F.lit(default))
        for name, default in V.DEFAULT_WEIGHTS.items()
    }
    total = sum(merged.values(), F.lit(0.0))
    return F.struct(*[(value / total).alias(name) for name, value in merged.items()])


def normalise(raw: Column) -> Column:
    """Clamp a map of raw weights, scale to 1 at 4 decimals, residue on the largest.

    The first of equally large weights takes the residue; all-zero input
    falls back to the defaults.
    """
    clamped = F.array(*[
        F.least(
            F.greatest(
                F.coalesce(F.try_element_at(raw, F.lit(name)), F.lit(default)),
                F.lit(V.WEIGHT_MIN),
            ),
            F.lit(V.WEIGHT_MAX),
        )
        for name, default in V.DEFAULT_WEIGHTS.items()
    ])
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda t, v: t + v)
    defaults = F.array(*[F.lit(w) for w in V.DEFAULT_WEIGHTS.values()])

    def scale(values: Column) -> Column:
        total = add(values)
        return F.when(
            total > 0, F.transform(values, lambda v: F.round(v / total, 4))
        ).otherwise(defaults)

    def settle(values: Column) -> Column:
        residue = F.round(1.0 - add(values), 4)
        heaviest = F.array_position(values, F.array_max(values)) - 1
        return F.transform(
            values,
            lambda v, i: F.when(i == heaviest, F.round(v + residue, 4)).otherwise(v),
        )

    # Each step is bound through a one-element array, so it is computed once.
    bound = F.transform(F.transform(F.array(clamped), scale), settle)
    fixed = F.element_at(bound, 1)
    return F.struct(*[
        F.element_at(fixed, i + 1).alias(name) for i, name in enumerate(V.CRITERIA)
    ])
