"""Side-by-side comparison of the leading candidates of an offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolewise import fixed_values as V


def _mark(cells: DataFrame, keys: list[str], margin: float) -> DataFrame:
    row = W.partitionBy(*keys)
    best, worst = F.max("score").over(row), F.min("score").over(row)
    apart = best - worst > margin
    return cells.withColumns({
        "discriminating": apart,
        "best": apart & (best > 0) & (F.col("score") >= best - 1e-9),
    })


def compare_candidates(scored: DataFrame, margin: float = V.TIE_MARGIN) -> DataFrame:
    """Long matrix of skill and criterion cells for the compared applications.

    `scored` holds at most a few applications per offer (see `top_k`), so the
    windows are small by construction.
    """
    skills = scored.select(
        "offer_id", "candidate_id", F.explode("skill_matches").alias("m")
    ).select(
        "offer_id", "candidate_id", F.lit("skill").alias("kind"), F.col("m.required").alias("name"),
        F.col("m.requirement").alias("requirement"), F.col("m.score").alias("score"),
    )
    pairs = F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(n).alias("score")) for n in V.CRITERIA
    ])
    criteria = scored.select(
        "offer_id", "candidate_id", F.explode(pairs).alias("c")
    ).where("c.score IS NOT NULL").select(
        "offer_id", "candidate_id", F.lit("criterion").alias("kind"), F.col("c.name").alias("name"),
        F.lit("").alias("requirement"), F.col("c.score").alias("score"),
    )
    return _mark(skills.unionByName(criteria), ["offer_id", "kind", "name"], margin)


def row_order(cells: DataFrame) -> DataFrame:
    """Rows of the matrix: required first, discriminating first, then name."""
    order = W.partitionBy("offer_id").orderBy(
        F.col("requirement") != "required", ~F.col("discriminating"), F.col("name"))
    rows = cells.where("kind = 'skill'").select(
        "offer_id", "name", "requirement", "discriminating").distinct()
    return rows.withColumn("pos", F.row_number().over(order))


def strengths(cells: DataFrame) -> DataFrame:
    """Skills on which a candidate leads a discriminating row."""
    return cells.where("kind = 'skill' AND discriminating AND best").select(
        "offer_id", "candidate_id", "name")


def covered(score: Column) -> Column:
    return score >= V.GAP_THRESHOLD
