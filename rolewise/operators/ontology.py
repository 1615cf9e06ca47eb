"""Directed skill ontology: canonical names, closure and relatedness table."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolewise import fixed_values as V
from rolewise.functions.text import canonical_form
from rolewise.session import cut_lineage

#: Skills of a block whose vectors are compared with those of another.
SKILL_BLOCK = 2048


def canonical(name: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Canonical skill name. The alias list is configuration, hence a literal map."""
    form = canonical_form(name)
    if not aliases:
        return form
    pairs = [F.lit(part) for item in aliases.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), form), form)


def default_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The built-in ontology as (implies, related) tables."""
    implies = [(skill, to) for skill, many in V.SKILL_IMPLIES.items() for to in many]
    return (
        spark.createDataFrame(implies, "skill string, implied string"),
        spark.createDataFrame(list(V.SKILL_RELATED), "a string, b string, degree double"),
    )


def closure(implies: DataFrame) -> DataFrame:
    """(skill, implied) pairs reached through any chain of implications.

    Rounds over distinct pairs to the fixed point: pairs found in one round are
    continued by one edge in the next, and only new pairs go on. Cycles end by
    themselves, and no chain is too long.
    """
    edges = cut_lineage(implies.select("skill", "implied").where("skill <> implied").distinct(), "edges")
    onward = edges.select(F.col("skill").alias("implied"), F.col("implied").alias("next"))
    known = fresh = edges
    while True:
        further = fresh.join(onward, "implied").select("skill", F.col("next").alias("implied"))
        fresh = cut_lineage(further.where("skill <> implied").distinct().join(
            known, ["skill", "implied"], "left_anti"), "pairs")
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)


def build_relatedness(implies: DataFrame, related: DataFrame) -> DataFrame:
    """(required, held, degree, method) for every related pair of distinct skills.

    Held implies required, then held is a prerequisite of required, then
    declared neighbours; the first class that applies wins. Identity is not
    listed: it needs no table.
    """
    def pair(required: str, held: str, degree: Column, order: int) -> Column:
        return F.struct(
            F.col(required).alias("required"), F.col(held).alias("held"),
            degree.alias("degree"), F.lit(order).alias("order"),
        )

    implied = closure(implies).select(F.inline(F.array(
        pair("implied", "skill", F.lit(V.IMPLICATION_DEGREE), 1),
        pair("skill", "implied", F.lit(V.PREREQUISITE_DEGREE), 2),
    )))
    declared = related.select(F.inline(F.array(
        pair("a", "b", F.col("degree"), 3), pair("b", "a", F.col("degree"), 3),
    )))
    return (
        implied.unionByName(declared)
        .groupBy("required", "held")
        .agg(F.min_by("degree", "order").alias("degree"))
        .withColumn("method", F.lit("ontology"))
    )


def similar_skills(vectors: DataFrame, floor: float = V.SEMANTIC_FLOOR, block: int = SKILL_BLOCK) -> DataFrame:
    """(required, held, cosine) of all pairs of skills with a cosine above `floor`, both ways.

    `vectors` has (skill, embedding), one row a skill. Skills are dealt into blocks;
    a pair of blocks meets once, as one matrix product. Skills without a vector
    are similar to none.
    """
    from rolewise.operators.search import SCORE_GRID, unit

    held = vectors.where("size(embedding) > 0").select("skill", "embedding")
    blocks = max(1, -(-held.count() // block))
    placed = held.withColumn("own", F.pmod(F.xxhash64("skill"), F.lit(blocks)))
    left = placed.select("skill", "embedding", F.col("own").alias("a"), F.explode(
        F.sequence(F.col("own"), F.lit(blocks - 1).cast("long"))).alias("b"))
    right = placed.select("skill", "embedding", F.col("own").alias("b"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("own"))).alias("a"))

    def near(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"required": [], "held": [], "cosine": []})
        if one.empty or other.empty:
            return empty
        cosine = np.floor(unit(one["embedding"]) @ unit(other["embedding"]).T * SCORE_GRID + 0.5) / SCORE_GRID
        i, j = np.nonzero(cosine > floor)
        pairs = pd.DataFrame({"required": one["skill"].to_numpy()[i], "held": other["skill"].to_numpy()[j],
                              "cosine": np.minimum(cosine[i, j], 1.0)})
        if one["a"].iloc[0] != one["b"].iloc[0]:
            pairs = pd.concat([pairs, pairs.rename(columns={"required": "held", "held": "required"})])
        pairs = pairs[pairs["required"] != pairs["held"]]
        return pairs if len(pairs) else empty

    right = right.toDF(*right.columns)
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(
        near, "required string, held string, cosine double")


def with_semantic(relatedness: DataFrame, similarities: DataFrame) -> DataFrame:
    """Add (required, held, cosine) pairs: the capped cosine wins where larger."""
    from rolewise.functions.scores import semantic_degree

    semantic = similarities.select(
        "required", "held", semantic_degree(F.col("cosine")).alias("degree"),
        F.lit("semantic").alias("method"),
    ).where("degree > 0 AND required <> held")
    return (
        relatedness.unionByName(semantic)
        .groupBy("required", "held")
        .agg(F.min(F.struct((-F.col("degree")).alias("d"), "method")).alias("best"))
        .select("required", "held", (-F.col("best.d")).alias("degree"), "best.method")
    )
