"""Latest rows, ranks, cuts and top-k.

A full ranking of one very large group must not pass through one sort. Rows are
laid out in ranges of (group, score, id), so such a group fills several; a rank
is the place within the range plus what earlier ranges of the group hold. Ranks
that equal scores share come from row counts per score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolewise.functions.scores import effective_score
from rolewise.session import cut_lineage


def latest(history: DataFrame, key: str | list[str], time: str = "created_at",
           tie: str = "score_id") -> DataFrame:
    """Newest row per key: one partial aggregate, no sort of the history."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in history.columns if c not in keys]
    return (
        history.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("row"))
        .select(*keys, "row.*")
    )


def latest_scores(history: DataFrame) -> DataFrame:
    """Latest score per application with its effective value."""
    return latest(history, "application_id").withColumn(
        "effective", effective_score(F.col("overridden_score"), F.col("overall"))
    )


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int,
          name: str = "rank") -> DataFrame:
    """First k rows per group; the limit is applied before the shuffle too."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= k)


def running_totals(df: DataFrame, keys: list[str], score: str, tie: str,
                   values: dict[str, Column]) -> DataFrame:
    """Sums of `values` over the rows ahead of each row of its group.

    Order: `score` descending, then `tie` ascending, of any type. Rows are laid
    out in ranges of (keys, score, tie), so a large group fills several ranges;
    a row has ahead of it what its range holds before it and what the earlier
    ranges of its group hold, of which there is one sum per range. The ranges
    are written once, so that both sums see the same.
    """
    columns = {f"_v_{n}": c for n, c in values.items()}
    order = [F.desc(score), F.asc(tie)]
    ranged = cut_lineage(
        df.withColumns(columns).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()),
        "ranges")
    sums = ranged.groupBy(*keys, "_part").agg(*[F.sum(v).alias(v) for v in columns])
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, "_part", *[F.coalesce(F.sum(f"_v_{n}").over(earlier), F.lit(0)).alias(f"_e_{n}") for n in values])
    inside = W.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = ranged.join(offsets, [*keys, "_part"])
    for n in values:
        own = F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0))
        rows = rows.withColumn(n, F.col(f"_e_{n}") + own)
    return rows.drop("_part", *[f"{p}{n}" for n in values for p in ("_v_", "_e_")])


def row_numbers(df: DataFrame, keys: list[str], score: str, tie: str,
                name: str = "rank") -> DataFrame:
    """Exact row number per group, score descending then `tie` ascending."""
    ahead = running_totals(df, keys, score, tie, {name: F.lit(1)})
    return ahead.withColumn(name, F.col(name) + 1)


def standing(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Per (group, score): rows above it and rows at it."""
    levels = df.groupBy(*keys, score).agg(F.count("*").alias("at"))
    above = W.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, -1)
    return levels.withColumn("above", F.coalesce(F.sum("at").over(above), F.lit(0)))


def competition_ranks(df: DataFrame, keys: list[str], score: str,
                      name: str = "rank") -> DataFrame:
    """1 + rows with a higher score; equal scores share the best rank."""
    table = standing(df, keys, score).select(*keys, score, (F.col("above") + 1).alias(name))
    return df.join(table, [*keys, score])


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Fractional ranks, ascending: ties take the mean of their positions."""
    levels = df.groupBy(*keys, value).agg(F.count("*").alias("_at"))
    below = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ranks = levels.withColumn(
        name, F.coalesce(F.sum("_at").over(below), F.lit(0)) + (F.col("_at") + 1) / 2
    ).drop("_at")
    return df.join(ranks, [*keys, value])


def rank_offers(scores: DataFrame, top: int | None = None) -> DataFrame:
    """Applications ranked inside their offer; ties by candidate id."""
    if top is not None:
        return top_k(scores, ["offer_id"], [F.desc("overall"), F.asc("candidate_id")], top)
    return row_numbers(scores, ["offer_id"], "overall", "candidate_id")


def mark_cut(ranked: DataFrame, threshold: float) -> DataFrame:
    """Flag the first row below the threshold in every offer."""
    above = ranked.groupBy("offer_id").agg(
        F.count_if(F.col("overall") >= threshold).alias("kept")
    )
    return ranked.join(above, "offer_id").withColumn(
        "is_cut", F.col("rank") == F.col("kept") + 1
    )


def altered_ranks(altered: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Rank of one changed score among the unchanged others of its group.

    `altered` holds (keys, score, own) with `own` the row's baseline score;
    `baseline` holds (keys, score), or rows counted as `n`. The changed scores join the baseline's
    score levels as levels without rows, so one bounded window ranks them all.
    """
    levels = (
        baseline.select(*keys, "score", F.col("n") if "n" in baseline.columns else F.lit(1).alias("n"))
        .unionByName(altered.select(*keys, "score").distinct().withColumn("n", F.lit(0)))
        .groupBy(*keys, "score")
        .agg(F.sum("n").alias("n"))
    )
    above = W.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    counted = levels.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))).drop("n")
    joined = altered.join(counted, [*keys, "score"])
    return joined.withColumn(
        "rank", F.col("above") - (F.col("own") > F.col("score")).cast("int") + 1
    ).drop("above")


def fold_tail(counts: DataFrame, label: str, value: str, top: int,
              other: str = "others") -> DataFrame:
    """Keep the top - 1 largest categories, sum the rest into "N others".

    The head is a top-k; the tail is total minus head, so no global sort.
    """
    order = [F.desc(value), F.asc(label)]
    head = counts.orderBy(*order).limit(top).withColumn(
        "pos", F.row_number().over(W.orderBy(*order)).cast("long")
    )
    size = counts.agg(F.count("*")).scalar()
    total = counts.agg(F.sum(value)).scalar()
    kept = head.withColumn("n", size).where((F.col("n") <= top) | (F.col("pos") < top))
    tail = (
        head.where(F.col("pos") < top)
        .agg(F.sum(value).alias("h"))
        .select("h", size.alias("n"), total.alias("s"))
        .where(F.col("n") > top)
        .select(
            F.concat((F.col("n") - (top - 1)).cast("string"), F.lit(f" {other}")).alias(label),
            (F.col("s") - F.col("h")).cast("double").alias(value),
            F.lit(top).cast("long").alias("pos"),
        )
    )
    return kept.select(label, F.col(value).cast("double").alias(value), "pos").unionByName(tail)
