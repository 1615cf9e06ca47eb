"""Threshold calibration: one histogram pass instead of a scan per threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolewise import fixed_values as V
from rolewise.functions.scores import f_beta


def threshold_curve(observations: DataFrame, beta: float = V.CALIBRATION_BETA,
                    steps: int = 100) -> DataFrame:
    """Confusion counts, precision, recall and F-beta at 0, 1/steps, ... 1.

    `observations` has (score, relevant). Scores fall into at most steps + 1
    buckets; reverse running sums over those give every threshold at once.
    """
    # The small constant keeps a score equal to a threshold on its upper side.
    bucket = F.least(F.lit(steps), F.floor(F.col("score") * steps + 1e-9)).cast("int")
    histogram = observations.groupBy(bucket.alias("step")).agg(
        F.count_if("relevant").alias("good"), F.count_if(~F.col("relevant")).alias("bad")
    )
    spark = observations.sparkSession
    grid = spark.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    full = grid.join(histogram, "step", "left").na.fill(0, ["good", "bad"])
    down = W.orderBy(F.desc("step"))
    everything = W.partitionBy()
    counted = full.select(
        "step", F.sum("good").over(down).alias("true_positive"),
        F.sum("bad").over(down).alias("false_positive"),
        F.sum("good").over(everything).alias("relevant"),
    )
    kept = F.col("true_positive") + F.col("false_positive")
    precision = F.coalesce(F.try_divide("true_positive", kept), F.lit(0.0))
    recall = F.coalesce(F.try_divide("true_positive", "relevant"), F.lit(0.0))
    return counted.select(
        (F.col("step") / steps).alias("threshold"), kept.alias("retained"),
        "true_positive", "false_positive",
        (F.col("relevant") - F.col("true_positive")).alias("false_negative"),
        precision.alias("precision"), recall.alias("recall"),
        F.round(f_beta(precision, recall, beta), 4).alias("f_beta"),
    )


def recommend(curve: DataFrame) -> DataFrame:
    """Plateau of the best F-beta and its point nearest the middle (101 rows in)."""
    best = curve.withColumn("top", F.max("f_beta").over(W.partitionBy())).where("f_beta = top")
    edges = best.withColumns({
        "plateau_low": F.min("threshold").over(W.partitionBy()),
        "plateau_high": F.max("threshold").over(W.partitionBy()),
    })
    away = F.round(
        F.abs(F.col("threshold") - (F.col("plateau_low") + F.col("plateau_high")) / 2), 6
    )
    picked = edges.withColumn(
        "pos", F.row_number().over(W.orderBy(away, F.col("threshold")))
    ).where("pos = 1")
    return picked.select(
        "threshold", "retained", "true_positive", "false_positive", "false_negative",
        "f_beta", "plateau_low", "plateau_high",
        ((F.col("false_negative") == 0) & (F.col("false_positive") == 0))
        .alias("perfectly_separable"),
    )


def sampled_curve(curve: DataFrame, every: int = 5) -> DataFrame:
    """Every n-th point for display, plus the recommended one."""
    chosen = recommend(curve).select("threshold", F.lit(True).alias("recommended"))
    marked = curve.join(chosen, "threshold", "left").na.fill(False, ["recommended"])
    step = F.round(F.col("threshold") * 100).cast("int")
    return marked.where((step % every == 0) | F.col("recommended"))
