"""Calendar intervals: merge, tenure, running ends.

Intervals are day-grained, so a candidate is first reduced to one row per
distinct start day (keeping the latest end). The windows below then never see
more rows per candidate than there are days in the calendar, however many
periods one candidate has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolewise import fixed_values as V


def closed_periods(periods: DataFrame, ref_date: str) -> DataFrame:
    """Dated periods with an open end set to `ref_date`."""
    return periods.where("start_date IS NOT NULL").withColumn(
        "end_date", F.coalesce("end_date", F.to_date(F.lit(ref_date)))
    )


def by_start_day(periods: DataFrame) -> DataFrame:
    """Latest end per start day, and the (negative) days of inverted periods."""
    length = F.datediff("end_date", "start_date")
    return periods.groupBy("candidate_id", "start_date").agg(
        F.max("end_date").alias("end_date"),
        F.sum(F.least(F.lit(0), length)).alias("inverted_days"),
    )


def with_running_end(days: DataFrame) -> DataFrame:
    """Latest end among the earlier starts of the same candidate."""
    earlier = (
        W.partitionBy("candidate_id").orderBy("start_date")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    return days.withColumn("running_end", F.max("end_date").over(earlier))


def merge_intervals(days: DataFrame) -> DataFrame:
    """Islands of touching or overlapping periods."""
    opened = with_running_end(days).withColumn(
        "opens", (F.col("running_end").isNull() | (F.col("start_date") > F.col("running_end")))
        .cast("int"),
    )
    ordered = W.partitionBy("candidate_id").orderBy("start_date")
    return (
        opened.withColumn("island", F.sum("opens").over(ordered))
        .groupBy("candidate_id", "island")
        .agg(
            F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"),
            F.sum(F.when(F.col("opens") == 1, F.col("inverted_days"))).alias("inverted_days"),
        )
    )


def covered_years(periods: DataFrame) -> DataFrame:
    """Years covered by the union of the periods.

    A period that ends before it starts lies in no other one, so it counts
    with its negative length where it opens an island, and not at all inside
    one.
    """
    merged = merge_intervals(by_start_day(periods))
    length = F.greatest(F.lit(0), F.datediff("end_date", "start_date"))
    return merged.groupBy("candidate_id").agg(
        (F.sum(length + F.col("inverted_days")) / V.DAYS_PER_YEAR).alias("covered_years")
    )


def merged_tenure(periods: DataFrame, ref_date: str) -> DataFrame:
    """Total experience: overlaps count once, empty or inverted periods not at all."""
    valid = closed_periods(periods, ref_date).where("end_date > start_date")
    return covered_years(valid).withColumnRenamed("covered_years", "total_experience_years")
