"""Coherence of dated histories: five checks, one list of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolewise import fixed_values as V
from rolewise.operators import intervals as I

COLUMNS = ("candidate_id", "code", "severity", "amount", "first_id", "second_id")


def _finding(df: DataFrame, code: str, severity: str, amount: Column,
             first: Column, second: Column) -> DataFrame:
    return df.select(
        "candidate_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"),
        amount.cast("double").alias("amount"), first.cast("long").alias("first_id"),
        second.cast("long").alias("second_id"),
    )


def impossible_dates(experiences: DataFrame, ref_date: str) -> DataFrame:
    """Ends before starts, and starts after the reference day."""
    own, nothing = F.col("experience_id"), F.lit(-1)
    inverted = experiences.where("end_date < start_date")
    future = experiences.where(F.col("start_date") > F.to_date(F.lit(ref_date)))
    return _finding(
        inverted, "inverted_dates", "attention", F.datediff("start_date", "end_date"), own, nothing
    ).unionByName(_finding(
        future, "future_start", "attention",
        F.datediff("start_date", F.to_date(F.lit(ref_date))), own, nothing))


def overlaps(experiences: DataFrame, ref_date: str,
             tolerance: int = V.OVERLAP_TOLERANCE_DAYS) -> DataFrame:
    """Pairs of periods of one candidate that overlap beyond the tolerance.

    The later start falls in exactly one month; the earlier period is listed
    under each month it covers. Joining on (candidate, month) meets each pair
    once, spreads a long history over its months, and never forms pairs of
    periods that lie apart.
    """
    closed = I.closed_periods(experiences, ref_date).select(
        "candidate_id", "experience_id", "start_date", "end_date")
    month = lambda d: F.year(d) * 12 + F.month(d)
    long_enough = closed.where(F.datediff("end_date", "start_date") > tolerance)
    earlier = long_enough.select(
        "candidate_id", F.col("experience_id").alias("a_id"), F.col("start_date").alias("a_start"),
        F.col("end_date").alias("a_end"),
        F.explode(F.sequence(
            month("start_date"), month(F.date_sub("end_date", tolerance + 1)))).alias("month"),
    )
    later = long_enough.select(
        "candidate_id", F.col("experience_id").alias("b_id"), F.col("start_date").alias("b_start"),
        F.col("end_date").alias("b_end"), month("start_date").alias("month"),
    )
    ordered = (F.col("a_start") < F.col("b_start")) | (
        (F.col("a_start") == F.col("b_start")) & (F.col("a_id") < F.col("b_id")))
    shared = F.datediff(F.least("a_end", "b_end"), F.col("b_start"))
    pairs = earlier.join(later, ["candidate_id", "month"]).where(ordered & (shared > tolerance))
    return _finding(pairs, "overlap", "attention", shared, F.col("a_id"), F.col("b_id"))


def late_diplomas(experiences: DataFrame, education: DataFrame) -> DataFrame:
    first = experiences.where("start_date IS NOT NULL").groupBy("candidate_id").agg(
        F.year(F.min("start_date")).alias("first_year"))
    gap = F.col("graduation_year") - F.col("first_year")
    late = education.where(F.col("graduation_year") >= V.DIPLOMA_MIN_YEAR).join(
        first, "candidate_id").where(gap >= V.DIPLOMA_GAP_YEARS)
    return _finding(late, "diploma_after_job", "information", gap, F.col("graduation_year"),
                    F.lit(-1))


def uncovered_tenure(experiences: DataFrame, candidates: DataFrame, ref_date: str) -> DataFrame:
    """Declared years far above the union of the dated periods."""
    covered = I.covered_years(I.closed_periods(experiences, ref_date))
    gap = F.col("declared_years") - F.col("covered_years")
    wide = candidates.select("candidate_id", "declared_years").join(
        covered, "candidate_id").where(gap > V.TENURE_GAP_YEARS)
    return _finding(wide, "tenure_not_covered", "information", gap, F.lit(-1), F.lit(-1))


def breaks(experiences: DataFrame, ref_date: str, days: int = V.BREAK_DAYS) -> DataFrame:
    """Long pauses between the running end and the next start."""
    starts = I.with_running_end(I.by_start_day(I.closed_periods(experiences, ref_date)))
    pause = F.datediff("start_date", "running_end")
    long = starts.where(pause > days)
    return _finding(long, "break", "information", pause, F.lit(-1), F.lit(-1))


def coherence(experiences: DataFrame, education: DataFrame, candidates: DataFrame,
              ref_date: str) -> DataFrame:
    """All findings. `candidates` has (candidate_id, declared_years)."""
    checks = (
        impossible_dates(experiences, ref_date),
        overlaps(experiences, ref_date),
        late_diplomas(experiences, education),
        uncovered_tenure(experiences, candidates, ref_date),
        breaks(experiences, ref_date),
    )
    return reduce(DataFrame.unionByName, checks)


def report_order(findings: DataFrame) -> DataFrame:
    """The findings numbered within their candidate: points that need attention first.

    Equal severities go by code, then by the periods concerned. A candidate has
    few findings next to all candidates, so a candidate is one window.
    """
    order = [F.col("severity") != "attention", "code", "first_id", "second_id"]
    place = F.row_number().over(W.partitionBy("candidate_id").orderBy(*order))
    return findings.withColumn("position", place)


def verifiability(experiences: DataFrame) -> DataFrame:
    """Dated share per candidate: no finding means little without dates."""
    dated, total = F.count("start_date"), F.count("*")
    return experiences.groupBy("candidate_id").agg(
        dated.alias("dated_periods"), total.alias("total_periods"),
        (dated >= 2).alias("verifiable"),
        F.coalesce(F.try_divide(dated, total), F.lit(0.0)).alias("coverage"),
    )
