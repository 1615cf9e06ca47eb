"""Retention: defaults, due and expiring records, the purge plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolewise import fixed_values as V


def with_default_retention(candidates: DataFrame, days: int = V.RETENTION_DAYS) -> DataFrame:
    """A missing date becomes creation + N days: a null would never come due."""
    return candidates.withColumn(
        "retention_until", F.coalesce("retention_until", F.date_add("created_at", days)))


def expired(candidates: DataFrame, ref_date: str) -> DataFrame:
    return candidates.where(F.col("retention_until") < F.to_date(F.lit(ref_date)))


def expiring_soon(candidates: DataFrame, ref_date: str,
                  days: int = V.RETENTION_WARNING_DAYS) -> DataFrame:
    start = F.to_date(F.lit(ref_date))
    return candidates.where(F.col("retention_until").between(start, F.date_add(start, days)))


def days_until_purge(ref_date: str) -> Column:
    return F.datediff("retention_until", F.to_date(F.lit(ref_date)))


def purge_plan(candidates: DataFrame, children: dict[str, DataFrame], ref_date: str) -> DataFrame:
    """Rows that would go, per table: the due candidates and their child rows.

    A plan only: nothing is written. The due ids are a projection of the
    candidate table, so each child is reduced by a semi join.
    """
    due = expired(candidates, ref_date).select("candidate_id")
    plan = due.agg(F.lit("candidates").alias("table"), F.count("*").alias("rows"))
    for name, child in children.items():
        gone = child.join(due, "candidate_id", "left_semi")
        plan = plan.unionByName(gone.agg(F.lit(name).alias("table"), F.count("*").alias("rows")))
    return plan


def survivors(table: DataFrame, candidates: DataFrame, ref_date: str) -> DataFrame:
    """What a purge leaves of a table."""
    return table.join(expired(candidates, ref_date), "candidate_id", "left_anti")


def purge_audit(candidates: DataFrame, ref_date: str) -> DataFrame:
    """One audit row per purged record: ids and dates, nothing personal."""
    return expired(candidates, ref_date).select(
        F.lit(V.AUDIT_ACTIONS_PURGE).alias("action"),
        F.col("candidate_id").cast("string").alias("object_id"),
        F.to_json(F.struct(F.date_format("retention_until", "yyyy-MM-dd").alias("retention_until")))
        .alias("metadata"),
    )
