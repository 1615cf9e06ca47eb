"""Readers and sinks: scans, evaluation sets, append-only tables, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolewise import fixed_values as V

EVALUATION_KINDS = ("ranking", "search", "extraction")


def scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    frame = spark.read.parquet(path)
    return frame.select(*columns) if columns else frame


def evaluation_cases(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Cases of an annotated JSON set of the given kind, one row each.

    `schema` is the DDL of one case, so nothing is inferred. A set of another
    kind yields an error when it is read, not an empty result.
    """
    if kind not in EVALUATION_KINDS:
        raise ValueError(f"unknown evaluation kind {kind}")
    document = f"name STRING, kind STRING, version STRING, cases ARRAY<STRUCT<{schema}>>"
    sets = spark.read.schema(document).json(path, multiLine=True)
    # A filter on rows, so the check stays when `kind` itself is not read.
    wrong = F.raise_error(F.concat(F.lit(f"expected a {kind} set, found "), F.coalesce("kind", F.lit("none"))))
    checked = sets.where(F.when(F.col("kind") == kind, F.lit(True)).otherwise(wrong.cast("boolean")))
    return checked.select(
        "name", "kind", "version", F.posexplode("cases").alias("position", "case")
    ).select("name", "kind", "version", "position", "case.*")


def audit_rows(events: DataFrame, action: Column, actor: Column, object_type: str,
               object_id: Column, summary: Column, metadata: list[str]) -> DataFrame:
    """Rows of the append-only audit table with free-form metadata as JSON."""
    return events.select(
        F.col("created_at"), action.alias("action"), actor.cast("string").alias("actor"),
        F.lit(object_type).alias("object_type"), object_id.cast("string").alias("object_id"),
        summary.alias("summary"), F.to_json(F.struct(*metadata)).alias("metadata"),
    )


def append_audit(rows: DataFrame, path: str) -> None:
    """Append only; nothing here rewrites the audit table."""
    rows.write.mode("append").partitionBy("action").parquet(path)


def append_scores(scores: DataFrame, path: str, computed_at: Column) -> None:
    """Add a run to the score history, stamped with engine and time."""
    scores.withColumn("computed_at", computed_at).withColumn(
        "engine_version", F.lit(V.ENGINE_VERSION)).write.mode("append").parquet(path)


def write_report(aggregate: DataFrame, cases: DataFrame, path: str) -> None:
    """Report as JSON lines: the aggregate and one object per case."""
    aggregate.write.mode("overwrite").json(f"{path}/aggregate")
    cases.write.mode("overwrite").json(f"{path}/cases")
