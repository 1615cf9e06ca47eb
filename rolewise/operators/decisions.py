"""Human decisions: validity, overrides, history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolewise import fixed_values as V
from rolewise.functions.scores import effective_score
from rolewise.operators.ranking import latest, top_k


def validate_decisions(decisions: DataFrame, actors: DataFrame) -> DataFrame:
    """Accept or refuse each decision with the first reason that applies.

    `actors` has (actor, can_decide); an unknown actor cannot decide.
    """
    note = F.length(F.trim(F.coalesce("note", F.lit(""))))
    reason = (
        F.when(~F.col("stage").isin(*V.STAGE_ORDER), F.lit("unknown stage"))
        .when(F.col("stage").isin(*V.CLOSED_STAGES) & (note < V.DECISION_NOTE_MIN),
              F.lit("reason too short"))
        .when(~F.coalesce("can_decide", F.lit(False)), F.lit("actor cannot decide"))
    )
    judged = decisions.join(actors, "actor", "left").withColumn("refusal", reason)
    return judged.withColumn("accepted", F.col("refusal").isNull())


def apply_overrides(scores: DataFrame, overrides: DataFrame) -> DataFrame:
    """Latest override per application beside the computed score, which stays.

    `overrides` has (application_id, value, reason, created_at, override_id).
    """
    newest = latest(overrides, "application_id", "created_at", "override_id").select(
        "application_id", F.col("value").alias("overridden_score"), "reason")
    joined = scores.join(newest, "application_id", "left")
    return joined.withColumns({
        "previous": F.col("overall"),
        "effective": effective_score(F.col("overridden_score"), F.col("overall")),
    })


def decision_history(audit: DataFrame, top: int = 10) -> DataFrame:
    """Newest decisions per object."""
    return top_k(audit, ["object_id"], [F.desc("created_at"), F.desc("event_id")], top, "pos")
