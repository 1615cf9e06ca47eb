"""Structured Streaming forms of the time-driven jobs.

Files may arrive in any number and any order, over any number of restarts. What a
job has to remember is keyed state of the stream, kept by Spark beside the
checkpoint: the earliest arrival of a content, the readings of a dimension. A
batch reads its own rows and the state of their keys, never what earlier batches
have written. It writes the rows it changes into a folder of its own, so a
replayed batch overwrites itself; the current table is merged from these.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rolewise import fixed_values as V
from rolewise.operators import scoring as SC
from rolewise.operators.bias import alert_level
from rolewise.session import work_path


def event_stream(spark: SparkSession, folder: str, name: str, schema, files: int = 1000) -> DataFrame:
    """Files of one table in a folder as a stream, at most `files` of them in a batch."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
        .option("maxFilesPerTrigger", files).parquet(folder)
    )


def drain(stream: DataFrame, name: str, transform: Callable[[DataFrame], DataFrame] | None = None,
          mode: str = "append", out: str | None = None) -> DataFrame:
    """Run to the end of the available input; rows carry their `batch_id`.

    `mode` is that of the stream: "update" for one with keyed state. With the `out`
    of an earlier run it goes on where that ended.
    """
    spark = stream.sparkSession
    out = out or work_path(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")

    running = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def daily_volume(calls: DataFrame) -> DataFrame:
    """What one batch adds to calls, failures and tokens per day."""
    return calls.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("calls"), F.count_if(F.col("status") != "ok").alias("failures"),
        F.sum("prompt_tokens").alias("tokens_in"), F.sum("completion_tokens").alias("tokens_out"))


def merged_volume(rows: DataFrame) -> DataFrame:
    """Volume per day from the parts of all batches."""
    sums = ("calls", "failures", "tokens_in", "tokens_out")
    return rows.groupBy("day").agg(*[F.sum(c).alias(c) for c in sums])


def first_contents(documents: DataFrame) -> DataFrame:
    """Earliest arrival of each content hash: on a stream, as state of the hash; on what it wrote, merged."""
    return documents.groupBy("content_hash").agg(F.min("arrived_at").alias("arrived_at"))


def last_decisions(decisions: DataFrame) -> DataFrame:
    """Newest decision of each (rater, dossier), in a batch or over the rows of all batches."""
    newest = F.max_by(F.struct("stage", "created_at", "event_id"), F.struct("created_at", "event_id"))
    return decisions.groupBy("actor", "object_id").agg(newest.alias("d")).select(
        "actor", "object_id", "d.stage", "d.created_at", "d.event_id")


READINGS = "dimension string, read_at date, ratio double, previous double, known bigint"


def _watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The readings of a dimension that this batch brings or gives another predecessor."""
    days, ratios = (list(part) for part in state.get) if state.exists else ([], [])
    changed = set()
    for batch in batches:
        for day, ratio in zip(batch["read_at"], batch["ratio"]):
            at = bisect_left(days, day)
            if at < len(days) and days[at] == day:
                if ratio >= ratios[at]:
                    continue
                ratios[at] = ratio
            else:
                days.insert(at, day)
                ratios.insert(at, ratio)
            changed.update(days[at:at + 2])
    state.update((days, ratios))
    if changed:
        # Changed in the same count of readings, a ratio can only have fallen: the latest row is told by both.
        places = [at for at, day in enumerate(days) if day in changed]
        yield pd.DataFrame({
            "dimension": key[0], "read_at": [days[at] for at in places], "ratio": [ratios[at] for at in places],
            "previous": [ratios[at - 1] if at else None for at in places], "known": len(days),
        }).astype({"previous": "float64", "known": "int64"})


def watched_readings(readings: DataFrame) -> DataFrame:
    """Each reading with the one before it in time, as state of its dimension.

    The state is one day and one ratio per reading. A reading that arrives late
    is given out with its successor, whose predecessor it now is. Of several
    readings of a day the lowest counts.
    """
    return readings.where("dimension IS NOT NULL AND read_at IS NOT NULL AND ratio IS NOT NULL").groupBy(
        "dimension").applyInPandasWithState(
        _watch, READINGS, "days array<date>, ratios array<double>", "update", GroupStateTimeout.NoTimeout)


def merged_readings(rows: DataFrame) -> DataFrame:
    """The alert of every reading from what all batches gave out, the latest of each."""
    latest = F.max_by(F.struct("ratio", "previous"), F.struct("batch_id", "known"))
    return rows.groupBy("dimension", "read_at").agg(latest.alias("r")).select(
        "dimension", "read_at", "r.ratio", "r.previous", _alert(F.col("r.ratio"), F.col("r.previous")))


def _alert(ratio, previous):
    return F.coalesce(alert_level(ratio, previous, V.IMPACT_DRIFT), F.lit("")).alias("alert")


def drift_alerts(readings: DataFrame) -> DataFrame:
    """The same over a stored table: every reading against the one before it in time."""
    daily = readings.groupBy("dimension", "read_at").agg(F.min("ratio").alias("ratio"))
    before = F.lag("ratio").over(W.partitionBy("dimension").orderBy("read_at"))
    return daily.select("dimension", "read_at", "ratio", before.alias("previous")).withColumn(
        "alert", _alert(F.col("ratio"), F.col("previous")))


def scored_arrivals(tables: Callable[[], SC.Tables], ref_year: int) -> Callable[[DataFrame], DataFrame]:
    """Scores a batch of applications against the tables as they are when it arrives.

    `tables` is asked anew for each batch, and only the profiles of the batch's
    candidates are built.
    """
    def score(batch: DataFrame) -> DataFrame:
        now = tables()
        mine = batch.select("candidate_id").distinct()
        only = {name: getattr(now, name).join(mine, "candidate_id", "left_semi") for name in (
            "candidates", "candidate_skills", "candidate_languages", "certifications")}
        return SC.finish(SC.criteria(replace(now, applications=batch, **only), ref_year=ref_year))

    return score
