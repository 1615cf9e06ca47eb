"""Dashboard series: counts, bands, gauges, latency and volume."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolewise import fixed_values as V
from rolewise.operators import ranking as R
from rolewise.operators.retention import expired, expiring_soon
from rolewise.session import cut_lineage


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("total"))


def distinct_candidates(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """Distinct candidates per category; the sketch is for very wide tables."""
    counter = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(column).agg(counter("candidate_id").alias("total"))


def banded_counts(df: DataFrame, value: Column, bands: tuple) -> DataFrame:
    """Rows per half-open band, in band order, empty bands kept.

    One conditional count per band in a single aggregate, then unpivoted, so
    an empty band needs no join.
    """
    inside = [
        F.count_if((value >= low) & (value < high)).alias(str(i))
        for i, (_, low, high) in enumerate(bands)
    ]
    counts = df.agg(*inside)
    rows = F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(label).alias("band"), F.col(str(i)).alias("total"))
        for i, (label, _, _) in enumerate(bands)
    ])
    return counts.select(F.inline(rows))


def gauge(df: DataFrame, condition: Column) -> DataFrame:
    """Value, total and ratio (0 on an empty table)."""
    hits, total = F.count_if(condition), F.count("*")
    return df.agg(
        hits.alias("value"), total.alias("total"),
        F.coalesce(F.try_divide(hits, total), F.lit(0.0)).alias("ratio"),
    )


def exact_percentiles(df: DataFrame, keys: list[str], value: str,
                      fractions: dict[str, float]) -> DataFrame:
    """(keys, one column per fraction): linear interpolation between ranks, 0 without data.

    Values are counted first. Counts are laid out in ranges of (keys, value), a
    value's rank is what its range has before it plus what lies before the range,
    and the two order statistics of a fraction are picked by rank, so no task
    holds the values of a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranged = cut_lineage(counts.repartitionByRange(*keys, value).withColumn(
        "part", F.spark_partition_id()), "counts")
    sums = ranged.groupBy(*keys, "part").agg(F.sum("n").alias("of_part"))
    before = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(*keys)
    offsets = sums.select(
        *keys, "part", F.coalesce(F.sum("of_part").over(before), F.lit(0)).alias("before"),
        F.sum("of_part").over(every).alias("total"))
    inside = W.partitionBy(*keys, "part").orderBy(value)
    ranks = ranged.withColumn("upto", F.sum("n").over(inside)).join(offsets, [*keys, "part"]).select(
        *keys, value, "total", (F.col("before") + F.col("upto") - F.col("n")).alias("first"),
        (F.col("before") + F.col("upto") - 1).alias("last"))
    picked = {}
    for name, fraction in fractions.items():
        place = (F.col("total") - 1) * F.lit(fraction)
        for side, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            here = (F.col("first") <= rank) & (rank <= F.col("last"))
            picked[f"{name}_{side}"] = F.max(F.when(here, F.col(value)))
        picked[f"{name}_part"] = F.max(place - F.floor(place))
    found = ranks.groupBy(*keys).agg(*[c.alias(n) for n, c in picked.items()])
    results = [
        F.coalesce(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part"),
                   F.lit(0.0)).alias(n) for n in fractions]
    return found.select(*keys, *results)


def hr_dashboard(applications: DataFrame, candidates: DataFrame, skills: DataFrame,
                 languages: DataFrame, offers: DataFrame, latest_scores: DataFrame,
                 ref_date: str, threshold: float) -> dict[str, DataFrame]:
    """All series of the recruiting dashboard by name."""
    return {
        "stages": count_by(applications, "stage"),
        "decided": gauge(applications, F.col("stage") != "received"),
        "shortlist": gauge(latest_scores, F.col("effective") >= threshold),
        "retention": gauge(
            candidates, F.coalesce(F.col("retention_until") < F.to_date(F.lit(ref_date)),
                                   F.lit(False))),
        "skills": R.fold_tail(distinct_candidates(skills, "name"), "name", "total", V.CHART_TOP),
        "languages": R.fold_tail(
            distinct_candidates(languages, "language"), "language", "total", V.CHART_TOP),
        "experience": banded_counts(
            candidates, F.col("total_experience_years"), V.EXPERIENCE_BANDS),
        "scores": banded_counts(latest_scores, F.col("effective"), V.SCORE_BANDS),
        "open_offers": offers.where("status = 'open'").agg(F.count("*").alias("total")),
        "expired": expired(candidates, ref_date).agg(F.count("*").alias("total")),
        "expiring": expiring_soon(candidates, ref_date).agg(F.count("*").alias("total")),
    }


CALL_SERIES = ("latency", "tokens", "volume", "totals")


def invocation_dashboard(invocations: DataFrame, since: str,
                         names: Iterable[str] = CALL_SERIES) -> dict[str, DataFrame]:
    """Latency, tokens, volume and totals of the calls since a day, as far as named."""
    recent = invocations.where(F.col("created_at") >= F.to_timestamp(F.lit(since)))
    ok = F.col("status") == "ok"

    def totals() -> DataFrame:
        median = exact_percentiles(recent.where(ok), [], "latency_ms", {"median_ms": 0.5})
        return recent.agg(
            F.count("*").alias("calls"),
            F.coalesce(F.sum("prompt_tokens") + F.sum("completion_tokens"), F.lit(0)).alias("tokens"),
            F.count_if(~ok).alias("failures"),
        ).withColumn("median_ms", median.scalar())

    made = {
        "latency": lambda: exact_percentiles(
            recent.where(ok), ["purpose"], "latency_ms", {"median_ms": 0.5, "p95_ms": 0.95}),
        "tokens": lambda: recent.groupBy("purpose").agg(
            F.sum("prompt_tokens").alias("tokens_in"),
            F.sum("completion_tokens").alias("tokens_out")),
        "volume": lambda: recent.groupBy(F.to_date("created_at").alias("day")).agg(
            F.count("*").alias("calls"), F.count_if(~ok).alias("failures")),
        "totals": totals,
    }
    return {name: made[name]() for name in names}


def series(df: DataFrame, label: str, values: list[str]) -> DataFrame:
    """Chart shape: a label and one or two values per category."""
    return df.select(
        F.col(label).cast("string").alias("label"),
        F.array(*[F.col(v).cast("double") for v in values]).alias("values"),
    )


def ranking_status(applications: DataFrame, latest_scores: DataFrame) -> DataFrame:
    """Per offer: applications, unscored ones, engine versions, semantic flags."""
    joined = applications.join(latest_scores, "application_id", "left")
    return joined.groupBy("offer_id").agg(
        F.count("*").alias("applications"),
        (F.count("*") - F.count("score_id")).alias("unscored"),
        F.array_join(F.sort_array(F.collect_set("engine_version")), ",").alias("versions"),
        F.coalesce(F.bool_and("semantic_used"), F.lit(False)).alias("all_semantic"),
        F.coalesce(F.bool_or("semantic_used"), F.lit(False)).alias("any_semantic"),
    )


def applications_per_offer(offers: DataFrame, applications: DataFrame) -> DataFrame:
    counts = applications.groupBy("offer_id").agg(F.count("*").alias("applications"))
    return offers.select("offer_id").join(counts, "offer_id", "left").na.fill(0, ["applications"])
