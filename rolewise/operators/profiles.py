"""Projections of a profile: masking, summaries, search text, record counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolewise import fixed_values as V

HIDDEN = ("email", "phone", "location", "linkedin_url", "github_url", "portfolio_url")


def masked_name(candidate_id: Column) -> Column:
    """"Candidat" and the first eight characters of the id, upper case."""
    return F.concat(F.lit("Candidat "), F.upper(F.substring(candidate_id.cast("string"), 1, 8)))


def mask_candidates(candidates: DataFrame, blind: Column) -> DataFrame:
    """Blind view of candidates: no name, address or contact."""
    present = [c for c in HIDDEN if c in candidates.columns]
    return candidates.withColumns({
        "full_name": F.when(blind, masked_name(F.col("candidate_id"))).otherwise(
            F.col("full_name")),
        **{c: F.when(blind, F.lit("")).otherwise(F.col(c)) for c in present},
        "blind": blind,
    })


def listed_experiences(experiences: DataFrame, ref_date: str, blind: bool,
                       top: int = V.LISTED_EXPERIENCES) -> DataFrame:
    """Latest experiences per candidate; employers become letters when blind."""
    recent = W.partitionBy("candidate_id").orderBy(
        F.desc_nulls_last("start_date"), F.asc("experience_id"))
    rows = experiences.withColumn("pos", F.row_number().over(recent)).where(F.col("pos") <= top)
    end = F.coalesce("end_date", F.to_date(F.lit(ref_date)))
    years = F.when(
        F.col("start_date").isNotNull(),
        F.greatest(F.lit(0.0), F.datediff(end, "start_date") / V.DAYS_PER_YEAR),
    ).otherwise(F.lit(0.0))
    letter = F.concat(F.lit("Entreprise "), F.char(F.lit(64) + F.col("pos")))
    named = F.coalesce(F.nullif(F.trim("company"), F.lit("")), F.lit("not named"))
    return rows.select(
        "candidate_id", "pos", "title", (letter if blind else named).alias("employer"),
        years.alias("years"),
    )


def masked_summary(candidates: DataFrame, skills: DataFrame, experiences: DataFrame,
                   ref_date: str, blind: bool) -> DataFrame:
    """Summary text from structured data: never the name, never the place."""
    order = W.partitionBy("candidate_id").orderBy(F.desc("years"), F.asc("name"))
    entry = F.when(
        F.col("years") > 0, F.format_string("%s (%d)", F.col("name"), F.col("years").cast("int"))
    ).otherwise(F.col("name"))
    listed = (
        skills.withColumn("pos", F.row_number().over(order))
        .where(F.col("pos") <= V.LISTED_SKILLS)
        .groupBy("candidate_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", entry.alias("text")))).alias("s"))
        .select("candidate_id", F.array_join(F.transform("s", lambda x: x["text"]), ", ")
                .alias("skills_text"))
    )
    jobs = (
        listed_experiences(experiences, ref_date, blind)
        .groupBy("candidate_id")
        .agg(F.array_sort(F.collect_list(F.struct(
            "pos", F.concat_ws(" @ ", "title", "employer").alias("text")))).alias("e"))
        .select("candidate_id", F.array_join(F.transform("e", lambda x: x["text"]), "; ")
                .alias("jobs_text"))
    )
    return (
        candidates.select("candidate_id", "headline", "highest_education")
        .join(listed, "candidate_id", "left").join(jobs, "candidate_id", "left")
        .select("candidate_id", F.concat_ws(
            " | ", "headline", F.concat(F.lit("education "), F.col("highest_education")),
            "skills_text", "jobs_text").alias("summary"))
    )


def profile_documents(candidates: DataFrame, parts: list[tuple[DataFrame, str, list[str]]]
                      ) -> DataFrame:
    """Search text of a profile: its own fields, then each child table in order.

    `parts` lists (table, ordering column, text columns).
    """
    out = candidates.select("candidate_id", F.concat_ws(" ", "full_name", "headline").alias("t0"))
    names = ["t0"]
    for index, (table, order, columns) in enumerate(parts, start=1):
        name = f"t{index}"
        text = F.concat_ws(" ", *columns)
        joined = table.groupBy("candidate_id").agg(
            F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("x"))))
            .alias("items")
        ).select("candidate_id", F.array_join(F.transform("items", lambda i: i["x"]), " ")
                 .alias(name))
        out = out.join(joined, "candidate_id", "left")
        names.append(name)
    return out.select("candidate_id", F.concat_ws(" ", *names).alias("text"))


def record_summary(candidates: DataFrame, skills: DataFrame, experiences: DataFrame,
                   education: DataFrame, has_evidence: Column) -> DataFrame:
    """Counts per candidate record, zero where there is nothing."""
    out = candidates.select("candidate_id")
    counted = (
        (skills, [F.count("*").alias("skills"),
                  F.count_if(has_evidence).alias("skills_with_evidence"),
                  F.count_if(~has_evidence).alias("skills_without_evidence")]),
        (experiences, [F.count("*").alias("experiences")]),
        (education, [F.count("*").alias("education")]),
    )
    for table, aggregates in counted:
        out = out.join(table.groupBy("candidate_id").agg(*aggregates), "candidate_id", "left")
    return out.na.fill(0)


def highest_education(education: DataFrame, level: str = "level") -> DataFrame:
    return education.groupBy("candidate_id").agg(
        F.coalesce(F.max(level), F.lit(0)).alias("highest_education"))
