"""Scoring of applications: six criteria, renormalised weights, admissibility.

The plan keeps one row per application. Child tables are first reduced to
their unique keys and nested under their candidate or offer (a candidate has
one entry per skill, an offer one per requirement), so a score needs two
joins on unique keys and one projection. Nothing is exploded and regrouped
per application, and a candidate or offer with very many applications only
makes the large side of a join skewed, which adaptive execution splits.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolewise import fixed_values as V
from rolewise.functions import scores as S
from rolewise.functions.text import fold, fold_key, place_tokens


@dataclass(frozen=True)
class Tables:
    """The hiring tables. Skill names are canonical."""

    applications: DataFrame
    candidates: DataFrame
    candidate_skills: DataFrame
    candidate_languages: DataFrame
    certifications: DataFrame
    offers: DataFrame
    job_skills: DataFrame
    job_languages: DataFrame
    relatedness: DataFrame

    def with_applications(self, applications: DataFrame) -> "Tables":
        return replace(self, applications=applications)


KINDS = ("required", "preferred")


# --- Matching -----------------------------------------------------------------
def skill_coverage(
    candidate_skills: DataFrame, relatedness: DataFrame, ref_year: int
) -> DataFrame:
    """Every (candidate, required skill) covered to some degree, best held first.

    `options` lists the held skills that cover `required`, ordered by degree,
    then years (desc), then name: the first entry is the match. The work is
    bound to the skill table, not to the number of applications.
    """
    held = candidate_skills.select(
        "candidate_id", F.col("name").alias("held"), "years",
        S.recency(F.col("last_used_year"), ref_year).alias("recency"),
    )
    exact = held.select(
        "candidate_id", F.col("held").alias("required"), "held", "years", "recency",
        F.lit(1.0).alias("degree"), F.lit("exact").alias("method"),
    )
    related = held.join(relatedness, "held").select(exact.columns)
    return (
        exact.unionByName(related)
        .groupBy("candidate_id", "required")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        (-F.col("degree")).alias("minus_degree"),
                        (-F.col("years")).alias("minus_years"),
                        "held", "recency", "method",
                    )
                )
            ).alias("options")
        )
    )


def best_coverage(
    candidate_skills: DataFrame, relatedness: DataFrame, ref_year: int
) -> DataFrame:
    """(candidate_id, coverage): per covered skill the first of `skill_coverage`'s options.

    A candidate's skills meet in one narrow shuffle, each with what it is related
    to; what they cover is sorted inside the row, and of a skill the best is kept.
    """
    kin = relatedness.groupBy("held").agg(
        F.collect_list(F.struct("required", "degree", "method")).alias("kin"))
    held = candidate_skills.select(
        "candidate_id", F.col("name").alias("held"), "years",
        S.recency(F.col("last_used_year"), ref_year).alias("recency"),
    ).join(kin, "held", "left")

    def covered(h: Column) -> Column:
        def option(required: Column, degree: Column, method: Column) -> Column:
            return F.struct(
                required.alias("required"), (-degree).alias("minus_degree"),
                (-h["years"]).alias("minus_years"), h["held"].alias("held"),
                h["recency"].alias("recency"), method.alias("method"))

        related = F.transform(h["kin"], lambda k: option(k["required"], k["degree"], k["method"]))
        own = F.array(option(h["held"], F.lit(1.0), F.lit("exact")))
        return F.when(h["kin"].isNull(), own).otherwise(F.concat(own, related))

    rows = held.groupBy("candidate_id").agg(
        F.collect_list(F.struct("held", "years", "recency", "kin")).alias("skills"))
    sorted_rows = rows.select(
        "candidate_id", F.sort_array(F.flatten(F.transform("skills", covered))).alias("options"))
    first = F.filter("options", lambda o, i: (i == 0) | (
        o["required"] != F.try_element_at(F.col("options"), i)["required"]))
    entry = lambda o: F.struct(o["required"].alias("required"), F.array(F.struct(
        *[o[c].alias(c) for c in ("minus_degree", "minus_years", "held", "recency", "method")])).alias("options"))
    return sorted_rows.select("candidate_id", F.map_from_entries(F.transform(first, entry)).alias("coverage"))


def full_coverage(
    candidate_skills: DataFrame, relatedness: DataFrame, ref_year: int
) -> DataFrame:
    """(candidate_id, coverage): all options per covered skill, for what takes some of them away."""
    return (
        skill_coverage(candidate_skills, relatedness, ref_year)
        .groupBy("candidate_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("required", "options"))).alias("coverage"))
    )


def match_skills(tables: Tables, ref_year: int) -> DataFrame:
    """One row per (application, job skill) with the best held skill.

    Requirements become rows before they are matched, so the match is generated code.
    """
    keys = ("application_id", "candidate_id", "offer_id")
    joined = _joined(tables, candidate_profiles(tables, ref_year), offer_requirements(tables))
    rows = joined.select(*keys, "coverage", F.explode("job_skills").alias("job"))
    chosen = rows.select(*keys, "job", F.try_element_at(
        F.try_element_at(F.col("coverage"), F.col("job.name")), F.lit(1)).alias("option"))
    job, option = F.col("job"), F.col("option")
    missing = option.isNull()
    found = {
        "degree": -option["minus_degree"], "coverage": S.coverage(job["min_years"], -option["minus_years"]),
        "recency": option["recency"], "score": _score(job["min_years"], option, None),
    }
    return chosen.select(
        *keys, job["name"].alias("required"), job["requirement"].alias("requirement"),
        job["weight"].alias("weight"), job["min_years"].alias("min_years"), option["held"].alias("matched_with"),
        F.when(missing, F.lit("none")).otherwise(option["method"]).alias("method"),
        *[F.when(missing, F.lit(0.0)).otherwise(c).alias(n) for n, c in found.items()])


# --- Nested sides ---------------------------------------------------------------
def candidate_profiles(tables: Tables, ref_year: int, every_option: bool = False) -> DataFrame:
    """One row per candidate: scalars, coverage map, language map, certificates.

    Scores read the best option of a covered skill, so the profile has no other
    unless `every_option` asks for all.
    """
    covering = full_coverage if every_option else best_coverage
    coverage = covering(tables.candidate_skills, tables.relatedness, ref_year)
    languages = (
        tables.candidate_languages
        .groupBy("candidate_id", fold_key(F.col("language")).alias("language"))
        .agg(F.max(S.level_order(F.col("level"))).alias("rank"))
        .groupBy("candidate_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("language", "rank"))).alias("spoken"))
    )
    certificates = (
        tables.certifications
        .groupBy("candidate_id")
        .agg(F.collect_set(fold(F.col("name"))).alias("certificates"))
    )
    return (
        tables.candidates
        .select(
            "candidate_id", "full_name", "total_experience_years", "highest_education",
            F.col("location").alias("candidate_location"),
            place_tokens(F.col("location")).alias("candidate_place"),
            *[c for c in ("graduation_year", "institution") if c in tables.candidates.columns],
        )
        .join(coverage, "candidate_id", "left")
        .join(languages, "candidate_id", "left")
        .join(certificates, "candidate_id", "left")
    )


def offer_requirements(tables: Tables) -> DataFrame:
    """One row per offer: scalars, required skills, languages, certificates."""
    skills = tables.job_skills.groupBy("offer_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.when(F.col("requirement") == "required", 0).otherwise(1).alias("pos"),
                    (-F.col("weight")).alias("minus_weight"),
                    "name", "requirement", "weight", "min_years",
                )
            )
        ).alias("job_skills"),
        *[F.sum(F.when(F.col("requirement") == kind, F.col("weight")).otherwise(F.lit(0.0)))
          .alias(f"{kind}_weight") for kind in KINDS],
        *[F.count_if(F.col("requirement") == kind).alias(f"{kind}_count") for kind in KINDS],
    )
    languages = tables.job_languages.groupBy("offer_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    fold_key(F.col("language")).alias("language"),
                    S.level_order(F.col("min_level")).alias("needed"),
                    "is_required",
                )
            )
        ).alias("job_languages")
    )
    named = F.filter(F.col("required_certifications"), lambda c: F.trim(c) != "")
    return (
        tables.offers
        .select(
            "offer_id", "remote_policy", "experience_min_years", "education_level",
            "blind_screening", "weights", "status",
            F.col("location").alias("offer_location"),
            place_tokens(F.col("location")).alias("offer_place"),
            F.transform(named, fold).alias("job_certificates"),
        )
        .join(skills, "offer_id", "left")
        .join(languages, "offer_id", "left")
        .withColumns(class_weights(F.col("job_skills")))
        .na.fill(0, [f"{kind}_{what}" for kind in KINDS for what in ("weight", "count")])
    )


def _joined(tables: Tables, profiles: DataFrame, offers: DataFrame) -> DataFrame:
    """Applications with both sides; their rows, wide by then, are not sorted to meet the profiles."""
    applications = tables.applications.select("application_id", "candidate_id", "offer_id")
    return applications.join(offers, "offer_id").join(profiles.hint("shuffle_hash"), "candidate_id")


# --- Criteria as expressions over a joined row ------------------------------------
def _found(name: Column, use, otherwise: Column) -> Column:
    """`use` of the chosen held skill for an asked one, `otherwise` if there is none.

    The option is bound once: what a lambda names repeatedly is worked out each time.
    """
    options = F.slice(F.try_element_at(F.col("coverage"), name), 1, 1)
    return F.coalesce(F.try_element_at(F.transform(options, use), F.lit(1)), otherwise)


def _score(min_years: Column, option: Column, digits: int | None) -> Column:
    covered = S.coverage(min_years, -option["minus_years"])
    score = -option["minus_degree"] * covered * option["recency"]
    return F.round(score, digits) if digits is not None else score


def _jobs() -> Column:
    return F.coalesce(F.col("job_skills"), F.expr("CAST(array() AS " + JOB_SKILLS + ")"))


def match_scores(digits: int | None = None, jobs: Column | None = None) -> Column:
    """Array of the scores alone, in requirement order: all that the means read.

    `jobs` may name other skills (name, min_years) than those of the row's offer, which
    are read from `job_names` and `job_years`: rows that need no more are half as wide.
    """
    def scored(name: Column, min_years: Column) -> Column:
        return _found(name, lambda o: F.struct(_score(min_years, o, digits).alias("score")),
                      F.struct(F.lit(0.0).alias("score")))["score"]

    if jobs is not None:
        return F.transform(jobs, lambda job: scored(job["name"], job["min_years"]))
    names = F.coalesce("job_names", F.array().cast("array<string>"))
    return F.transform(names, lambda name, i: scored(name, F.get("job_years", i)))


def skill_matches(digits: int | None = None) -> Column:
    """Array of matches in requirement order, empty for an offer without skills."""
    nothing = F.struct(
        F.lit(None).cast("string").alias("matched_with"), F.lit("none").alias("method"),
        *[F.lit(0.0).alias(c) for c in ("degree", "coverage", "recency", "score")])

    def matched(job: Column) -> Column:
        found = _found(job["name"], lambda o: F.struct(
            o["held"].alias("matched_with"), o["method"].alias("method"), (-o["minus_degree"]).alias("degree"),
            S.coverage(job["min_years"], -o["minus_years"]).alias("coverage"), o["recency"].alias("recency"),
            _score(job["min_years"], o, digits).alias("score")), nothing)
        return F.struct(job.alias("job"), found.alias("found"))

    return F.transform(F.transform(_jobs(), matched), lambda p: F.struct(
        *[p["job"][c].alias(n) for n, c in (
            ("required", "name"), ("requirement", "requirement"), ("weight", "weight"), ("min_years", "min_years"))],
        *[p["found"][c].alias(c) for c in ("matched_with", "method", "degree", "coverage", "recency", "score")]))


JOB_SKILLS = (
    "ARRAY<STRUCT<pos: INT, minus_weight: DOUBLE, name: STRING, requirement: STRING, "
    "weight: DOUBLE, min_years: INT>>"
)


def class_weights(job_skills: Column) -> dict[str, Column]:
    """All that scores read of the skills, as plain arrays in requirement order.

    Of the weights there is an array per class, null at skills of the other class.
    """
    def of(kind: str) -> Column:
        return F.transform(job_skills, lambda j: F.when(j["requirement"] == kind, j["weight"]))

    return {"job_names": F.transform(job_skills, lambda j: j["name"]),
            "job_years": F.transform(job_skills, lambda j: j["min_years"]),
            **{f"{kind}_weights": of(kind) for kind in KINDS}}


def _mean_score(requirement: str) -> Column:
    """`weighted_mean` over plain arrays of an offer's weights and the scores."""
    parts = F.zip_with(
        f"{requirement}_weights", "match_scores", lambda w, s: F.when(w.isNotNull(), w * s).otherwise(F.lit(0.0)))
    total = F.aggregate(parts, F.lit(0.0), lambda t, x: t + x)
    weight = F.col(f"{requirement}_weight")  # 0 where an offer has no skills
    return F.when(weight > 0, total / weight).otherwise(F.lit(0.0))


def weighted_mean(matches: Column, requirement: str) -> Column:
    """Weighted mean of one requirement class; 0 without weight.

    The class weight is a constant of the offer, summed with its requirements.
    """
    weighted = F.aggregate(
        matches, F.lit(0.0),
        lambda total, m: F.when(
            m["requirement"] == requirement, total + m["weight"] * m["score"]
        ).otherwise(total),
    )
    weight = F.col(f"{requirement}_weight")
    return F.when(weight > 0, weighted / weight).otherwise(F.lit(0.0))


def _languages(jobs: Column, spoken: Column) -> Column:
    """Weighted mean over the language requirements; null when there are none."""
    item = lambda j: S.language_value(
        F.coalesce(F.try_element_at(spoken, j["language"]), F.lit(0)), j["needed"]
    )
    weight = lambda j: F.when(j["is_required"], F.lit(1.0)).otherwise(
        F.lit(V.OPTIONAL_LANGUAGE_WEIGHT)
    )
    total = F.aggregate(jobs, F.lit(0.0), lambda t, j: t + weight(j))
    value = F.aggregate(jobs, F.lit(0.0), lambda t, j: t + weight(j) * item(j))
    return F.when(F.size(jobs) > 0, value / total)


def _certificates(asked: Column, held: Column) -> Column:
    """Share of the asked certificates held, by substring either way."""
    owned = F.coalesce(held, F.array().cast("array<string>"))
    found = F.filter(
        asked,
        lambda a: F.exists(owned, lambda h: F.contains(h, a) | F.contains(a, h)),
    )
    return F.when(F.size(asked) > 0, F.size(found) / F.size(asked))


def with_matches(joined: DataFrame, digits: int | None = None) -> DataFrame:
    """The matches and, for the means, only what these read; what is not selected is not worked out."""
    return joined.withColumns({"skill_matches": skill_matches(digits), "match_scores": match_scores(digits)})


def with_skill_scores(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Required and preferred means, their blend, and the admissibility."""
    rounded = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    means = df.withColumns({f"{kind}_score": _mean_score(kind) for kind in KINDS})
    has_required, has_preferred = F.col("required_count") > 0, F.col("preferred_count") > 0
    blend = (1 - V.PREFERRED_SHARE) * F.col("required_score") + V.PREFERRED_SHARE * F.col(
        "preferred_score"
    )
    return means.withColumns({
        "skills": rounded(
            F.when(has_required & has_preferred, blend)
            .when(has_required, F.col("required_score"))
            .when(has_preferred, F.col("preferred_score"))
        ),
        "admissibility": S.admissibility(
            rounded(F.col("required_score")), F.col("required_count")
        ),
    })


def with_other_criteria(df: DataFrame, blind: Column, digits: int | None = None) -> DataFrame:
    """The five criteria besides skills; null means not applicable."""
    rounded = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return df.withColumns({
        "experience": rounded(
            S.experience_value(F.col("total_experience_years"), F.col("experience_min_years"))
        ),
        "education": rounded(
            S.education_value(F.col("highest_education"), F.col("education_level"))
        ),
        "languages": rounded(_languages(F.col("job_languages"), F.col("spoken"))),
        "certifications": rounded(
            _certificates(F.col("job_certificates"), F.col("certificates"))
        ),
        "location": location(blind),
    })


def location(blind: Column) -> Column:
    return S.location_value(
        F.col("offer_place"), F.col("candidate_place"), F.col("remote_policy"),
        F.col("offer_location"), F.col("candidate_location"), blind,
    )


def weighted_sum(weights: Column, digits: int | None = None) -> tuple[Column, Column]:
    """(weighted score, weights used) over the applicable criteria."""
    mass = {
        name: F.when(F.col(name).isNotNull(), weights[name]).otherwise(F.lit(0.0))
        for name in V.CRITERIA
    }
    total = sum(mass.values(), F.lit(0.0))
    used = {}
    for name, value in mass.items():
        share = value / total
        if digits is not None:
            share = F.round(share, digits)
        used[name] = F.when((total > 0) & F.col(name).isNotNull(), share)
    score = sum(
        (F.coalesce(used[name] * F.col(name), F.lit(0.0)) for name in V.CRITERIA), F.lit(0.0)
    )
    return score, F.struct(*[value.alias(name) for name, value in used.items()])


def criteria(
    tables: Tables, *, ref_year: int, blind: bool | None = None, compat_rounding: bool = False,
    profiles: DataFrame | None = None, offers: DataFrame | None = None,
) -> DataFrame:
    """Every criterion of every application, before any weighting.

    `profiles` and `offers` may stand in for those of the tables, with more columns.
    """
    digits = 4 if compat_rounding else None
    joined = _joined(
        tables, profiles if profiles is not None else candidate_profiles(tables, ref_year),
        offers if offers is not None else offer_requirements(tables),
    )
    hidden = F.lit(blind) if blind is not None else F.col("blind_screening")
    scored = with_skill_scores(with_matches(joined, digits), digits)
    return with_other_criteria(scored.withColumn("blind", hidden), F.col("blind"), digits)


def finish(df: DataFrame, weights: Column | None = None, compat_rounding: bool = False) -> DataFrame:
    """Weighted sum times admissibility on a criteria frame."""
    digits = 4 if compat_rounding else None
    score, used = weighted_sum(weights if weights is not None else F.col("weights"), digits)
    out = df.withColumns({"weighted_score": score, "weights_used": used})
    overall = F.col("weighted_score") * F.col("admissibility")
    return out.withColumn("overall", F.round(overall, 4) if compat_rounding else overall)


def gap_list(matches: Column, threshold: float = V.GAP_THRESHOLD) -> Column:
    """Required skills matched below the threshold."""
    return F.filter(
        matches, lambda m: (m["requirement"] == "required") & (m["score"] < threshold)
    )


def score_applications(
    tables: Tables, *, ref_year: int, weights: Column | None = None,
    blind: bool | None = None, compat_rounding: bool = False,
) -> DataFrame:
    """Score every application of `tables`.

    `compat_rounding` rounds matches, criteria and weights to four decimals
    before they are combined, as published figures do; the default is exact.
    """
    rows = finish(
        criteria(tables, ref_year=ref_year, blind=blind, compat_rounding=compat_rounding),
        weights, compat_rounding,
    )
    return rows.select(
        "application_id", "candidate_id", "offer_id", *V.CRITERIA,
        "required_score", "preferred_score", "required_count", "preferred_count",
        "weighted_score", "admissibility", "overall", "weights_used", "skill_matches",
        gap_list(F.col("skill_matches")).alias("gaps"), "blind",
        F.lit(V.ENGINE_VERSION).alias("engine_version"),
    )


def score_offers(tables: Tables, *, ref_year: int, statuses: tuple[str, ...] = ("open",),
                 offer_ids: DataFrame | None = None) -> DataFrame:
    """Score the still-open applications of the chosen offers."""
    wanted = tables.offers.where(F.col("status").isin(*statuses))
    if offer_ids is not None:
        wanted = wanted.join(offer_ids.select("offer_id"), "offer_id", "left_semi")
    live = open_applications(tables.applications).join(
        wanted.select("offer_id"), "offer_id", "left_semi"
    )
    return score_applications(tables.with_applications(live), ref_year=ref_year)


def open_applications(applications: DataFrame) -> DataFrame:
    return applications.where(~F.col("stage").isin(*V.CLOSED_STAGES))


def gaps(matches: DataFrame, threshold: float = V.GAP_THRESHOLD) -> DataFrame:
    """Required matches below the threshold, one row each."""
    return matches.where((F.col("requirement") == "required") & (F.col("score") < threshold))


def stored_criteria(scores: DataFrame) -> DataFrame:
    """Applicable and skipped criteria and matched skills of stored scores."""
    names = [F.when(F.col(n).isNotNull(), F.lit(n)) for n in V.CRITERIA]
    skipped = [F.when(F.col(n).isNull(), F.lit(n)) for n in V.CRITERIA]
    kept = F.filter(F.col("skill_matches"), lambda m: m["score"] >= V.GAP_THRESHOLD)
    return scores.select(
        "application_id",
        F.array_compact(F.array(*names)).alias("applicable"),
        F.array_compact(F.array(*skipped)).alias("skipped"),
        F.transform(kept, lambda m: m["required"]).alias("matched_skills"),
    )
