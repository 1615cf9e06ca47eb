"""Other open offers on which a candidate below the threshold would pass.

Offers that ask for the same in every scored field have one score per candidate:
one of them is scored, and of a group only the first offers by id can be among the
best. Of the groups only those go on to be scored in full that can be among the
best of their candidate (`finalists`).

`pairs_to_score` lists every pair that can reach the threshold: a score is at most
the admissibility, which depends on the candidate and the required skills alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolewise import fixed_values as V
from rolewise.operators import finalists as FI
from rolewise.operators import scoring as SC
from rolewise.operators.ranking import top_k
from rolewise.session import cut_lineage

#: Applications in these stages are left where they are.
LEFT_ALONE = ("withdrawn", "hired")
#: Scores are rounded to four decimals before they meet the threshold.
HALF_GRID = 0.5e-4
#: Candidates and offers of a block where every pair has to be scored.
CANDIDATE_BLOCK = 4096
OFFER_BLOCK = 256


def _signature(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def grouped_offers(tables: SC.Tables, top: int) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of the open offers, both stored.

    A group has its first offer with `asked`, the required skills, and their
    signature `need`; members are its first `top` offers, with `first`, the
    offer of the group that is scored.
    """
    offers = SC.offer_requirements(tables).where("status = 'open'")
    scored = [F.col(c) for c in offers.columns if c not in ("offer_id", "status")]
    asked = F.filter(
        F.coalesce("job_skills", F.expr(f"CAST(array() AS {SC.JOB_SKILLS})")), lambda j: j["requirement"] == "required")
    told = offers.select(
        "offer_id", "required_weight", "required_count", _signature(*scored).alias("same"), asked.alias("asked"),
        _signature(asked.alias("asked")).alias("need"))
    ranked = top_k(told, ["same"], [F.asc("offer_id")], top, "place")
    kept = cut_lineage(ranked, "offers")
    groups = kept.where("place = 1").drop("place")
    first = groups.select("same", F.col("offer_id").alias("first"))
    return groups, kept.select("same", "offer_id").join(first, "same").select("offer_id", "first")


def blocking_skills(needs: DataFrame, candidate_skills: DataFrame, threshold: float) -> DataFrame:
    """(need, name): skills through which a pair can reach the threshold, rarest first.

    To pass, the admissibility must reach the threshold, hence the covered
    share of the required weight a floor. Required skills that together weigh
    less than that floor cannot do it alone, so the most common ones may be
    left out of the join; the result is the same.
    """
    floor = (threshold - HALF_GRID - V.ADMISSIBILITY_FLOOR) / (1 - V.ADMISSIBILITY_FLOOR) * (
        V.ADMISSIBILITY_FULL_AT)
    required = needs.select("need", F.inline("asked")).select("need", "name", "weight")
    common = candidate_skills.groupBy("name").agg(F.count("*").alias("holders"))
    ranked = required.join(common, "name", "left").na.fill(0, ["holders"])
    one = W.partitionBy("need")
    by_use = one.orderBy(F.desc("holders"), "name")
    share = F.sum("weight").over(by_use) / F.sum("weight").over(one)
    return ranked.withColumn("common_share", share).where(
        F.col("common_share") >= floor - 1e-9).select("need", "name")


def admissible(tables: SC.Tables, needs: DataFrame, candidates: DataFrame, threshold: float,
               ref_year: int) -> DataFrame:
    """(candidate_id, need) whose admissibility reaches the threshold.

    `needs` has one row per set of required skills. The admissibility is the one
    that scoring gives.
    """
    coverage = SC.skill_coverage(
        tables.candidate_skills.join(candidates, "candidate_id", "left_semi"), tables.relatedness, ref_year)
    blocking = blocking_skills(needs, tables.candidate_skills, threshold)
    reached = coverage.select("candidate_id", F.col("required").alias("name")).join(blocking, "name").select(
        "candidate_id", "need").distinct()
    held = coverage.groupBy("candidate_id").agg(
        F.map_from_entries(F.collect_list(F.struct("required", "options"))).alias("coverage"))
    asked = needs.select(
        "need", F.col("asked").alias("job_skills"), "required_weight", "required_count",
        F.lit(0.0).alias("preferred_weight"), F.lit(0).cast("bigint").alias("preferred_count"),
        *[c.alias(name) for name, c in SC.class_weights(F.col("asked")).items()])
    rows = SC.with_skill_scores(SC.with_matches(reached.join(asked, "need").join(held, "candidate_id")))
    return rows.where(F.col("admissibility") >= threshold - HALF_GRID).select("candidate_id", "need")


def all_pairs(candidates: DataFrame, offers: DataFrame, candidate_block: int = CANDIDATE_BLOCK,
              offer_block: int = OFFER_BLOCK) -> DataFrame:
    """(candidate_id, offer_id): every pair, dealt so that a pair of blocks is one key."""
    wide, deep = (max(1, -(-frame.count() // size)) for frame, size in (
        (candidates, candidate_block), (offers, offer_block)))

    def dealt(frame: DataFrame, key: str, mine: str, own: int, other: str, others: int) -> DataFrame:
        return frame.select(key, F.pmod(F.xxhash64(key), F.lit(own)).alias(mine)).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))

    return dealt(candidates, "candidate_id", "c", wide, "o", deep).join(
        dealt(offers, "offer_id", "o", deep, "c", wide), ["c", "o"]).select("candidate_id", "offer_id")


def pairs_to_score(tables: SC.Tables, groups: DataFrame, candidates: DataFrame, threshold: float,
                   ref_year: int) -> DataFrame:
    """(candidate_id, offer_id): first offers of groups whose score may reach the threshold.

    An offer without required skills admits anyone, and under a threshold at the
    floor of the admissibility any offer does: there nothing bounds a pair.
    """
    if threshold - HALF_GRID <= V.ADMISSIBILITY_FLOOR:
        return all_pairs(candidates, groups.select("offer_id"))
    asking = groups.where("required_count > 0")
    needs = asking.groupBy("need").agg(*[F.first(c).alias(c) for c in ("asked", "required_weight", "required_count")])
    bounded = admissible(tables, needs, candidates, threshold, ref_year).join(
        asking.select("need", "offer_id"), "need").select("candidate_id", "offer_id")
    free = groups.where("required_count = 0").select("offer_id")
    return bounded if free.isEmpty() else bounded.unionByName(all_pairs(candidates, free))


def redirect(tables: SC.Tables, current: DataFrame, threshold: float, ref_year: int,
             top: int = V.MAX_SUGGESTIONS, grid=lambda c: c, cell: float = 0.0) -> DataFrame:
    """Best other open offers per application below the threshold.

    `current` has (application_id, candidate_id, offer_id, score); a null score
    counts as 0, and withdrawn and hired applications are left alone. A group of
    equal offers is scored once per candidate, however many applications the
    candidate has; the best top + 1 offers of a candidate settle all of them, and
    only pairs that can be among these are scored. A `grid` that rounds to multiples
    of some number gives it as `cell`.
    """
    settled = tables.applications.where(F.col("stage").isin(*LEFT_ALONE)).select("application_id")
    below = current.withColumn("score", F.coalesce("score", F.lit(0.0))).where(
        F.col("score") < threshold).join(settled, "application_id", "left_anti")
    below = cut_lineage(below, "below")
    candidates = below.select("candidate_id").distinct()
    groups, members = grouped_offers(tables, top + 1)
    pairs = FI.finalists(tables, groups, candidates, threshold, ref_year, top + 1, cell).withColumn(
        "application_id", F.concat_ws("-", "candidate_id", "offer_id"))
    scored = SC.score_applications(tables.with_applications(pairs), ref_year=ref_year)
    passing = scored.withColumn("overall", grid(F.col("overall"))).where(
        F.col("overall") >= threshold).select("candidate_id", F.col("offer_id").alias("first"), "overall", "skill_matches")
    each = passing.join(members, "first")
    best = top_k(each, ["candidate_id"], [F.desc("overall"), F.asc("offer_id")], top + 1).select(
        "candidate_id", F.col("offer_id").alias("suggested"), F.col("overall").alias("new_score"),
        F.transform(
            F.filter("skill_matches", lambda m: (m["requirement"] == "required")
                     & (m["score"] >= V.GAP_THRESHOLD)),
            lambda m: m["required"]).alias("matched_skills"))
    offered = below.join(best, "candidate_id").where("suggested <> offer_id")
    ranked = top_k(offered, ["application_id"], [F.desc("new_score"), F.asc("suggested")], top)
    applied = tables.applications.select(
        "candidate_id", F.col("offer_id").alias("suggested"), F.lit(True).alias("already_applied"))
    return ranked.join(applied, ["candidate_id", "suggested"], "left").select(
        "application_id", "suggested", "rank", "new_score",
        (F.col("new_score") - F.col("score")).alias("gain"),
        F.coalesce("already_applied", F.lit(False)).alias("already_applied"), "matched_skills")


def offers_examined(applications: DataFrame, offers: DataFrame) -> DataFrame:
    """Open offers other than the applied one, per application."""
    count = offers.where("status = 'open'").agg(F.count("*")).scalar()
    own = applications.join(offers.select("offer_id", "status"), "offer_id")
    return own.withColumn("open_offers", count).select(
        "application_id",
        (F.col("open_offers") - (F.col("status") == "open").cast("int")).alias("offers_examined"))
