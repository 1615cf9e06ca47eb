"""Scoring, ranking and matching queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from rolewise import fixed_values as V
from rolewise.functions import scores as S
from rolewise.operators import ontology as O
from rolewise.operators import ranking as R
from rolewise.operators import scoring as SC
from rolewise.plans import bindings as B
from rolewise.plans.registry import query, rounded, sql_rounded as r
from rolewise.plans.sql_views import with_changed_view
from rolewise.session import cut_lineage

NUMBERS = (*V.CRITERIA, "required_score", "preferred_score", "weighted_score", "admissibility",
           "overall")


def scores(spark, sf):
    return SC.score_applications(B.tables(spark, sf), ref_year=B.REF_YEAR)


def graded(spark, sf):
    """Scores on the published 1e-4 grid."""
    return scores(spark, sf).withColumn("overall", rounded(F.col("overall"), 4))


def stored(spark, sf):
    """Narrow score table, written out: rankings read their input more than once."""
    return cut_lineage(
        graded(spark, sf).select("application_id", "offer_id", "candidate_id", "overall")
    )


@query("ontology_relatedness", "SELECT required, held, degree FROM relatedness", "relatedness")
def _(spark, sf):
    return B.staged(spark, sf, B.relatedness).select("required", "held", "degree")


@query("skill_matching", f"""
    SELECT application_id, required, requirement, coalesce(matched_with, '') AS matched_with,
           method, degree, {r('coverage')} AS coverage, {r('recency')} AS recency,
           {r('score')} AS score FROM skill_matches""", "skill_matches")
def _(spark, sf):
    m = SC.match_skills(B.tables(spark, sf), B.REF_YEAR)
    return m.select(
        "application_id", "required", "requirement",
        F.coalesce("matched_with", F.lit("")).alias("matched_with"), "method", "degree",
        *[rounded(F.col(c)).alias(c) for c in ("coverage", "recency", "score")],
    )


@query("skill_gaps", f"""
    SELECT application_id, required, weight, {r('score')} AS score FROM skill_matches
    WHERE requirement = 'required' AND score < {V.GAP_THRESHOLD}""", "skill_matches")
def _(spark, sf):
    m = SC.gaps(SC.match_skills(B.tables(spark, sf), B.REF_YEAR))
    return m.select("application_id", "required", "weight", rounded(F.col("score")).alias("score"))


@query("score_applications", f"""
    SELECT application_id, candidate_id, offer_id, blind,
           {', '.join(f'{r(n)} AS {n}' for n in NUMBERS)} FROM scores""", "scores")
def _(spark, sf):
    return scores(spark, sf).select(
        "application_id", "candidate_id", "offer_id", "blind",
        *[rounded(F.col(n)).alias(n) for n in NUMBERS],
    )


@query("top_candidates_per_offer", f"""
    SELECT offer_id, candidate_id, overall, rank, gaps FROM (
      SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY overall DESC, candidate_id) AS rank
      FROM (SELECT application_id, offer_id, candidate_id, {r('overall', 4)} AS overall FROM scores))
    LEFT JOIN (SELECT application_id, string_agg(required, ', ' ORDER BY weight DESC, required) AS gaps
               FROM skill_matches WHERE requirement = 'required' AND score < {V.GAP_THRESHOLD}
               GROUP BY 1) USING (application_id)
    WHERE rank <= 5""", "scores skill_matches")
def _(spark, sf):
    top = R.rank_offers(graded(spark, sf), top=5)
    names = F.array_join(F.transform("gaps", lambda g: g["required"]), ", ")
    return top.select(
        "offer_id", "candidate_id", "overall", "rank",
        F.when(F.size("gaps") > 0, names).alias("gaps"),
    )


#: A skill's vector: its own supplied one, and twice one that every fifth skill shares.
SHARED, KINDS_OF_SKILL = 100, 5


def skill_vectors(spark, sf):
    held = B.read(spark, sf, "embeddings").select("vec_id", "embedding")
    brands = B.brand_ontology(spark, sf)[0].select("skill").union(
        B.staged(spark, sf, B.job_skills).select("name")).distinct().withColumn(
        "n", F.regexp_extract("skill", r"(\d+)", 1).cast("long"))
    own = held.withColumnRenamed("embedding", "own")
    kin = held.select((F.col("vec_id") - SHARED).alias("kin"), F.col("embedding").alias("shared"))
    rows = brands.join(own, F.col("n") == F.col("vec_id")).join(kin, F.col("n") % KINDS_OF_SKILL == F.col("kin"))
    mixed = F.zip_with("own", "shared", lambda a, b: a.cast("double") + 2 * b.cast("double"))
    return rows.select("skill", mixed.alias("embedding"))


_SEMANTIC = f"""
    SELECT required, held, max(degree) AS degree FROM (
      SELECT required, held, degree FROM relatedness
      UNION ALL
      SELECT required, held, least(0.80::DOUBLE, 0.80::DOUBLE * (c - 0.70::DOUBLE) / (1 - 0.70::DOUBLE)) FROM (
        SELECT a.skill AS required, b.skill AS held, least(1.0::DOUBLE, floor(list_inner_product(a.v, b.v)
                 / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)))
                 * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE) AS c
        FROM skill_vectors a JOIN skill_vectors b ON a.skill <> b.skill) WHERE c > 0.70)
    GROUP BY 1, 2"""
_SKILL_VECTORS = f"""skill_vectors AS MATERIALIZED (
      SELECT skill, list_transform(list_zip(o.embedding, k.embedding), lambda z: z[1]::DOUBLE + 2 * z[2]::DOUBLE) AS v
      FROM (SELECT skill FROM brands WHERE n > 0 AND n % 2 = 0 UNION SELECT name FROM job_skills) s
      JOIN embeddings o ON o.vec_id = regexp_extract(skill, '(\\d+)', 1)::BIGINT
      JOIN embeddings k ON k.vec_id = {SHARED} + regexp_extract(skill, '(\\d+)', 1)::BIGINT % {KINDS_OF_SKILL})"""


@query("score_with_semantic_skills", with_changed_view("relatedness", _SEMANTIC, "scores", "sem_").replace(
    "sem_relatedness AS", f"{_SKILL_VECTORS}, sem_relatedness AS", 1) + f"""
    SELECT s.application_id, {r('s.skills')} AS skills, {r('s.overall')} AS overall,
           {r('s.overall - o.overall + 1')} AS gain_plus_one
    FROM sem_scores s JOIN scores o USING (application_id)""")
def _(spark, sf):
    """Scores with the semantic layer: similar skills count by their degree."""
    tables = B.tables(spark, sf)
    pairs = O.similar_skills(skill_vectors(spark, sf))
    wider = replace(tables, relatedness=cut_lineage(O.with_semantic(tables.relatedness, pairs)))
    with_layer = SC.score_applications(wider, ref_year=B.REF_YEAR).select("application_id", "skills", "overall")
    without = scores(spark, sf).select("application_id", F.col("overall").alias("own"))
    return with_layer.join(without, "application_id").select(
        "application_id", rounded(F.col("skills")).alias("skills"), rounded(F.col("overall")).alias("overall"),
        rounded(F.col("overall") - F.col("own") + 1).alias("gain_plus_one"))


@query("rank_all_applications", f"""
    SELECT application_id, overall,
           row_number() OVER (PARTITION BY offer_id ORDER BY overall DESC, candidate_id) AS rank
    FROM (SELECT application_id, offer_id, candidate_id, {r('overall', 4)} AS overall FROM scores)""",
       "scores")
def _(spark, sf):
    return R.rank_offers(stored(spark, sf)).select(
        "application_id", "overall", F.col("rank").cast("long").alias("rank"))


@query("competition_ranks", f"""
    SELECT application_id, rank() OVER (PARTITION BY offer_id ORDER BY overall DESC) AS rank
    FROM (SELECT application_id, offer_id, {r('overall', 4)} AS overall FROM scores)""", "scores")
def _(spark, sf):
    return R.competition_ranks(stored(spark, sf), ["offer_id"], "overall").select(
        "application_id", F.col("rank").cast("long").alias("rank"))


@query("cut_marker", f"""
    WITH ranked AS (
      SELECT application_id, offer_id, overall,
             row_number() OVER (PARTITION BY offer_id ORDER BY overall DESC, candidate_id) AS rank
      FROM (SELECT application_id, offer_id, candidate_id, {r('overall', 4)} AS overall FROM scores))
    SELECT application_id, rank, overall FROM (
      SELECT *, lag(overall) OVER (PARTITION BY offer_id ORDER BY rank) AS previous FROM ranked)
    WHERE overall < 0.75 AND coalesce(previous, 1) >= 0.75""", "scores")
def _(spark, sf):
    ranked = R.rank_offers(stored(spark, sf))
    cut = R.mark_cut(ranked, 0.75).where("is_cut")
    return cut.select("application_id", F.col("rank").cast("long").alias("rank"), "overall")


@query("above_threshold_counts", f"""
    SELECT offer_id, count(*) AS applications,
           count(*) FILTER (WHERE overall >= 0.75) AS above FROM (
      SELECT offer_id, {r('overall', 4)} AS overall FROM scores) GROUP BY 1""", "scores")
def _(spark, sf):
    return graded(spark, sf).groupBy("offer_id").agg(
        F.count("*").alias("applications"),
        F.count_if(F.col("overall") >= 0.75).alias("above"))


@query("score_open_offers", f"""
    SELECT application_id, {r('overall')} AS overall FROM scores
    JOIN applications USING (application_id) JOIN offers o ON o.offer_id = scores.offer_id
    WHERE stage NOT IN ('rejected', 'withdrawn') AND o.status = 'open'""",
       "scores applications offers")
def _(spark, sf):
    s = SC.score_offers(B.tables(spark, sf), ref_year=B.REF_YEAR)
    return s.select("application_id", rounded(F.col("overall")).alias("overall"))


@query("score_blind", f"""
    SELECT application_id, {r("(coalesce(w_skills*skills,0)+coalesce(w_experience*experience,0)"
                              "+coalesce(w_education*education,0)+coalesce(w_languages*languages,0)"
                              "+coalesce(w_certifications*certifications,0))/("
                              "CASE WHEN skills IS NULL THEN 0 ELSE w_skills END"
                              "+CASE WHEN experience IS NULL THEN 0 ELSE w_experience END"
                              "+CASE WHEN education IS NULL THEN 0 ELSE w_education END"
                              "+CASE WHEN languages IS NULL THEN 0 ELSE w_languages END"
                              "+CASE WHEN certifications IS NULL THEN 0 ELSE w_certifications END)"
                              "*admissibility")} AS overall FROM criteria""", "criteria")
def _(spark, sf):
    s = SC.score_applications(B.tables(spark, sf), ref_year=B.REF_YEAR, blind=True)
    return s.select("application_id", rounded(F.col("overall")).alias("overall"))


@query("stored_criteria", f"""
    SELECT application_id, concat_ws(',', {', '.join(
        f"CASE WHEN {n} IS NOT NULL THEN '{n}' END" for n in V.CRITERIA)}) AS applicable,
      concat_ws(',', {', '.join(
        f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in V.CRITERIA)}) AS skipped,
      coalesce(matched, '') AS matched
    FROM criteria LEFT JOIN (
      SELECT application_id, string_agg(required, ',' ORDER BY requirement = 'preferred', weight DESC,
             required) AS matched
      FROM skill_matches WHERE score >= {V.GAP_THRESHOLD} GROUP BY 1) USING (application_id)""",
       "criteria skill_matches")
def _(spark, sf):
    c = SC.stored_criteria(scores(spark, sf))
    return c.select(
        "application_id", F.array_join("applicable", ",").alias("applicable"),
        F.array_join("skipped", ",").alias("skipped"),
        F.array_join("matched_skills", ",").alias("matched"))


@query("latest_scores", f"""
    SELECT application_id, score_id, {r('effective')} AS effective,
           round_even({r('effective')} * 100, 0)::INT AS percent FROM latest""", "latest")
def _(spark, sf):
    eff = rounded(F.col("effective"))
    return R.latest_scores(B.score_history(spark, sf)).select(
        "application_id", "score_id", eff.alias("effective"), S.percent(eff).alias("percent"))
