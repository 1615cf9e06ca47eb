"""Queries on people and applications: lists, dashboards, histories, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolewise import fixed_values as V
from rolewise.functions import dates as D
from rolewise.functions import text as T
from rolewise.operators import coherence as CO
from rolewise.operators import comparison as CM
from rolewise.operators import dashboards as DB
from rolewise.operators import decisions as DE
from rolewise.operators import filters as FL
from rolewise.operators import intervals as I
from rolewise.operators import profiles as P
from rolewise.operators import ranking as R
from rolewise.operators import retention as RT
from rolewise.operators import scoring as SC
from rolewise.plans import bindings as B
from rolewise.plans.queries_scoring import graded
from rolewise.plans.registry import day, query, rounded, sql_rounded as r
from rolewise.plans.sql_views import sql_fold, sql_tenure
from rolewise.session import cut_lineage

REF = B.REF_DATE


# --- Tables, filters, projections -------------------------------------------------
@query("table_scan", """
    SELECT a.application_id, a.stage, strftime(a.applied_at, '%Y-%m-%d') AS applied_at,
           p.full_name, p.location AS candidate_location, o.title, o.location AS offer_location
    FROM applications a JOIN candidates p USING (candidate_id) JOIN offers o USING (offer_id)""",
       "applications candidates offers")
def _(spark, sf):
    a = B.staged(spark, sf, B.applications)
    p = B.staged(spark, sf, B.candidates).select(
        "candidate_id", "full_name", F.col("location").alias("candidate_location"))
    o = B.staged(spark, sf, B.offers).select("offer_id", "title", F.col("location").alias("offer_location"))
    return a.join(p, "candidate_id").join(o, "offer_id").select(
        "application_id", "stage", day("applied_at").alias("applied_at"), "full_name",
        "candidate_location", "title", "offer_location")


@query("open_applications", """
    SELECT application_id, stage FROM applications WHERE stage NOT IN ('rejected', 'withdrawn')""",
       "applications")
def _(spark, sf):
    return SC.open_applications(B.staged(spark, sf, B.applications)).select("application_id", "stage")


@query("list_by_offer_and_stage", """
    SELECT application_id, candidate_id FROM applications WHERE offer_id = 7 AND stage = 'technical'
    """, "applications")
def _(spark, sf):
    return FL.by_offer_and_stage(B.staged(spark, sf, B.applications), 7, "technical").select(
        "application_id", "candidate_id")


@query("blind_masking", """
    SELECT application_id,
      CASE WHEN blind_screening THEN 'Candidat ' || upper(substr(candidate_id::VARCHAR, 1, 8))
           ELSE full_name END AS full_name,
      CASE WHEN blind_screening THEN '' ELSE email END AS email,
      CASE WHEN blind_screening THEN '' ELSE p.location END AS location, blind_screening AS blind
    FROM applications JOIN candidates p USING (candidate_id) JOIN offers USING (offer_id)""",
       "applications candidates offers")
def _(spark, sf):
    rows = B.staged(spark, sf, B.applications).join(B.staged(spark, sf, B.candidates), "candidate_id").join(
        B.staged(spark, sf, B.offers).select("offer_id", "blind_screening"), "offer_id")
    return P.mask_candidates(rows, F.col("blind_screening")).select(
        "application_id", "full_name", "email", "location", "blind")


_RECENT = f"""
    SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY start_date DESC NULLS LAST,
                                 experience_id) AS pos,
           CASE WHEN start_date IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE,
             (coalesce(end_date, DATE '{REF}') - start_date)::DOUBLE / 365.25::DOUBLE) END AS years
    FROM experiences"""


@query("masked_experiences", f"""
    SELECT candidate_id, pos, title, 'Entreprise ' || chr((64 + pos)::INT) AS employer,
           {r('years')} AS years
    FROM ({_RECENT}) WHERE pos <= 4""", "experiences")
def _(spark, sf):
    e = P.listed_experiences(B.staged(spark, sf, B.experiences), REF, blind=True)
    return e.select("candidate_id", F.col("pos").cast("long").alias("pos"), "title", "employer",
                    rounded(F.col("years")).alias("years"))


@query("masked_profile_summary", f"""
    WITH sk AS (
      SELECT candidate_id, string_agg(txt, ', ' ORDER BY pos) AS skills_text FROM (
        SELECT candidate_id, name || ' (' || years::INT || ')' AS txt,
               row_number() OVER (PARTITION BY candidate_id ORDER BY years DESC, name) AS pos
        FROM candidate_skills) WHERE pos <= 12 GROUP BY 1),
    jb AS (
      SELECT candidate_id, string_agg(title || ' @ Entreprise ' || chr((64 + pos)::INT), '; '
                                      ORDER BY pos) AS jobs_text
      FROM ({_RECENT}) WHERE pos <= 4 GROUP BY 1)
    SELECT candidate_id, concat_ws(' | ', headline, 'education ' || highest_education,
                                   skills_text, jobs_text) AS summary
    FROM candidates LEFT JOIN sk USING (candidate_id) LEFT JOIN jb USING (candidate_id)""",
       "candidates candidate_skills experiences")
def _(spark, sf):
    return P.masked_summary(
        B.staged(spark, sf, B.candidates), B.staged(spark, sf, B.candidate_skills), B.staged(spark, sf, B.experiences), REF, True)


@query("record_summary", """
    SELECT candidate_id, coalesce(s.n, 0) AS skills, coalesce(s.w, 0) AS skills_with_evidence,
           coalesce(s.n - s.w, 0) AS skills_without_evidence,
           coalesce(e.n, 0) AS experiences, coalesce(d.n, 0) AS education
    FROM candidates
    LEFT JOIN (SELECT candidate_id, count(*) AS n, count(*) FILTER (WHERE uses >= 2) AS w
               FROM candidate_skills GROUP BY 1) s USING (candidate_id)
    LEFT JOIN (SELECT candidate_id, count(*) AS n FROM experiences GROUP BY 1) e USING (candidate_id)
    LEFT JOIN (SELECT candidate_id, count(*) AS n FROM education GROUP BY 1) d USING (candidate_id)""",
       "candidates candidate_skills experiences education")
def _(spark, sf):
    return P.record_summary(
        B.staged(spark, sf, B.candidates), B.staged(spark, sf, B.candidate_skills), B.staged(spark, sf, B.experiences),
        B.staged(spark, sf, B.education), F.col("uses") >= 2)


@query("profile_documents", """
    WITH sk AS (SELECT candidate_id, string_agg(name, ' ' ORDER BY name) AS t
                FROM candidate_skills GROUP BY 1),
    ex AS (SELECT candidate_id, string_agg(title || ' ' || company, ' ' ORDER BY experience_id) AS t
           FROM experiences GROUP BY 1),
    ed AS (SELECT candidate_id, string_agg(degree || ' ' || institution, ' ' ORDER BY degree) AS t
           FROM education GROUP BY 1),
    ce AS (SELECT candidate_id, string_agg(name, ' ' ORDER BY name) AS t
           FROM certifications GROUP BY 1)
    SELECT candidate_id, concat_ws(' ', full_name || ' ' || headline, sk.t, ex.t, ed.t, ce.t) AS text
    FROM candidates LEFT JOIN sk USING (candidate_id) LEFT JOIN ex USING (candidate_id)
    LEFT JOIN ed USING (candidate_id) LEFT JOIN ce USING (candidate_id)""",
       "candidates candidate_skills experiences education certifications")
def _(spark, sf):
    return P.profile_documents(B.staged(spark, sf, B.candidates), [
        (B.staged(spark, sf, B.candidate_skills), "name", ["name"]),
        (B.staged(spark, sf, B.experiences), "experience_id", ["title", "company"]),
        (B.staged(spark, sf, B.education), "degree", ["degree", "institution"]),
        (B.staged(spark, sf, B.certifications), "name", ["name"]),
    ])


@query("highest_education", """
    SELECT candidate_id, max(CASE WHEN p_size <= 0 THEN 0 WHEN p_size <= 2 THEN 1 WHEN p_size <= 4 THEN 3
             WHEN p_size <= 6 THEN 5 ELSE 8 END) AS highest_education
    FROM purchases JOIN part ON l_partkey = p_partkey GROUP BY 1""", "purchases")
def _(spark, sf):
    level = D.nearest_education_level(F.col("p_size").cast("string"))
    sizes = B.read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), level.alias("level"))
    return P.highest_education(B.purchases(spark, sf).join(sizes, "l_partkey"))


# --- Structured filter ----------------------------------------------------------------
def raw_filters(spark, sf):
    """Two filter rows per offer, built from the offer's own requirements."""
    asked = B.staged(spark, sf, B.job_skills).groupBy("offer_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "name"))).alias("s"))
    names = F.transform("s", lambda x: x["name"])
    base = B.staged(spark, sf, B.offers).select("offer_id", "location").join(asked, "offer_id")
    strict = base.select(
        F.concat(F.lit("strict-"), F.col("offer_id")).alias("query_id"), "offer_id",
        F.concat(F.slice(names, 1, 1), F.array(F.lit(" English "), F.lit(""))).alias("skills_all"),
        F.slice(names, 2, 2).alias("skills_any"), F.array(F.lit("brand#99")).alias("skills_none"),
        F.array().cast("array<string>").alias("languages"), F.lit(1.0).alias("min_years"),
        F.lit(1).alias("min_education"), F.lit(0.5).alias("min_score"), F.lit("").alias("location"),
        F.lit(40).alias("limit"))
    near = base.select(
        F.concat(F.lit("near-"), F.col("offer_id")).alias("query_id"), "offer_id",
        F.array().cast("array<string>").alias("skills_all"),
        F.array().cast("array<string>").alias("skills_any"),
        F.slice(names, 5, 1).alias("skills_none"), F.array(F.lit("Arabe")).alias("languages"),
        F.lit(-3.0).alias("min_years"), F.lit(0).alias("min_education"), F.lit(-1.0).alias("min_score"),
        F.split("location", " - ")[1].alias("location"), F.lit(0).alias("limit"))
    return strict.unionByName(near)


_ASKED = """asked AS (
      SELECT offer_id, list(name ORDER BY weight DESC, name) AS s FROM job_skills GROUP BY 1)"""


@query("filter_normalisation", f"""
    WITH {_ASKED}
    SELECT 'strict-' || offer_id AS query_id, s[1] AS skills_all, concat_ws(',', s[2], s[3])
             AS skills_any, 'brand#99' AS skills_none, 'English' AS languages,
           1.0::DOUBLE AS min_years, 0.5::DOUBLE AS min_score, 25 AS "limit" FROM asked
    UNION ALL
    SELECT 'near-' || offer_id, '', '', coalesce(s[5], ''), 'Arabe', 0.0, 0.0, 0 FROM asked""",
       "job_skills")
def _(spark, sf):
    f = FL.normalise_filters(raw_filters(spark, sf))
    return f.select("query_id", *[F.array_join(c, ",").alias(c) for c in FL.LISTS],
                    "min_years", "min_score", "limit")


@query("filter_candidates", f"""
    WITH {_ASKED},
    cov AS (SELECT candidate_id, name AS s FROM candidate_skills UNION
            SELECT candidate_id, required FROM candidate_skills
            JOIN relatedness ON held = name WHERE degree >= 0.80),
    base AS (
      SELECT a.application_id, a.candidate_id, a.offer_id, p.total_experience_years AS yrs,
             p.highest_education AS edu, p.location AS ploc, o.location AS oloc, k.s,
             {r('sc.overall', 4)} AS score
      FROM applications a JOIN candidates p USING (candidate_id)
      JOIN offers o ON o.offer_id = a.offer_id JOIN asked k ON k.offer_id = a.offer_id
      JOIN scores sc ON sc.application_id = a.application_id WHERE a.stage <> 'withdrawn'),
    strict AS (
      SELECT 'strict-' || offer_id AS query_id, application_id, candidate_id, score, 25 AS lim
      FROM base WHERE yrs >= 1 AND edu >= 1 AND score >= 0.5
        AND EXISTS (SELECT 1 FROM cov WHERE cov.candidate_id = base.candidate_id AND cov.s = base.s[1])
        AND EXISTS (SELECT 1 FROM cov WHERE cov.candidate_id = base.candidate_id
                    AND (cov.s = base.s[2] OR cov.s = base.s[3]))
        AND EXISTS (SELECT 1 FROM spoken WHERE spoken.candidate_id = base.candidate_id
                    AND language = 'english')),
    near AS (
      SELECT 'near-' || offer_id AS query_id, application_id, candidate_id, score, 10 AS lim
      FROM base WHERE contains(lower(ploc), lower(split_part(oloc, ' - ', 2)))
        AND NOT EXISTS (SELECT 1 FROM cov WHERE cov.candidate_id = base.candidate_id
                        AND cov.s = base.s[5])
        AND EXISTS (SELECT 1 FROM spoken WHERE spoken.candidate_id = base.candidate_id
                    AND language = 'arabe'))
    SELECT query_id, rank, application_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank
      FROM (SELECT * FROM strict UNION ALL SELECT * FROM near)) WHERE rank <= lim""",
       "applications candidates offers job_skills candidate_skills relatedness spoken scores")
def _(spark, sf):
    scores = graded(spark, sf).select("application_id", F.col("overall").alias("score"))
    filters = FL.normalise_filters(raw_filters(spark, sf))
    out = FL.filter_candidates(B.tables(spark, sf), filters, scores)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "application_id", "score")


# --- Comparison -------------------------------------------------------------------------
_CELLS = f"""
    top4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY offer_id
               ORDER BY round4 DESC, candidate_id) AS rn
             FROM (SELECT *, {r('overall', 4)} AS round4 FROM scores)) WHERE rn <= 4),
    cells0 AS (
      SELECT m.offer_id, m.candidate_id, 'skill' AS kind, m.required AS name, m.requirement, m.score
      FROM skill_matches m JOIN top4 USING (application_id)
      {' '.join(f"UNION ALL SELECT offer_id, candidate_id, 'criterion', '{n}', '', {n} FROM top4 WHERE {n} IS NOT NULL" for n in V.CRITERIA)}),
    cells AS (SELECT *, hi - lo > 0.05 AS discriminating,
                     hi - lo > 0.05 AND hi > 0 AND score >= hi - 1e-9 AS best FROM (
      SELECT *, max(score) OVER w AS hi, min(score) OVER w AS lo FROM cells0
      WINDOW w AS (PARTITION BY offer_id, kind, name)))"""


def _cells(spark, sf):
    return CM.compare_candidates(R.rank_offers(graded(spark, sf), top=V.COMPARED_CANDIDATES))


@query("comparison_matrix", f"""
    WITH {_CELLS} SELECT offer_id, candidate_id, kind, name, {r('score')} AS score,
    discriminating, best FROM cells""", "scores skill_matches")
def _(spark, sf):
    return _cells(spark, sf).select("offer_id", "candidate_id", "kind", "name",
                                    rounded(F.col("score")).alias("score"), "discriminating", "best")


@query("comparison_rows", f"""
    WITH {_CELLS} SELECT offer_id, name, requirement, discriminating,
      row_number() OVER (PARTITION BY offer_id ORDER BY requirement <> 'required',
                         NOT discriminating, name) AS pos
    FROM (SELECT DISTINCT offer_id, name, requirement, discriminating FROM cells
          WHERE kind = 'skill')""", "scores skill_matches")
def _(spark, sf):
    return CM.row_order(_cells(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


@query("comparison_strengths", f"""
    WITH {_CELLS} SELECT offer_id, candidate_id, name FROM cells
    WHERE kind = 'skill' AND discriminating AND best""", "scores skill_matches")
def _(spark, sf):
    return CM.strengths(_cells(spark, sf))


# --- Dashboards --------------------------------------------------------------------------
@query("stage_counts", "SELECT stage, count(*) AS total FROM applications GROUP BY 1",
       "applications")
def _(spark, sf):
    return DB.count_by(B.staged(spark, sf, B.applications), "stage")


@query("skill_popularity", """
    SELECT name, count(DISTINCT candidate_id) AS total FROM candidate_skills GROUP BY 1""",
       "candidate_skills")
def _(spark, sf):
    return DB.distinct_candidates(B.staged(spark, sf, B.candidate_skills), "name")


_FOLD = """c AS (SELECT {label}, count(DISTINCT candidate_id) AS total FROM {table} GROUP BY 1),
    rk AS (SELECT *, row_number() OVER (ORDER BY total DESC, {label}) AS pos, count(*) OVER () AS n
           FROM c)
    SELECT CASE WHEN n > {top} AND pos >= {top} THEN (n - {top} + 1) || ' others' ELSE {label} END
             AS {label}, sum(total)::DOUBLE AS total,
           least(pos, CASE WHEN n > {top} THEN {top} ELSE pos END)::BIGINT AS pos
    FROM rk GROUP BY 1, 3"""


@query("skill_chart_folded", "WITH " + _FOLD.format(label="name", table="candidate_skills", top=8),
       "candidate_skills")
def _(spark, sf):
    counts = DB.distinct_candidates(B.staged(spark, sf, B.candidate_skills), "name")
    return R.fold_tail(counts, "name", "total", V.CHART_TOP)


@query("language_chart_folded",
       "WITH " + _FOLD.format(label="language", table="candidate_languages", top=8),
       "candidate_languages")
def _(spark, sf):
    counts = DB.distinct_candidates(B.staged(spark, sf, B.candidate_languages), "language")
    return R.fold_tail(counts, "language", "total", V.CHART_TOP)


def _bands_sql(bands, value, source):
    rows = ", ".join(
        f"({i}, '{label}', {low}::DOUBLE, "
        f"{'1e308' if high == float('inf') else high}::DOUBLE)"
        for i, (label, low, high) in enumerate(bands))
    return f"""WITH b(pos, band, lo, hi) AS (VALUES {rows})
    SELECT pos, band, count(x.v) AS total FROM b
    LEFT JOIN (SELECT {value} AS v FROM {source}) x ON x.v >= lo AND x.v < hi GROUP BY 1, 2"""


@query("experience_bands",
       _bands_sql(V.EXPERIENCE_BANDS, "total_experience_years", "candidates"), "candidates")
def _(spark, sf):
    return DB.banded_counts(
        B.staged(spark, sf, B.candidates), F.col("total_experience_years"), V.EXPERIENCE_BANDS)


@query("score_bands", _bands_sql(V.SCORE_BANDS, "effective", "latest"), "latest")
def _(spark, sf):
    latest = R.latest_scores(B.score_history(spark, sf))
    return DB.banded_counts(latest, F.col("effective"), V.SCORE_BANDS)


@query("dashboard_gauges", f"""
    SELECT 'decided' AS gauge, count(*) FILTER (WHERE stage <> 'received') AS value,
           count(*) AS total, {r("avg((stage <> 'received')::INT)")} AS ratio FROM applications
    UNION ALL SELECT 'shortlist', count(*) FILTER (WHERE effective >= 0.75), count(*),
           {r('avg((effective >= 0.75)::INT)')} FROM latest
    UNION ALL SELECT 'retention', count(*) FILTER (WHERE retention_until < DATE '{REF}'), count(*),
           {r(f"avg(coalesce(retention_until < DATE '{REF}', false)::INT)")} FROM candidates""",
       "applications latest candidates")
def _(spark, sf):
    board = _board(spark, sf)
    parts = [board[n].select(F.lit(n).alias("gauge"), "value", "total",
                             rounded(F.col("ratio")).alias("ratio"))
             for n in ("decided", "shortlist", "retention")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _board(spark, sf):
    return DB.hr_dashboard(
        B.staged(spark, sf, B.applications), B.staged(spark, sf, B.candidates), B.staged(spark, sf, B.candidate_skills),
        B.staged(spark, sf, B.candidate_languages), B.staged(spark, sf, B.offers),
        R.latest_scores(B.score_history(spark, sf)), REF, V.DEFAULT_THRESHOLD)


@query("dashboard_totals", f"""
    SELECT 'open_offers' AS name, count(*) AS total FROM offers WHERE status = 'open'
    UNION ALL SELECT 'expired', count(*) FROM candidates WHERE retention_until < DATE '{REF}'
    UNION ALL SELECT 'expiring', count(*) FROM candidates
      WHERE retention_until BETWEEN DATE '{REF}' AND DATE '{REF}' + 30""", "offers candidates")
def _(spark, sf):
    board = _board(spark, sf)
    parts = [board[n].select(F.lit(n).alias("name"), "total")
             for n in ("open_offers", "expired", "expiring")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SINCE = "2024-01-05"
_RECENT_CALLS = f"recent AS (SELECT * FROM invocations WHERE created_at >= TIMESTAMP '{SINCE}')"


def _calls(spark, sf, name):
    return DB.invocation_dashboard(B.invocations(spark, sf), SINCE, [name])[name]


@query("latency_percentiles", f"""
    WITH {_RECENT_CALLS} SELECT purpose, {r('quantile_cont(latency_ms, 0.5)')} AS median_ms,
    {r('quantile_cont(latency_ms, 0.95)')} AS p95_ms FROM recent WHERE status = 'ok' GROUP BY 1""",
       "invocations")
def _(spark, sf):
    d = _calls(spark, sf, "latency")
    return d.select("purpose", rounded(F.col("median_ms")).alias("median_ms"),
                    rounded(F.col("p95_ms")).alias("p95_ms"))


@query("token_sums", f"""
    WITH {_RECENT_CALLS} SELECT purpose, sum(prompt_tokens)::BIGINT AS tokens_in,
    sum(completion_tokens)::BIGINT AS tokens_out FROM recent GROUP BY 1""", "invocations")
def _(spark, sf):
    return _calls(spark, sf, "tokens")


@query("daily_volume", f"""
    WITH {_RECENT_CALLS} SELECT strftime(created_at::DATE, '%Y-%m-%d') AS day, count(*) AS calls,
    count(*) FILTER (WHERE status <> 'ok') AS failures FROM recent GROUP BY 1""", "invocations")
def _(spark, sf):
    return _calls(spark, sf, "volume").withColumn("day", day("day"))


@query("invocation_totals", f"""
    WITH {_RECENT_CALLS} SELECT count(*) AS calls,
      (sum(prompt_tokens) + sum(completion_tokens))::BIGINT AS tokens,
      {r("quantile_cont(latency_ms, 0.5) FILTER (WHERE status = 'ok')")} AS median_ms,
      count(*) FILTER (WHERE status <> 'ok') AS failures FROM recent""", "invocations")
def _(spark, sf):
    return _calls(spark, sf, "totals").withColumn("median_ms", rounded(F.col("median_ms")))


@query("chart_series", f"""
    WITH {_RECENT_CALLS} SELECT purpose AS label, sum(prompt_tokens)::DOUBLE AS first,
    sum(completion_tokens)::DOUBLE AS second FROM recent GROUP BY 1""", "invocations")
def _(spark, sf):
    s = DB.series(_calls(spark, sf, "tokens"), "purpose", ["tokens_in", "tokens_out"])
    return s.select("label", F.col("values")[0].alias("first"), F.col("values")[1].alias("second"))


@query("ranking_status", """
    SELECT o.offer_id, count(*) AS applications, count(*) - count(l.score_id) AS unscored,
           coalesce(string_agg(DISTINCT l.engine_version, ',' ORDER BY l.engine_version), '')
             AS versions,
           coalesce(bool_and(l.semantic_used), false) AS all_semantic,
           coalesce(bool_or(l.semantic_used), false) AS any_semantic
    FROM (SELECT offer_id, candidate_id AS application_id FROM applications) o
    LEFT JOIN latest l USING (application_id) GROUP BY 1""", "applications latest")
def _(spark, sf):
    apps = B.staged(spark, sf, B.applications).select("offer_id", F.col("candidate_id").alias("application_id"))
    return DB.ranking_status(apps, R.latest_scores(B.score_history(spark, sf)))


@query("applications_per_offer", """
    SELECT offer_id, count(application_id) AS applications
    FROM offers LEFT JOIN applications USING (offer_id) GROUP BY 1""", "offers applications")
def _(spark, sf):
    return DB.applications_per_offer(B.staged(spark, sf, B.offers), B.staged(spark, sf, B.applications))


# --- Histories ------------------------------------------------------------------------------
@query("merged_tenure", f"""
    SELECT candidate_id, {r('total_experience_years')} AS total_experience_years FROM tenure""",
       "tenure")
def _(spark, sf):
    t = I.merged_tenure(B.staged(spark, sf, B.experiences), REF)
    return t.withColumn("total_experience_years", rounded(F.col("total_experience_years")))


@query("interval_islands", """
    SELECT candidate_id, strftime(min(start_date), '%Y-%m-%d') AS start_date,
           strftime(max(end_date), '%Y-%m-%d') AS end_date FROM (
      SELECT *, sum(opens) OVER (PARTITION BY candidate_id ORDER BY start_date, end_date, rid
                                 ROWS UNBOUNDED PRECEDING) AS isl FROM (
        SELECT *, CASE WHEN start_date <= max(end_date) OVER (PARTITION BY candidate_id
            ORDER BY start_date, end_date, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            THEN 0 ELSE 1 END AS opens FROM valid_periods)) GROUP BY candidate_id, isl""",
       "valid_periods")
def _(spark, sf):
    valid = I.closed_periods(B.staged(spark, sf, B.experiences), REF).where("end_date > start_date")
    m = I.merge_intervals(I.by_start_day(valid))
    return m.select("candidate_id", day("start_date").alias("start_date"),
                    day("end_date").alias("end_date"))


_DECLARED = "(candidate_id % 9)::DOUBLE"
_COVERED = f"cover AS ({sql_tenure('closed', 'covered_years')})"
_FINDINGS = f"""{_COVERED},
    findings AS (
      SELECT candidate_id, 'inverted_dates' AS code, 'attention' AS severity,
             (start_date - end_date)::DOUBLE AS amount, experience_id AS first_id, -1::BIGINT AS second_id
      FROM experiences WHERE end_date < start_date
      UNION ALL
      SELECT candidate_id, 'future_start', 'attention', (start_date - DATE '2001-06-01')::DOUBLE,
             experience_id, -1 FROM experiences WHERE start_date > DATE '2001-06-01'
      UNION ALL
      SELECT a.candidate_id, 'overlap', 'attention',
             (least(a.end_date, b.end_date) - b.start_date)::DOUBLE, a.rid, b.rid
      FROM cl a JOIN cl b ON a.candidate_id = b.candidate_id
        AND (a.start_date < b.start_date OR (a.start_date = b.start_date AND a.rid < b.rid))
      WHERE least(a.end_date, b.end_date) - b.start_date > 62
      UNION ALL
      SELECT candidate_id, 'diploma_after_job', 'information', (graduation_year - fy)::DOUBLE,
             graduation_year, -1 FROM education JOIN (
        SELECT candidate_id, year(min(start_date)) AS fy FROM experiences
        WHERE start_date IS NOT NULL GROUP BY 1) USING (candidate_id)
      WHERE graduation_year >= 1980 AND graduation_year - fy >= 2
      UNION ALL
      SELECT candidate_id, 'tenure_not_covered', 'information', {_DECLARED} - covered_years, -1, -1
      FROM cover WHERE {_DECLARED} - covered_years > 2
      UNION ALL
      SELECT candidate_id, 'break', 'information', (start_date - run)::DOUBLE, -1, -1 FROM (
        SELECT *, max(end_date) OVER (PARTITION BY candidate_id ORDER BY start_date, end_date, rid
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM cl)
      WHERE start_date - run > 183)"""
_FINDINGS = (
    f"cl AS (SELECT candidate_id, experience_id AS rid, start_date, "
    f"coalesce(end_date, DATE '2001-06-01') AS end_date FROM experiences "
    f"WHERE start_date IS NOT NULL), " + _FINDINGS.replace("FROM closed", "FROM cl")
)


@query("coherence_findings", f"""
    WITH {_FINDINGS} SELECT candidate_id, code, severity, {r('amount')} AS amount, first_id,
    second_id FROM findings""", "experiences education")
def _(spark, sf):
    declared = B.read(spark, sf, "customer").select(
        F.col("c_custkey").alias("candidate_id"),
        (F.col("c_custkey") % 9).cast("double").alias("declared_years"))
    f = CO.coherence(B.staged(spark, sf, B.experiences), B.staged(spark, sf, B.education), declared, "2001-06-01")
    return f.withColumn("amount", rounded(F.col("amount")))


@query("coherence_report", f"""
    WITH {_FINDINGS} SELECT candidate_id, code, severity, first_id, second_id,
      row_number() OVER (PARTITION BY candidate_id ORDER BY severity <> 'attention', code, first_id, second_id) AS position
    FROM findings""", "experiences education")
def _(spark, sf):
    """Findings in the order a reader gets them."""
    declared = B.read(spark, sf, "customer").select(
        F.col("c_custkey").alias("candidate_id"),
        (F.col("c_custkey") % 9).cast("double").alias("declared_years"))
    f = CO.coherence(B.staged(spark, sf, B.experiences), B.staged(spark, sf, B.education), declared, "2001-06-01")
    return CO.report_order(f).select("candidate_id", "code", "severity", "first_id", "second_id",
                                     F.col("position").cast("long").alias("position"))


@query("overlapping_periods", f"""
    WITH {_FINDINGS} SELECT candidate_id, first_id, second_id, amount FROM findings
    WHERE code = 'overlap'""", "experiences education")
def _(spark, sf):
    return CO.overlaps(B.staged(spark, sf, B.experiences), "2001-06-01").select(
        "candidate_id", "first_id", "second_id", "amount")


@query("employment_breaks", f"""
    WITH {_FINDINGS} SELECT candidate_id, amount FROM findings WHERE code = 'break'""",
       "experiences education")
def _(spark, sf):
    return CO.breaks(B.staged(spark, sf, B.experiences), "2001-06-01").select("candidate_id", "amount")


@query("history_verifiability", f"""
    SELECT candidate_id, count(start_date) AS dated_periods, count(*) AS total_periods,
           count(start_date) >= 2 AS verifiable, {r('count(start_date)::DOUBLE / count(*)')}
             AS coverage FROM experiences GROUP BY 1""", "experiences")
def _(spark, sf):
    v = CO.verifiability(B.staged(spark, sf, B.experiences))
    return v.withColumn("coverage", rounded(F.col("coverage")))


# --- Retention -----------------------------------------------------------------------------------
@query("retention_due", f"""
    SELECT candidate_id, strftime(retention_until, '%Y-%m-%d') AS retention_until,
           CASE WHEN retention_until < DATE '{REF}' THEN 'expired' ELSE 'expiring' END AS state,
           retention_until - DATE '{REF}' AS days_left
    FROM (SELECT candidate_id, coalesce(retention_until, created_at + 365) AS retention_until
          FROM candidates) WHERE retention_until <= DATE '{REF}' + 30""", "candidates")
def _(spark, sf):
    c = RT.with_default_retention(B.staged(spark, sf, B.candidates))
    rows = RT.expired(c, REF).withColumn("state", F.lit("expired")).unionByName(
        RT.expiring_soon(c, REF).withColumn("state", F.lit("expiring")))
    return rows.select("candidate_id", day("retention_until").alias("retention_until"), "state",
                       RT.days_until_purge(REF).cast("long").alias("days_left"))


@query("purge_plan", f"""
    WITH due AS (SELECT candidate_id FROM candidates WHERE retention_until < DATE '{REF}')
    SELECT 'candidates' AS "table", count(*) AS rows FROM due
    UNION ALL SELECT 'candidate_skills', count(*) FROM candidate_skills SEMI JOIN due USING (candidate_id)
    UNION ALL SELECT 'experiences', count(*) FROM experiences SEMI JOIN due USING (candidate_id)
    UNION ALL SELECT 'applications', count(*) FROM applications SEMI JOIN due USING (candidate_id)""",
       "candidates candidate_skills experiences applications")
def _(spark, sf):
    return RT.purge_plan(B.staged(spark, sf, B.candidates), {
        "candidate_skills": B.staged(spark, sf, B.candidate_skills),
        "experiences": B.staged(spark, sf, B.experiences), "applications": B.staged(spark, sf, B.applications)}, REF)


@query("purge_survivors", f"""
    SELECT application_id FROM applications WHERE candidate_id NOT IN (
      SELECT candidate_id FROM candidates WHERE retention_until < DATE '{REF}')""",
       "applications candidates")
def _(spark, sf):
    return RT.survivors(B.staged(spark, sf, B.applications), B.staged(spark, sf, B.candidates), REF).select(
        "application_id")


@query("purge_audit", f"""
    SELECT 'data_purged' AS action, candidate_id::VARCHAR AS object_id,
           '{{"retention_until":"' || strftime(retention_until, '%Y-%m-%d') || '"}}' AS metadata
    FROM candidates WHERE retention_until < DATE '{REF}'""", "candidates")
def _(spark, sf):
    return RT.purge_audit(B.staged(spark, sf, B.candidates), REF)


# --- Decisions -------------------------------------------------------------------------------------
@query("decision_validity", """
    SELECT event_id, refusal IS NULL AS accepted, coalesce(refusal, '') AS refusal FROM (
      SELECT event_id, CASE
        WHEN event_type = 'view' THEN 'unknown stage'
        WHEN event_type IN ('error', 'signup') AND length(trim(repeat('x ', (value % 9)::INT))) < 10
          THEN 'reason too short'
        WHEN user_id % 5 = 0 THEN 'actor cannot decide' END AS refusal
      FROM (SELECT event_id, event_type, user_id, floor(value)::BIGINT AS value FROM events))""")
def _(spark, sf):
    stages = F.create_map(*[F.lit(x) for x in (
        "error", "rejected", "signup", "withdrawn", "view", "viewed", "click", "screening",
        "purchase", "hired")])
    events = B.read(spark, sf, "events")
    d = events.select(
        "event_id", F.col("user_id").alias("actor"), F.element_at(stages, F.col("event_type"))
        .alias("stage"), F.repeat(F.lit("x "), (F.floor("value") % 9).cast("int")).alias("note"))
    actors = events.select(F.col("user_id").alias("actor")).distinct().withColumn(
        "can_decide", F.col("actor") % 5 != 0)
    return DE.validate_decisions(d, actors).select(
        "event_id", "accepted", F.coalesce("refusal", F.lit("")).alias("refusal"))


@query("score_overrides", f"""
    SELECT application_id, {r('overall')} AS previous, {r('coalesce(v, overall)')} AS effective
    FROM latest LEFT JOIN (
      SELECT object_id AS application_id, arg_max(value / 500, (created_at, event_id)) AS v FROM (
        SELECT json_extract(props, '$.k')::BIGINT AS object_id, value, ts AS created_at, event_id
        FROM events WHERE event_type = 'signup') GROUP BY 1) USING (application_id)""", "latest")
def _(spark, sf):
    overrides = B.read(spark, sf, "events").where("event_type = 'signup'").select(
        F.get_json_object("props", "$.k").cast("bigint").alias("application_id"),
        (F.col("value") / 500).alias("value"), F.lit("manual").alias("reason"),
        F.col("ts").alias("created_at"), F.col("event_id").alias("override_id"))
    scores = R.latest_scores(B.score_history(spark, sf)).select("application_id", "overall")
    out = DE.apply_overrides(scores, overrides)
    return out.select("application_id", rounded(F.col("previous")).alias("previous"),
                      rounded(F.col("effective")).alias("effective"))


@query("decision_history", """
    SELECT object_id, event_id, actor, stage, pos FROM (
      SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY created_at DESC, event_id DESC)
                AS pos FROM decisions) WHERE pos <= 10""", "decisions")
def _(spark, sf):
    return DE.decision_history(B.decisions(spark, sf)).select(
        "object_id", "event_id", "actor", "stage", F.col("pos").cast("long").alias("pos"))


# --- Dates and keys -----------------------------------------------------------------------------------
@query("loose_month_parsing", """
    SELECT o_orderkey, strftime(date_trunc('month', CASE WHEN o_orderkey % 6 = 4
             THEN make_date(year(o_orderdate), 1, 1) ELSE o_orderdate::DATE END), '%Y-%m-%d') AS month
    FROM orders WHERE o_orderkey % 6 <> 5
    UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 6 = 5""")
def _(spark, sf):
    d, kind = F.col("o_orderdate"), F.col("o_orderkey") % 6
    text = (
        F.when(kind == 0, F.date_format(d, "yyyy-MM")).when(kind == 1, F.date_format(d, "MM/yyyy"))
        .when(kind == 2, F.date_format(d, "MM.yyyy")).when(kind == 3, F.date_format(d, "MMMM yyyy"))
        .when(kind == 4, F.date_format(d, "yyyy")).otherwise(F.concat(
            F.date_format(d, "yyyy"), F.lit("-13"))))
    o = B.read(spark, sf, "orders").select("o_orderkey", text.alias("loose"))
    return o.select("o_orderkey", day(D.parse_month(F.col("loose"), 2026)).alias("month"))


@query("education_and_url_cleaning", """
    SELECT p_partkey, CASE WHEN p_size <= 0 THEN 0 WHEN p_size <= 2 THEN 1 WHEN p_size <= 4 THEN 3
             WHEN p_size <= 6 THEN 5 ELSE 8 END AS level,
           CASE WHEN 1890 + p_size * 3 BETWEEN 1900 AND 2002 THEN 1890 + p_size * 3 ELSE -1 END AS year,
           'https://' || replace(p_name, ' ', '/') AS url
    FROM part""")
def _(spark, sf):
    year = D.valid_year((F.lit(1890) + F.col("p_size") * 3).cast("string"), B.REF_YEAR)
    return B.read(spark, sf, "part").select(
        "p_partkey", D.nearest_education_level(F.col("p_size").cast("string")).alias("level"),
        F.coalesce(year, F.lit(-1)).alias("year"),
        D.clean_url(F.replace("p_name", F.lit(" "), F.lit("/"))).alias("url"))


@query("name_phone_place_keys", f"""
    SELECT c_custkey, array_to_string(list_sort([x FOR x IN regexp_split_to_array(
             regexp_replace({sql_fold("c_mktsegment || ' de ' || c_name")}, '[^a-z\\s]', ' ', 'g'),
             '\\s+') IF length(x) > 1 AND x NOT IN ({', '.join(f"'{w}'" for w in V.NAME_PARTICLES)})]),
             ' ') AS name_key,
           CASE WHEN length(regexp_replace(c_name, '\\D', '', 'g')) >= 9
                THEN right(regexp_replace(c_name, '\\D', '', 'g'), 9) ELSE '' END AS phone_key
    FROM customer""")
def _(spark, sf):
    return B.read(spark, sf, "customer").select(
        "c_custkey", T.name_key(F.concat_ws(" de ", "c_mktsegment", "c_name")).alias("name_key"),
        T.phone_key(F.col("c_name")).alias("phone_key"))
