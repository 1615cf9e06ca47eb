"""SQL twins of the derived views, composed as common table expressions."""

from __future__ import annotations

from rolewise import fixed_values as V
from rolewise.plans import bindings as B


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def _doubles(values) -> str:
    return "[" + ", ".join(f"{v}::DOUBLE" for v in values) + "]"


def sql_canonical(column: str) -> str:
    form = f"trim(regexp_replace(lower(replace({column}, '_', ' ')), '\\s+', ' ', 'g'))"
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in B.BRAND_ALIASES.items())
    return f"CASE {form} {cases} ELSE {form} END"


def sql_fold(column: str) -> str:
    return f"strip_accents(lower({column}))"


def sql_level(column: str) -> str:
    cases = " ".join(f"WHEN '{code}' THEN {rank}" for code, rank in V.LANGUAGE_LEVELS.items())
    return f"(CASE {column} {cases} ELSE 0 END)"


def sql_place(column: str) -> str:
    return (
        f"[x FOR x IN regexp_split_to_array({sql_fold(column)}, '[,/()\\s-]+') "
        "IF length(x) > 2]"
    )


def sql_tenure(source: str, years: str) -> str:
    """Union length of dated periods per candidate, as a nested query."""
    return f"""
    SELECT candidate_id, sum(e - s)::DOUBLE / 365.25 AS {years} FROM (
      SELECT candidate_id, isl, min(start_date) AS s, max(end_date) AS e FROM (
        SELECT *, sum(opens) OVER (PARTITION BY candidate_id ORDER BY start_date, end_date, rid
                                   ROWS UNBOUNDED PRECEDING) AS isl FROM (
          SELECT *, CASE WHEN start_date <= max(end_date) OVER (
              PARTITION BY candidate_id ORDER BY start_date, end_date, rid
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens
          FROM {source})) GROUP BY 1, 2) GROUP BY 1"""


_w = V.DEFAULT_WEIGHTS
_RAW = {
    "purchases": """
        SELECT o_custkey AS candidate_id, l_suppkey AS offer_id, l_partkey, l_quantity,
               o_orderdate::DATE AS day
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "applications": f"""
        SELECT candidate_id, offer_id, min(day) AS applied_at,
               candidate_id || '-' || offer_id AS application_id,
               {_list(B.STAGES)}[(candidate_id * 7 + offer_id * 3) % 9 + 1] AS stage
        FROM purchases GROUP BY candidate_id, offer_id""",
    "experiences": f"""
        SELECT o_custkey AS candidate_id, o_orderkey AS experience_id,
               substr(o_orderpriority, 3, 20) AS title,
               'Employer ' || (o_orderkey % 1000) AS company,
               CASE WHEN o_orderkey % 61 <> 0 THEN o_orderdate::DATE END AS start_date,
               CASE WHEN o_orderkey % 97 = 0 THEN NULL
                    WHEN o_orderkey % 50 = 0 THEN o_orderdate::DATE - 10
                    ELSE o_orderdate::DATE + {B.PERIOD_DAYS} END AS end_date
        FROM orders""",
    "closed": f"""
        SELECT candidate_id, experience_id, experience_id AS rid, start_date, title, company,
               coalesce(end_date, DATE '{B.REF_DATE}') AS end_date
        FROM experiences WHERE start_date IS NOT NULL""",
    "valid_periods": "SELECT * FROM closed WHERE end_date > start_date",
    "tenure": sql_tenure("valid_periods", "total_experience_years"),
    "candidates": f"""
        SELECT c_custkey AS candidate_id, c_name AS full_name,
               n_name || ', ' || r_name AS location, n_regionkey AS region_key,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1
                    WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 5 WHEN 'MACHINERY' THEN 8
                    ELSE 0 END AS highest_education,
               lower(c_mktsegment) || ' specialist' AS headline,
               'c' || c_custkey || '@example.org' AS email,
               coalesce(total_experience_years, 0)::DOUBLE AS total_experience_years,
               coalesce(first_day, DATE '1995-01-01') AS created_at,
               CASE WHEN c_custkey % 10 <> 0 THEN last_day + {V.RETENTION_DAYS} END
                   AS retention_until
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN tenure ON tenure.candidate_id = c_custkey
        LEFT JOIN (SELECT o_custkey, min(o_orderdate)::DATE AS first_day,
                          max(o_orderdate)::DATE AS last_day FROM orders GROUP BY 1) d
               ON d.o_custkey = c_custkey""",
    "candidate_skills": f"""
        SELECT candidate_id, {sql_canonical('p_brand')} AS name,
               count(DISTINCT year(day))::DOUBLE AS years, max(year(day)) AS last_used_year,
               count(*) AS uses
        FROM purchases JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "candidate_languages": f"""
        WITH base AS (SELECT c_custkey AS candidate_id, n_regionkey AS region
                      FROM customer JOIN nation ON c_nationkey = n_nationkey)
        SELECT candidate_id, {_list(B.SPOKEN_IN_REGION)}[region + 1] AS language,
               {_list(V.LANGUAGE_LEVELS)}[candidate_id % 7 + 1] AS level FROM base
        UNION ALL
        SELECT candidate_id,
               {_list(B.SPOKEN_IN_REGION)}[(region + 1 + candidate_id % 2) % 5 + 1],
               {_list(V.LANGUAGE_LEVELS)}[candidate_id % 3 + 1] FROM base""",
    "certifications": """
        SELECT candidate_id, p_type AS name, year(min(day)) AS obtained_year
        FROM purchases JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 40 GROUP BY 1, 2""",
    "education": """
        SELECT c_custkey AS candidate_id, 'Degree in ' || lower(c_mktsegment) AS degree,
               'Institute ' || c_nationkey AS institution,
               (1994 + c_custkey % 10)::INT AS graduation_year FROM customer""",
    "offers": f"""
        SELECT s_suppkey AS offer_id, 'Role ' || s_name AS title,
               n_name || ' - ' || r_name AS location, n_regionkey AS region_key,
               ['onsite', 'hybrid', 'remote'][s_suppkey % 3 + 1] AS remote_policy,
               (s_suppkey % 6)::INT AS experience_min_years,
               {_list(V.EDUCATION_LEVELS)}[s_suppkey % 5 + 1] AS education_level,
               ({_list(B.PART_TYPES)})[s_suppkey % 6 + 1 : s_suppkey % 6 + s_suppkey % 3]
                   AS required_certifications,
               CASE WHEN s_acctbal > 0 THEN 'open' ELSE 'closed' END AS status,
               s_suppkey % 4 = 0 AS blind_screening,
               (CASE WHEN s_suppkey % 10 = 1 THEN 0.60 ELSE {_w['skills']} END)::DOUBLE AS w_skills,
               {_w['experience']}::DOUBLE AS w_experience,
               {_w['education']}::DOUBLE AS w_education, {_w['languages']}::DOUBLE AS w_languages,
               {_w['certifications']}::DOUBLE AS w_certifications,
               (CASE WHEN s_suppkey % 10 = 1 THEN 0.05 ELSE {_w['location']} END)::DOUBLE
                   AS w_location
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "job_skills": f"""
        SELECT offer_id, name, CASE WHEN pos <= 3 THEN 'required' ELSE 'preferred' END
                   AS requirement,
               {_doubles((2.0, 1.5, 1.2, 1.0, 1.0))}[pos] AS weight, (5 - pos)::INT AS min_years
        FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY quantity DESC, name)
                     AS pos
              FROM (SELECT l_suppkey AS offer_id, {sql_canonical('p_brand')} AS name,
                           sum(l_quantity) AS quantity
                    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))
        WHERE pos <= 5""",
    "job_languages": f"""
        WITH base AS (SELECT s_suppkey AS offer_id, n_regionkey AS region
                      FROM supplier JOIN nation ON s_nationkey = n_nationkey
                      WHERE s_suppkey % 5 <> 0)
        SELECT offer_id, {_list(B.LANGUAGE_OF_REGION)}[region + 1] AS language,
               {_list(V.LANGUAGE_LEVELS)}[offer_id % 6 + 1] AS min_level, true AS is_required
        FROM base
        UNION ALL
        SELECT offer_id, {_list(B.LANGUAGE_OF_REGION)}[(region + 1) % 5 + 1],
               {_list(V.LANGUAGE_LEVELS)}[offer_id % 4 + 1], false
        FROM base WHERE offer_id % 3 = 0""",
    "brands": f"""
        SELECT DISTINCT {sql_canonical('p_brand')} AS skill,
               regexp_extract({sql_canonical('p_brand')}, '(\\d+)', 1)::INT AS n FROM part""",
    "closure": """
        SELECT skill, implied FROM (
          WITH RECURSIVE walk(skill, implied) AS (
            SELECT skill, 'brand#' || (n // 2) FROM brands WHERE n > 0 AND n % 2 = 0
            UNION
            SELECT w.skill, 'brand#' || (b.n // 2) FROM walk w JOIN brands b ON b.skill = w.implied
            WHERE b.n > 0 AND b.n % 2 = 0)
          SELECT * FROM walk)""",
    "relatedness": f"""
        SELECT required, held, arg_min(degree, ord) AS degree FROM (
          SELECT implied AS required, skill AS held, {V.IMPLICATION_DEGREE}::DOUBLE AS degree,
                 1 AS ord FROM closure
          UNION ALL SELECT skill, implied, {V.PREREQUISITE_DEGREE}::DOUBLE, 2 FROM closure
          UNION ALL SELECT skill, 'brand#' || (n + 2), 0.6::DOUBLE, 3 FROM brands WHERE n % 2 = 1
          UNION ALL SELECT 'brand#' || (n + 2), skill, 0.6::DOUBLE, 3 FROM brands WHERE n % 2 = 1)
        GROUP BY 1, 2""",
    "candidate_best": """
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY candidate_id, required
                                       ORDER BY degree DESC, years DESC, held) AS rn
          FROM (SELECT candidate_id, name AS required, name AS held, years, last_used_year,
                       1.0::DOUBLE AS degree, 'exact' AS method FROM candidate_skills
                UNION ALL
                SELECT candidate_id, required, held, years, last_used_year, degree, 'ontology'
                FROM candidate_skills JOIN relatedness ON held = name))
        WHERE rn = 1""",
    "skill_matches": f"""
        SELECT *, degree * coverage * recency AS score FROM (
          SELECT a.application_id, a.candidate_id, a.offer_id, j.name AS required, j.requirement,
                 j.weight, j.min_years, b.held AS matched_with, coalesce(b.method, 'none') AS method,
                 coalesce(b.degree, 0)::DOUBLE AS degree,
                 CASE WHEN b.held IS NULL THEN 0.0::DOUBLE
                      WHEN j.min_years <= 0 THEN 1.0::DOUBLE WHEN b.years <= 0 THEN 0.85::DOUBLE
                      WHEN b.years >= j.min_years THEN 1.0::DOUBLE
                      ELSE 0.70::DOUBLE + 0.30::DOUBLE * (b.years / j.min_years) END AS coverage,
                 CASE WHEN b.held IS NULL THEN 0.0::DOUBLE ELSE
                   0.80::DOUBLE + 0.20::DOUBLE * ((CASE
                     WHEN b.last_used_year IS NULL THEN 0.85::DOUBLE
                     WHEN {B.REF_YEAR} - b.last_used_year <= 1 THEN 1.0::DOUBLE
                     WHEN {B.REF_YEAR} - b.last_used_year <= 3 THEN 0.90::DOUBLE
                     WHEN {B.REF_YEAR} - b.last_used_year <= 6 THEN 0.75::DOUBLE
                     ELSE 0.55::DOUBLE END) - 0.55::DOUBLE) / 0.45::DOUBLE END AS recency
          FROM applications a JOIN job_skills j ON j.offer_id = a.offer_id
          LEFT JOIN candidate_best b
                 ON b.candidate_id = a.candidate_id AND b.required = j.name)""",
    "skill_scores": """
        SELECT application_id, required_score, preferred_score, required_count, preferred_count,
               CASE WHEN required_count > 0 AND preferred_count > 0
                      THEN 0.85::DOUBLE * required_score + 0.15::DOUBLE * preferred_score
                    WHEN required_count > 0 THEN required_score ELSE preferred_score END AS skills,
               CASE WHEN required_count > 0
                    THEN least(1.0::DOUBLE, 0.20::DOUBLE + 0.80::DOUBLE * required_score / 0.50::DOUBLE)
                    ELSE 1.0::DOUBLE END AS admissibility
        FROM (SELECT application_id,
                coalesce(sum(weight * score) FILTER (WHERE requirement = 'required')
                  / nullif(sum(weight) FILTER (WHERE requirement = 'required'), 0), 0)::DOUBLE
                  AS required_score,
                coalesce(sum(weight * score) FILTER (WHERE requirement = 'preferred')
                  / nullif(sum(weight) FILTER (WHERE requirement = 'preferred'), 0), 0)::DOUBLE
                  AS preferred_score,
                count(*) FILTER (WHERE requirement = 'required') AS required_count,
                count(*) FILTER (WHERE requirement = 'preferred') AS preferred_count
              FROM skill_matches GROUP BY 1)""",
    "spoken": f"""
        SELECT candidate_id, {sql_fold('trim(language)')} AS language,
               max({sql_level('level')}) AS rank FROM candidate_languages GROUP BY 1, 2""",
    "language_scores": f"""
        SELECT application_id, sum(w * v) / sum(w) AS languages FROM (
          SELECT a.application_id, CASE WHEN j.is_required THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w,
                 CASE WHEN coalesce(s.rank, 0) = 0 THEN 0.0::DOUBLE
                      WHEN s.rank >= {sql_level('j.min_level')} THEN 1.0::DOUBLE
                      ELSE greatest(0.0::DOUBLE,
                           1.0::DOUBLE - 0.25::DOUBLE * ({sql_level('j.min_level')} - s.rank)) END AS v
          FROM applications a JOIN job_languages j ON j.offer_id = a.offer_id
          LEFT JOIN spoken s ON s.candidate_id = a.candidate_id
               AND s.language = {sql_fold('trim(j.language)')}) GROUP BY 1""",
    "asked_certificates": """
        SELECT offer_id, unnest(required_certifications) AS asked FROM offers""",
    "certificate_scores": """
        SELECT application_id, avg(held)::DOUBLE AS certifications FROM (
          SELECT a.application_id, c.asked, max(CASE WHEN h.name IS NULL THEN 0 ELSE 1 END) AS held
          FROM applications a JOIN asked_certificates c ON c.offer_id = a.offer_id
          LEFT JOIN certifications h ON h.candidate_id = a.candidate_id
               AND (contains(lower(h.name), lower(c.asked))
                    OR contains(lower(c.asked), lower(h.name)))
          GROUP BY 1, 2) GROUP BY 1""",
    "criteria": f"""
        SELECT a.application_id, a.candidate_id, a.offer_id, k.skills, k.required_score,
               k.preferred_score, k.required_count, k.preferred_count, k.admissibility,
               CASE WHEN o.experience_min_years > 0 THEN
                 CASE WHEN p.total_experience_years / o.experience_min_years >= 1 THEN 1.0::DOUBLE
                      ELSE pow(p.total_experience_years / o.experience_min_years, 0.7::DOUBLE) END
               END AS experience,
               CASE WHEN o.education_level > 0 THEN
                 CASE WHEN p.highest_education >= o.education_level THEN 1.0::DOUBLE
                      ELSE p.highest_education::DOUBLE / o.education_level END END AS education,
               l.languages, c.certifications,
               CASE WHEN NOT o.blind_screening AND o.remote_policy <> 'remote' THEN
                 CASE WHEN list_has_any({sql_place('o.location')}, {sql_place('p.location')})
                        THEN 1.0::DOUBLE
                      WHEN o.remote_policy = 'hybrid' THEN 0.45::DOUBLE ELSE 0.25::DOUBLE END
               END AS location,
               o.blind_screening AS blind, o.remote_policy, o.location AS offer_location,
               o.w_skills, o.w_experience, o.w_education, o.w_languages, o.w_certifications,
               o.w_location
        FROM applications a JOIN offers o USING (offer_id) JOIN candidates p USING (candidate_id)
        LEFT JOIN skill_scores k USING (application_id)
        LEFT JOIN language_scores l USING (application_id)
        LEFT JOIN certificate_scores c USING (application_id)""",
}


def sql_weighted(names=V.CRITERIA, weight="w_{0}", value="{0}") -> str:
    mass = " + ".join(
        f"CASE WHEN {value.format(n)} IS NULL THEN 0 ELSE {weight.format(n)} END" for n in names
    )
    total = " + ".join(
        f"coalesce({weight.format(n)} * {value.format(n)}, 0)" for n in names
    )
    return f"(({total}) / ({mass}))"


_RAW["scores"] = f"""
        SELECT *, {sql_weighted()} AS weighted_score, {sql_weighted()} * admissibility AS overall
        FROM criteria"""
_RAW["decisions"] = """
        SELECT event_id, user_id AS actor, json_extract(props, '$.k')::BIGINT AS object_id,
               CASE event_type WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'withdrawn'
                    ELSE event_type END AS stage, ts AS created_at FROM events"""
_RAW["last_decisions"] = """
        SELECT actor, object_id, arg_max(stage, (created_at, event_id)) AS stage,
               arg_max(stage, (created_at, event_id)) NOT IN ('rejected', 'withdrawn') AS retained
        FROM decisions GROUP BY 1, 2"""
_RAW["score_history"] = """
        SELECT event_id AS score_id, json_extract(props, '$.k')::BIGINT AS application_id,
               value / 491 AS overall,
               CASE WHEN event_type = 'purchase' THEN 0.9::DOUBLE END AS overridden_score,
               ts AS created_at, '1.' || (user_id % 3) || '.0' AS engine_version,
               user_id % 2 = 0 AS semantic_used FROM events"""
_RAW["latest"] = """
        SELECT application_id, score_id, engine_version, semantic_used, overall,
               coalesce(overridden_score, overall) AS effective FROM (
          SELECT *, row_number() OVER (PARTITION BY application_id
                                       ORDER BY created_at DESC, score_id DESC) AS rn
          FROM score_history) WHERE rn = 1"""
_RAW["invocations"] = """
        SELECT 'purpose-' || (json_extract(props, '$.k')::BIGINT % 7) AS purpose,
               value AS latency_ms,
               CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
               json_extract(props, '$.k')::BIGINT * 10 AS prompt_tokens,
               floor(value)::BIGINT AS completion_tokens, ts AS created_at FROM events"""
_RAW["judgments"] = """
        SELECT source AS case_id, doc_id AS item_id,
               floor(10000::DOUBLE * n_chars / (n_chars + 1500)) / 10000::DOUBLE AS score,
               2 * quality + (1 - toxic) AS relevance
        FROM labels JOIN documents USING (doc_id)"""
_RAW["predicted"] = """
        SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, item_id) AS rn,
               row_number() OVER (PARTITION BY case_id ORDER BY relevance DESC, item_id) AS ideal
        FROM judgments"""
VIEWS = {name: " ".join(text.split()) for name, text in _RAW.items()}
_ORDER = list(VIEWS)


def _needs(name: str) -> set[str]:
    import re

    words = set(re.findall(r"[a-z_]+", VIEWS[name]))
    return {other for other in _ORDER[: _ORDER.index(name)] if other in words}


def with_views(names: list[str], body: str) -> str:
    """`body` prefixed by the named views and everything they read."""
    wanted: set[str] = set()
    stack = list(names)
    while stack:
        name = stack.pop()
        if name not in wanted:
            wanted.add(name)
            stack.extend(_needs(name))
    ctes = ", ".join(
        f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in _ORDER if name in wanted
    )
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[len('WITH '):]}"
    return f"WITH {ctes} {body}"


def with_changed_view(name: str, text: str, root: str, prefix: str) -> str:
    """WITH list of `root` and all it reads, and once more, prefixed, on a changed view `name`.

    `text` may read the view by its own name.
    """
    import re

    names, stack = set(), [root]
    while stack:
        n = stack.pop()
        if n not in names:
            names.add(n)
            stack.extend(_needs(n))
    order, changed, extra = [n for n in _ORDER if n in names], {name}, []
    for n in order:
        body = text if n == name else VIEWS[n]
        if n != name and not _needs(n) & changed:
            continue
        if n != name:
            for c in changed:
                body = re.sub(rf"(FROM|JOIN) {c}\b", rf"\1 {prefix}{c}", body)
        changed.add(n)
        extra.append(f"{prefix}{n} AS MATERIALIZED ({body})")
    return "WITH " + ", ".join([f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in order] + extra)
