"""Ingest, extraction, counterfactual and streaming queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from rolewise import fixed_values as V
from rolewise.functions import arabic as AR
from rolewise.functions import scores as S
from rolewise.functions import text as T
from rolewise.functions import weights as WT
from rolewise.operators import counterfactual as CF
from rolewise.operators import extraction as EX
from rolewise.operators import metrics as M
from rolewise.operators import scoring as SC
from rolewise.plans import bindings as B
from rolewise.plans.queries_evaluation import readings
from rolewise.plans.registry import day, query, rounded, sql_rounded as r
from rolewise.session import cut_lineage, work_path
from rolewise.sources import ingest as IN
from rolewise.sources import tables as TB
from rolewise.streaming import jobs as ST

_TEXT = "regexp_replace(regexp_replace(html, '(?s)<(script|style).*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g')"


def page_text(spark, sf):
    stripped = F.regexp_replace(
        F.regexp_replace("html", r"(?s)<(script|style).*?</(script|style)>", " "), "<[^>]*>", " ")
    return B.read(spark, sf, "pages").select("page_id", "url", "html", stripped.alias("text"))


# --- Sources and sinks -----------------------------------------------------------------
@query("content_hash_ingest", """
    WITH h AS (SELECT doc_id, sha256(text) AS content_hash FROM documents)
    SELECT content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM h
    WHERE content_hash NOT IN (SELECT content_hash FROM h WHERE doc_id % 10 = 0) GROUP BY 1""")
def _(spark, sf):
    hashed = B.read(spark, sf, "documents").select(
        IN.content_hash(F.col("text")).alias("content_hash"), "doc_id")
    known = hashed.where("doc_id % 10 = 0").select("content_hash")
    return IN.new_documents(hashed, known, "doc_id").select("content_hash", "doc_id", "copies")


@query("upload_validation", f"""
    SELECT page_id, length, coalesce(refusal, '') AS refusal FROM (
      SELECT page_id, length, CASE WHEN suffix NOT IN ('.pdf', '.docx') THEN 'unsupported format'
             WHEN length > 4000 THEN 'too large' END AS refusal FROM (
        SELECT page_id, length(html) AS length,
               ['.pdf', '.docx', '.txt'][page_id % 3 + 1] AS suffix FROM pages))""")
def _(spark, sf):
    suffix = F.element_at(F.array(F.lit(".PDF"), F.lit(".docx"), F.lit(".txt")),
                          (F.col("page_id") % 3 + 1).cast("int"))
    files = B.read(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("/in/a.b/file"), F.col("page_id"), suffix).alias("path"),
        F.length("html").cast("long").alias("length"))
    return IN.validate_uploads(files, max_bytes=4000).select(
        "page_id", "length", F.coalesce("refusal", F.lit("")).alias("refusal"))


@query("audit_append", """
    SELECT CASE event_type WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'withdrawn'
             ELSE event_type END AS stage, count(*) AS entries,
           count(DISTINCT json_extract(props, '$.k')::BIGINT) AS objects FROM events GROUP BY 1""")
def _(spark, sf):
    path = work_path(spark, "audit")
    rows = TB.audit_rows(
        B.decisions(spark, sf), F.lit("stage_changed"), F.col("actor"), "Application",
        F.col("object_id"), F.lit("stage changed"), ["stage", "event_id"])
    TB.append_audit(rows, path)
    stored = spark.read.parquet(path)
    return stored.groupBy(F.get_json_object("metadata", "$.stage").alias("stage")).agg(
        F.count("*").alias("entries"), F.count_distinct("object_id").alias("objects"))


@query("score_history_append", """
    SELECT application_id, count(*) AS runs FROM score_history GROUP BY 1""", "score_history")
def _(spark, sf):
    path = work_path(spark, "scores")
    history = B.score_history(spark, sf).drop("engine_version")
    for run in (0, 1):
        TB.append_scores(history.where(F.col("score_id") % 2 == run), path, F.col("created_at"))
    return spark.read.parquet(path).groupBy("application_id").agg(F.count("*").alias("runs"))


@query("report_export", f"""
    SELECT metric, {r('avg(value)')} AS value FROM (
      SELECT 'relevance' AS metric, avg(relevance) AS value FROM judgments GROUP BY case_id)
    GROUP BY 1""", "judgments")
def _(spark, sf):
    path = work_path(spark, "report")
    cases = B.judgments(spark, sf).groupBy("case_id").agg(F.avg("relevance").alias("relevance"))
    TB.write_report(M.macro_average(cases, ["relevance"]), cases, path)
    back = spark.read.schema("metric STRING, value DOUBLE").json(f"{path}/aggregate")
    return back.select("metric", rounded(F.col("value")).alias("value"))


@query("evaluation_set_reader", """
    SELECT case_id, count(*) AS items, sum(relevance)::BIGINT AS total FROM judgments GROUP BY 1""",
       "judgments")
def _(spark, sf):
    """Judgments written as annotated sets, one per source, and read back."""
    path = work_path(spark, "sets")
    sets = B.judgments(spark, sf).withColumn("name", F.col("case_id")).groupBy("name", "case_id").agg(
        F.array(F.struct(F.col("case_id").alias("id"), F.collect_list(
            F.struct(F.col("item_id").alias("id"), "relevance")).alias("candidates"))).alias("cases"))
    sets.select("name", F.lit("ranking").alias("kind"), F.lit("1").alias("version"), "cases"
                ).repartition(20, "name").write.option("maxRecordsPerFile", 1).json(path)
    schema = "id STRING, candidates ARRAY<STRUCT<id: BIGINT, relevance: INT>>"
    cases = TB.evaluation_cases(spark, path, "ranking", schema)
    flat = cases.select(F.col("id").alias("case_id"), F.explode("candidates").alias("c"))
    return flat.groupBy("case_id").agg(
        F.count("*").alias("items"), F.sum("c.relevance").alias("total"))


@query("skill_upsert", """
    SELECT candidate_id, name, max(years) AS years, max(last_used_year) AS last_used_year,
           arg_max(confidence, load_seq) AS confidence FROM (
      SELECT candidate_id, name, years, last_used_year, 0.4::DOUBLE AS confidence, 1 AS load_seq
      FROM candidate_skills
      UNION ALL
      SELECT candidate_id, name, (candidate_id % 4)::DOUBLE, last_used_year - 1, 0.75::DOUBLE, 2
      FROM candidate_skills WHERE candidate_id % 3 = 0) GROUP BY 1, 2""", "candidate_skills")
def _(spark, sf):
    old = B.staged(spark, sf, B.candidate_skills).select(
        "candidate_id", "name", "years", "last_used_year", F.lit(0.4).alias("confidence"),
        F.lit(1).alias("load_seq"))
    new = old.where("candidate_id % 3 = 0").select(
        "candidate_id", "name", (F.col("candidate_id") % 4).cast("double").alias("years"),
        (F.col("last_used_year") - 1).alias("last_used_year"), F.lit(0.75).alias("confidence"),
        F.lit(2).alias("load_seq"))
    out = IN.upsert(old, new, ["candidate_id", "name"], ("years", "last_used_year"), ("confidence",))
    return out.drop("load_seq")


@query("identity_upsert", """
    SELECT email, CASE WHEN candidate_id % 2 = 0 THEN 'New ' || full_name ELSE full_name END AS full_name,
           location FROM candidates
    UNION ALL SELECT 'x' || email, 'Added', '' FROM candidates WHERE candidate_id % 5 = 0""",
       "candidates")
def _(spark, sf):
    old = B.staged(spark, sf, B.candidates).select("candidate_id", "email", "full_name", "location")
    new = old.select(
        F.concat(F.lit(" "), F.upper("email")).alias("email"),
        F.when(F.col("candidate_id") % 2 == 0, F.concat(F.lit("New "), "full_name"))
        .otherwise(F.lit("")).alias("full_name"), F.lit("").alias("location"),
        F.lit(1).alias("load_seq"))
    added = old.where("candidate_id % 5 = 0").select(
        F.concat(F.lit("x"), "email").alias("email"), F.lit("Added").alias("full_name"),
        F.lit("").alias("location"), F.lit(1).alias("load_seq"))
    out = IN.upsert_identity(old, new.unionByName(added), ("full_name", "location"))
    return out.withColumn("location", F.coalesce("location", F.lit("")))


# --- Text rules ----------------------------------------------------------------------------
_ARABIC = "'السيرة الذاتية ' || customer.c_custkey || ' أحمد ٢٠٢٤ مـصطفى'"


@query("arabic_normalisation", """
    SELECT c_custkey, 'السيره الذاتيه ' || c_custkey || ' احمد 2024 مصطفي' AS normal,
           true AS has_arabic, c_name AS untouched FROM customer""")
def _(spark, sf):
    text = F.concat(F.lit("السيرة الذاتية "), F.col("c_custkey"), F.lit(" أَحمد ٢٠٢٤ مـصطفى"))
    return B.read(spark, sf, "customer").select(
        "c_custkey", AR.normalise(text).alias("normal"), AR.contains_arabic(text).alias("has_arabic"),
        AR.normalise(F.col("c_name")).alias("untouched"))


@query("text_profile_extraction", f"""
    WITH p AS (SELECT doc_id, text, lower(text) AS low,
                      [trim(s) FOR s IN regexp_split_to_array(text, '[\\n.;]+') IF length(trim(s)) >= 12]
                        AS parts,
                      list_sort(list_distinct([y::INT FOR y IN regexp_extract_all(
                        text, '\\b(19[89]\\d|20[0-4]\\d)\\b', 1)])) AS years FROM documents)
    SELECT doc_id, regexp_extract(text, '[\\w.+-]+@[\\w-]+\\.[\\w.]+') AS email,
           trim(regexp_extract(text, '\\+?\\d[\\d\\s.-]{{7,15}}\\d')) AS phone,
           left(coalesce(parts[2], ''), 120) AS headline,
           array_to_string(years, ',') AS years,
           array_to_string(([s FOR s IN {list(V.SKILL_LEXICON)} IF contains(low, lower(s))])[1:12], ',')
             AS skills
    FROM p""")
def _(spark, sf):
    d = B.read(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text")
    p = EX.extract_profiles(d)
    return p.select(
        F.col("document_id").alias("doc_id"), "email", "phone", "headline",
        F.array_join(F.col("years").cast("array<string>"), ",").alias("years"),
        F.array_join(F.transform("skills", lambda s: s["name"]), ",").alias("skills"))


#: Latin letters of every third document become Arabic ones, four of them in a form that is unified.
_LATIN, _ARABIC = "abcdefghijklmnopqrstuvwxyz0123456789", "أبتثإجحةىدذرزسشصضطظعغفقكلم٠١٢٣٤٥٦٧٨٩"
_UNIFIED = "ابتثاجحهيدذرزسشصضطظعغفقكلم0123456789"
_IS_ARABIC = "doc_id % 3 = 0"
_RE2_BLOCKS = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", AR.BLOCKS)


@query("arabic_texts", f"""
    WITH t AS (SELECT doc_id, CASE WHEN {_IS_ARABIC} THEN translate(lower(text), '{_LATIN}', '{_ARABIC}')
                 ELSE text END AS text,
                 CASE WHEN {_IS_ARABIC} THEN translate(lower(text), '{_LATIN}', '{_UNIFIED}') ELSE text END AS unified
               FROM documents WHERE text IS NOT NULL),
    s AS (SELECT *, regexp_split_to_array(text, '\\r?\\n') AS lines,
                 length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS letters,
                 length(regexp_replace(regexp_replace(text, '[^\\p{{L}}]', '', 'g'), '[^{_RE2_BLOCKS}]', '', 'g')) AS ours FROM t)
    SELECT doc_id, {r("CASE WHEN letters = 0 THEN 0 ELSE ours / letters::DOUBLE END")} AS share,
           sha256(CASE WHEN regexp_matches(text, '[{_RE2_BLOCKS}]') THEN unified ELSE text END) AS normal,
           sha256(array_to_string(list_transform(lines, lambda l: CASE WHEN trim(l) <> ''
             AND length(regexp_replace(regexp_replace(l, '[^\\p{{L}}]', '', 'g'), '[^{_RE2_BLOCKS}]', '', 'g'))
                 / nullif(length(regexp_replace(l, '[^\\p{{L}}]', '', 'g')), 0)::DOUBLE >= 0.999
             THEN reverse(l) ELSE l END), chr(10))) AS logical FROM s""")
def _(spark, sf):
    """Share of Arabic letters, comparable form and logical order of whole texts."""
    arabic = F.translate(F.lower("text"), _LATIN, _ARABIC)
    rows = B.read(spark, sf, "documents").where("text IS NOT NULL").select(
        "doc_id", F.when(F.expr(_IS_ARABIC), arabic).otherwise(F.col("text")).alias("text"))
    text = F.col("text")
    return rows.select("doc_id", rounded(AR.arabic_share(text)).alias("share"),
                       F.sha2(AR.normalise(text), 256).alias("normal"), F.sha2(AR.logical_order(text), 256).alias("logical"))


@query("ligature_expansion", """
    SELECT doc_id, sha256(text) AS plain FROM documents WHERE text IS NOT NULL""")
def _(spark, sf):
    """Texts set with ligatures come back as they were written."""
    set_ = F.col("text")
    for plain, ligature in (("ffi", "ﬃ"), ("ffl", "ﬄ"), ("ff", "ﬀ"), ("fi", "ﬁ"), ("fl", "ﬂ")):
        set_ = F.replace(set_, F.lit(plain), F.lit(ligature))
    return B.read(spark, sf, "documents").where("text IS NOT NULL").select(
        "doc_id", F.sha2(T.expand_ligatures(set_), 256).alias("plain"))


@query("document_quality", f"""
    SELECT page_id, char_count, {r('char_count::DOUBLE / page_count')} AS chars_per_page,
           char_count::DOUBLE / page_count < 180 AS looks_scanned, char_count > 0 AS verifiable,
           CASE WHEN char_count::DOUBLE / page_count < 180 AND source = 'pdf' AND char_count > 0
                  THEN 'hybrid' WHEN char_count::DOUBLE / page_count < 180 AND source = 'pdf' THEN 'vision'
                WHEN char_count > 0 THEN 'text' ELSE '' END AS route FROM (
      SELECT page_id, sum(length(part))::BIGINT AS char_count, count(*) AS page_count,
             CASE WHEN page_id % 2 = 0 THEN 'pdf' ELSE 'docx' END AS source FROM (
        SELECT page_id, unnest(string_split(text, '.')) AS part FROM (
          SELECT page_id, {_TEXT} AS text FROM pages)) GROUP BY page_id)""")
def _(spark, sf):
    pages = page_text(spark, sf).select(
        F.col("page_id").alias("document_id"), F.posexplode(F.split("text", r"\.")).alias("page", "text"),
        F.when(F.col("page_id") % 2 == 0, "pdf").otherwise("docx").alias("source"))
    q = EX.document_quality(pages)
    return q.select(
        F.col("document_id").alias("page_id"), "char_count",
        rounded(F.col("chars_per_page")).alias("chars_per_page"), "looks_scanned", "verifiable",
        F.coalesce("route", F.lit("")).alias("route"))


def word_boxes(spark, sf):
    """Words of a document laid out on lines of 100 columns, the middle left free on some."""
    words = B.read(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "word"))
    slot = F.pmod(F.col("pos"), F.lit(8))
    wide = F.col("doc_id") % 3 == 0
    x0 = (slot * 12 + F.when(wide & (slot >= 4), F.lit(4)).otherwise(F.lit(0))).cast("double")
    return words.select(
        F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), x0.alias("x0"),
        (x0 + F.least(F.length("word"), F.lit(9))).alias("x1"), F.lit(100.0).alias("width"))


_GUTTERS = """WITH w0 AS (SELECT doc_id, unnest(regexp_split_to_array(trim(text), '\\s+')) AS word,
                  generate_subscripts(regexp_split_to_array(trim(text), '\\s+'), 1) - 1 AS pos FROM documents),
    w AS (SELECT doc_id, x0, x0 + least(length(word), 9) AS x1 FROM (
            SELECT *, (pos % 8) * 12 + CASE WHEN doc_id % 3 = 0 AND pos % 8 >= 4 THEN 4 ELSE 0 END AS x0
            FROM w0)),
    tot AS (SELECT doc_id, count(*) AS words FROM w GROUP BY 1 HAVING count(*) >= 40),
    occ AS (SELECT doc_id, bin, count(*) AS n FROM (
              SELECT doc_id, unnest(generate_series(least(49, x0 // 2)::BIGINT, least(49, x1 // 2)::BIGINT)) AS bin
              FROM w) GROUP BY 1, 2),
    run AS (SELECT *, bin - lag(bin) OVER o - 1 AS gap,
              sum(n) OVER (PARTITION BY doc_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
              sum(n) OVER (PARTITION BY doc_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rt
            FROM occ WINDOW o AS (PARTITION BY doc_id ORDER BY bin))
    SELECT DISTINCT doc_id FROM run JOIN tot USING (doc_id)
    WHERE gap >= 3 AND l >= 0.15 * words AND rt >= 0.15 * words"""


@query("column_gutters", _GUTTERS)
def _(spark, sf):
    return EX.column_gutters(word_boxes(spark, sf)).select(F.col("document_id").alias("doc_id"))


@query("document_routes", f"""
    WITH gut AS (SELECT DISTINCT doc_id FROM ({_GUTTERS})),
    q AS (SELECT d.doc_id, coalesce(length(text), 0)::BIGINT AS char_count, d.doc_id % 2 = 0 AS pdf,
                 (g.doc_id IS NOT NULL)::INT::BIGINT AS multi_column_pages
          FROM documents d LEFT JOIN gut g ON g.doc_id = d.doc_id),
    f AS (SELECT *, char_count < {V.SCANNED_BELOW_CHARS} OR multi_column_pages > 0 AS needs_vision FROM q)
    SELECT doc_id, char_count, multi_column_pages, needs_vision,
           CASE WHEN needs_vision AND pdf AND char_count > 0 THEN 'hybrid' WHEN needs_vision AND pdf THEN 'vision'
                WHEN char_count > 0 THEN 'text' ELSE '' END AS route FROM f""")
def _(spark, sf):
    """The reading route of each document, with its pages' gutters."""
    pages = B.read(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), "text",
        F.when(F.col("doc_id") % 2 == 0, "pdf").otherwise("docx").alias("source"))
    q = EX.document_quality(pages, EX.column_gutters(word_boxes(spark, sf)))
    return q.select(
        F.col("document_id").alias("doc_id"), F.coalesce("char_count", F.lit(0)).alias("char_count"),
        "multi_column_pages", F.coalesce("needs_vision", F.lit(True)).alias("needs_vision"),
        F.coalesce("route", F.lit("")).alias("route"))


# --- Extraction metrics -----------------------------------------------------------------------
_SETS = """found AS (SELECT DISTINCT candidate_id AS case_id, name FROM candidate_skills WHERE years >= 2),
    expected AS (SELECT DISTINCT candidate_id AS case_id, name FROM candidate_skills WHERE uses >= 3),
    both_ AS (SELECT coalesce(f.case_id, e.case_id) AS case_id, coalesce(f.name, e.name) AS name,
                f.name IS NOT NULL AS p, e.name IS NOT NULL AS x
              FROM found f FULL JOIN expected e ON e.case_id = f.case_id AND e.name = f.name),
    prf AS (SELECT case_id, coalesce(hit / nullif(np, 0), 0) AS precision, coalesce(hit / nullif(nx, 0), 0)
              AS recall FROM (SELECT case_id, count(*) FILTER (WHERE p AND x)::DOUBLE AS hit,
                count(*) FILTER (WHERE p) AS np, count(*) FILTER (WHERE x) AS nx FROM both_ GROUP BY 1)),
    f1s AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)::DOUBLE AS f1 FROM prf)"""


def skill_sets(spark, sf):
    """Skills kept by years as found, by use as expected, per candidate."""
    s = B.staged(spark, sf, B.candidate_skills).withColumnRenamed("candidate_id", "case_id")
    return s.where("years >= 2"), s.where("uses >= 3")


@query("set_precision_recall", f"""
    WITH {_SETS} SELECT case_id, {r('precision')} AS precision, {r('recall')} AS recall,
    {r('f1')} AS f1 FROM f1s""", "candidate_skills")
def _(spark, sf):
    out = EX.compare_sets(*skill_sets(spark, sf), ["case_id"], "name")
    return out.select("case_id", *[rounded(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query("missed_and_invented", f"""
    WITH {_SETS} SELECT case_id, name, CASE WHEN x THEN 'missed' ELSE 'invented' END AS outcome
    FROM both_ WHERE p <> x""", "candidate_skills")
def _(spark, sf):
    return EX.missed_and_invented(*skill_sets(spark, sf), ["case_id"], "name")


@query("extraction_evaluation", f"""
    WITH {_SETS}, c AS (
      SELECT f1, case_id % 4 <> 0 AS verifiable, case_id % 7 AS spans, case_id % 3 AS anchored,
             total_experience_years AS yf, (case_id % 9)::DOUBLE AS ye,
             CASE WHEN case_id % 5 = 0 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS ident
      FROM f1s JOIN candidates ON candidate_id = case_id)
    SELECT {r('avg(ident)')} AS identity_accuracy, {r('avg(f1)')} AS skills_f1,
           {r('avg(coalesce(anchored::DOUBLE / nullif(spans, 0), 0)) FILTER (WHERE verifiable)')}
             AS evidence_anchored,
           {r('avg(abs(yf - ye))')} AS experience_years_mae,
           count(*) FILTER (WHERE NOT verifiable) AS cases_unverifiable FROM c""",
       "candidate_skills candidates")
def _(spark, sf):
    f1 = EX.compare_sets(*skill_sets(spark, sf), ["case_id"], "name").select(
        "case_id", F.col("f1").alias("skills_f1"))
    people = B.staged(spark, sf, B.candidates).select(
        F.col("candidate_id").alias("case_id"), "full_name", "email", "location", "headline",
        F.concat(F.lit("06"), F.col("candidate_id")).alias("phone"), "total_experience_years")
    off = F.col("case_id") % 5 == 0
    found = people.select(
        "case_id", F.upper("full_name").alias("full_name"),
        F.when(off, F.lit("other@example.org")).otherwise(F.upper("email")).alias("email"),
        F.concat(F.lit("+"), F.col("phone")).alias("phone"),
        F.when(off, F.lit("Elsewhere")).otherwise(F.col("location")).alias("location"),
        F.concat(F.lit("Senior "), "headline").alias("headline"))
    identity = EX.identity_accuracy(found, people)
    cases = f1.join(identity, "case_id").join(people, "case_id").select(
        "skills_f1", F.lit(1.0).alias("languages_f1"), "identity_accuracy",
        (F.col("case_id") % 4 != 0).alias("verifiable"), (F.col("case_id") % 7).alias("spans"),
        (F.col("case_id") % 3).alias("anchored"), F.col("total_experience_years").alias("years_found"),
        (F.col("case_id") % 9).cast("double").alias("years_expected"))
    agg = EX.extraction_aggregate(cases)
    names = ("identity_accuracy", "skills_f1", "evidence_anchored", "experience_years_mae")
    return agg.select(*[rounded(F.col(n)).alias(n) for n in names], "cases_unverifiable")


@query("evidence_confidence", f"""
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 0.4::DOUBLE
      WHEN l_linenumber = 2 THEN 0.3::DOUBLE ELSE least(1.0, l_quantity / 40.0) END AS confidence_raw
    FROM lineitem""")
def _(spark, sf):
    ratio = F.col("l_quantity") / 40
    kept = S.evidence_confidence(
        F.col("l_linenumber") != 1, F.col("l_linenumber") != 2, ratio)
    exact = F.when(F.col("l_linenumber") > 2, F.least(F.lit(1.0), ratio)).otherwise(kept)
    return B.read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", exact.alias("confidence_raw"))


@query("semantic_degrees", f"""
    SELECT doc_id, {r('''CASE WHEN c > 0.70 THEN least(0.80::DOUBLE, 0.80::DOUBLE * (c - 0.70::DOUBLE)
      / 0.30::DOUBLE) ELSE 0 END''')} AS degree FROM (
      SELECT doc_id, (n_chars % 1000) / 1000.0::DOUBLE AS c FROM documents)""")
def _(spark, sf):
    cosine = (F.col("n_chars") % 1000) / 1000
    return B.read(spark, sf, "documents").select(
        "doc_id", rounded(S.semantic_degree(cosine)).alias("degree"))


@query("weight_normalisation")
def _(spark, sf):
    """Weights typed per supplier, clamped and scaled to sum exactly 1."""
    raw = F.create_map(
        F.lit("skills"), F.col("s_acctbal") / 1000, F.lit("experience"), F.col("s_nationkey") / 7,
        F.lit("location"), F.lit(-1.0))
    w = B.read(spark, sf, "supplier").select("s_suppkey", WT.normalise(raw).alias("w"))
    return w.select("s_suppkey", "w.*")


# --- Counterfactual ---------------------------------------------------------------------------
@query("single_lever_gains")
def _(spark, sf):
    return CF.single_lever_gains(CF.lever_rows(B.tables(spark, sf), B.REF_YEAR))


@query("greedy_path")
def _(spark, sf):
    path = CF.greedy_path(CF.lever_rows(B.tables(spark, sf), B.REF_YEAR))
    return path.withColumn("steps", F.to_json("steps"))


# --- Streaming -----------------------------------------------------------------------------------
def _stream(spark, sf):
    return ST.event_stream(spark, sf, "events", B.read(spark, sf, "events").schema)


def _calls_of(events):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        F.col("ts").cast("timestamp").alias("created_at"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        (k * 10).alias("prompt_tokens"), F.floor("value").alias("completion_tokens"))


@query("stream_daily_volume", """
    SELECT strftime(created_at::DATE, '%Y-%m-%d') AS day, count(*) AS calls,
           count(*) FILTER (WHERE status <> 'ok') AS failures,
           sum(prompt_tokens)::BIGINT AS tokens_in, sum(completion_tokens)::BIGINT AS tokens_out
    FROM invocations GROUP BY 1""", "invocations")
def _(spark, sf):
    rows = ST.drain(_calls_of(_stream(spark, sf)), "volume", ST.daily_volume)
    return ST.merged_volume(rows).withColumn("day", day("day"))


@query("stream_content_dedup", """
    SELECT sha256(json_extract(props, '$.k')::BIGINT || '/' || event_type) AS content_hash,
           strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS arrived_at FROM events GROUP BY 1""")
def _(spark, sf):
    docs = _stream(spark, sf).select(
        F.col("ts").cast("timestamp").alias("arrived_at"),
        F.sha2(F.concat_ws("/", F.get_json_object("props", "$.k"), "event_type"), 256)
        .alias("content_hash"))
    rows = ST.first_contents(ST.drain(ST.first_contents(docs), "contents", mode="update"))
    return rows.select("content_hash", F.date_format("arrived_at", "yyyy-MM-dd HH:mm:ss").alias("arrived_at"))


@query("stream_last_decisions", "SELECT actor, object_id, stage FROM last_decisions",
       "last_decisions")
def _(spark, sf):
    stages = F.when(F.col("event_type") == "error", "rejected").when(
        F.col("event_type") == "signup", "withdrawn").otherwise(F.col("event_type"))
    decisions = _stream(spark, sf).select(
        F.col("user_id").alias("actor"),
        F.get_json_object("props", "$.k").cast("bigint").alias("object_id"),
        F.col("ts").cast("timestamp").alias("created_at"), "event_id", stages.alias("stage"))
    rows = ST.drain(decisions, "decisions", ST.last_decisions)
    return ST.last_decisions(rows).select("actor", "object_id", "stage")


@query("stream_drift_alerts", """
    WITH readings AS (
      SELECT event_type AS dimension, d AS read_at, floor(min(v) / max(v) * 1000) / 1000 AS ratio FROM (
        SELECT event_type, ts::DATE AS d, sum(value) AS v FROM events GROUP BY 1, 2, user_id % 3)
      GROUP BY 1, 2),
    h AS (SELECT *, lag(ratio) OVER (PARTITION BY dimension ORDER BY read_at) AS previous FROM readings)
    SELECT dimension, strftime(read_at, '%Y-%m-%d') AS read_at, ratio,
           CASE WHEN ratio < 0.80 THEN 'legal_gap'
                WHEN previous IS NOT NULL AND previous - ratio >= 0.05 THEN 'drift' ELSE '' END AS alert
    FROM h""")
def _(spark, sf):
    folder = work_path(spark, "readings")
    readings(spark, sf).write.parquet(folder)
    stream = spark.readStream.schema("dimension string, read_at date, ratio double").parquet(folder)
    return ST.merged_readings(ST.drain(ST.watched_readings(stream), "alerts", mode="update")).select("dimension", day("read_at").alias("read_at"), "ratio", "alert")


@query("stream_scored_applications", f"""
    SELECT application_id, {r('overall', 4)} AS overall FROM scores""", "scores")
def _(spark, sf):
    """Applications arrive as files and are scored against the static tables."""
    folder = work_path(spark, "arrivals")
    B.staged(spark, sf, B.applications).write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    score = ST.scored_arrivals(lambda: B.tables(spark, sf), B.REF_YEAR)
    rows = ST.drain(spark.readStream.schema(schema).parquet(folder), "scored", lambda batch: score(batch).select(
        "application_id", rounded(F.col("overall"), 4).alias("overall")))
    return rows.select("application_id", "overall")
