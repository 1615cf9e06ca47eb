"""Text queries: search, vectors, linkage, evidence, extraction, ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolewise import fixed_values as V
from rolewise.functions import scores as S
from rolewise.functions import text as T
from rolewise.functions import vectors as VX
from rolewise.operators import evidence as EV
from rolewise.operators import linkage as LK
from rolewise.operators import metrics as M
from rolewise.operators import redirect as RD
from rolewise.operators import search as SE
from rolewise.operators import text_index as TI
from rolewise.operators import vector_index as VI
from rolewise.plans import bindings as B
from rolewise.plans.queries_scoring import graded
from rolewise.plans.registry import query, rounded, sql_rounded as r
from rolewise.plans.sql_views import sql_fold
from rolewise.session import cut_lineage, work_path

_STOP = ", ".join(f"'{w}'" for w in V.STOP_WORDS)


def sql_tokens(source: str, key: str) -> str:
    """(key, term) rows of a table with a text column."""
    return f"""
      SELECT {key}, piece AS term FROM (
        SELECT {key}, unnest(CASE WHEN contains(t, '-') THEN list_prepend(t, string_split(t, '-'))
                             ELSE [t] END) AS piece FROM (
          SELECT {key}, regexp_replace(raw, '^[.-]+|[.-]+$', '', 'g') AS t FROM (
            SELECT {key}, unnest(regexp_extract_all({sql_fold('text')}, '[a-z0-9+#.-]+')) AS raw
            FROM {source})))
      WHERE length(piece) >= 2 AND piece NOT IN ({_STOP})"""


_BM25 = f"""tok AS ({sql_tokens('documents', 'doc_id')}),
    len AS (SELECT doc_id, count(term) AS dl FROM documents LEFT JOIN tok USING (doc_id) GROUP BY 1),
    corpus AS (SELECT count(*) AS n, avg(dl) AS mean FROM len),
    qt AS (SELECT query_id, term, count(*) AS w FROM (
             {sql_tokens('(SELECT item_id AS query_id, text FROM benchmark)', 'query_id')}) GROUP BY 1, 2),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM tok SEMI JOIN qt USING (term) GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    bm AS (
      SELECT query_id, doc_id, floor(sum(w * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
               * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * greatest(dl, 1) / mean)))
               * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE AS score
      FROM qt JOIN df USING (term) JOIN tf USING (term) JOIN len USING (doc_id) CROSS JOIN corpus
      GROUP BY 1, 2),
    lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
            FROM bm WHERE score > 0)"""
_VEC = """nv AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    un AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS nn FROM nv),
    sim AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id,
              floor(list_inner_product(q.e, d.e) / (q.nn * d.nn) * 1e9::DOUBLE + 0.5::DOUBLE)
                / 1e9::DOUBLE AS score
            FROM un q JOIN un d ON true WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
    near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
             FROM sim)"""
_RRF = """fused AS (
      SELECT query_id, doc_id, floor(sum(1.0::DOUBLE / (60 + rank)) * 1e9::DOUBLE + 0.5::DOUBLE)
               / 1e9::DOUBLE AS score,
             string_agg(DISTINCT method, '+' ORDER BY method) AS method FROM (
        SELECT query_id, doc_id, rank, 'bm25' AS method FROM lex WHERE rank <= 20
        UNION ALL SELECT query_id, doc_id, rank, 'vector' FROM near WHERE rank <= 20) GROUP BY 1, 2),
    hyb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
              ORDER BY score DESC, doc_id) AS rank FROM fused) WHERE rank <= 10)"""


def docs(spark, sf):
    return B.read_texts(spark, sf, "documents").select("doc_id", "text")


def asks(spark, sf):
    """Benchmark passages as queries, with the vector of the same number."""
    items = B.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    vectors = B.read(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return items.join(vectors, "query_id", "left")


def vecs(spark, sf):
    return B.read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


@query("tokenised_documents", f"""
    WITH tok AS ({sql_tokens('documents', 'doc_id')})
    SELECT term, count(*) AS uses, count(DISTINCT doc_id) AS documents FROM tok GROUP BY 1""")
def _(spark, sf):
    terms = docs(spark, sf).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    per_doc = terms.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("term").agg(
        F.sum("n").alias("uses"), F.count("*").alias("documents"))


@query("bm25_search", f"""
    WITH {_BM25} SELECT query_id, doc_id, rank, {r('score', 5)} AS score FROM lex WHERE rank <= 10""")
def _(spark, sf):
    hits = SE.bm25(docs(spark, sf), asks(spark, sf), 10)
    return hits.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"),
                       rounded(F.col("score"), 5).alias("score"))


@query("bm25_index_search", f"""
    WITH {_BM25} SELECT query_id, doc_id, rank, {r('score', 5)} AS score FROM lex WHERE rank <= 10""")
def _(spark, sf):
    """The same lists from a stored index, filled by two batches."""
    path = work_path(spark, "text-index")
    for batch in (0, 1):
        TI.append(docs(spark, sf).where(F.pmod("doc_id", F.lit(2)) == batch), path, batch)
    hits = TI.search(spark, path, asks(spark, sf), 10)
    return hits.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"),
                       rounded(F.col("score"), 5).alias("score"))


@query("vector_top_k", f"""
    WITH {_VEC} SELECT query_id, doc_id, rank, {r('score + 1', 5)} AS score_plus_one
    FROM near WHERE rank <= 10""")
def _(spark, sf):
    hits = SE.vector_top_k(vecs(spark, sf), asks(spark, sf), 10)
    return hits.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"),
                       rounded(F.col("score") + 1, 5).alias("score_plus_one"))


def hundredths(spark, sf):
    """The vectors whose id is divisible by 100, as queries."""
    return vecs(spark, sf).where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "embedding")


@query("vector_index_search")
def _(spark, sf):
    """Ten neighbours of every hundredth vector through the index."""
    index, asked = VI.build(vecs(spark, sf)), hundredths(spark, sf)
    hits = VI.search(index, asked, 10, VI.probes_for(index, asked, 10, 0.95))
    return hits.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), rounded(F.col("score"), 5).alias("score"))


@query("hybrid_search", f"""
    WITH {_BM25}, {_VEC}, {_RRF}
    SELECT query_id, doc_id, rank, method, {r('score')} AS score FROM hyb""")
def _(spark, sf):
    hits = SE.search(docs(spark, sf), asks(spark, sf), vecs(spark, sf), 10)
    return hits.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), "method",
                       rounded(F.col("score")).alias("score"))


@query("vector_norms_and_labels", f"""
    SELECT vec_id, label, {r('sqrt(list_inner_product(e, e))', 5)} AS norm FROM (
      SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)""")
def _(spark, sf):
    return B.read(spark, sf, "embeddings").select(
        "vec_id", "label", rounded(VX.norm(F.col("embedding")), 5).alias("norm"))


@query("semantic_separability", """
    WITH nv AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    pairs AS (SELECT a.label = b.label AS near, list_inner_product(a.e, b.e)
                / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) AS c
              FROM nv a JOIN nv b ON b.vec_id = a.vec_id + 1)
    SELECT floor((min(c) FILTER (WHERE near) + 1) * 1e5::DOUBLE + 0.5::DOUBLE) / 1e5::DOUBLE
             AS lowest_near,
           floor((max(c) FILTER (WHERE NOT near) + 1) * 1e5::DOUBLE + 0.5::DOUBLE) / 1e5::DOUBLE
             AS highest_unrelated,
           min(c) FILTER (WHERE near) > max(c) FILTER (WHERE NOT near) AS separable FROM pairs""")
def _(spark, sf):
    e = B.read(spark, sf, "embeddings")
    a = e.select("vec_id", F.col("label").alias("la"), F.col("embedding").alias("ea"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("lb"),
                 F.col("embedding").alias("eb"))
    pairs = a.join(b, "vec_id").select(
        F.when(F.col("la") == F.col("lb"), "near").otherwise("unrelated").alias("kind"),
        VX.cosine(F.col("ea"), F.col("eb")).alias("cosine"))
    s = SE.separability(pairs)
    grid = lambda c: F.floor((F.col(c) + 1) * 1e5 + 0.5) / 1e5
    return s.select(grid("lowest_near").alias("lowest_near"),
                    grid("highest_unrelated").alias("highest_unrelated"), "separable")


# Passages that occur in a document as they are: relevant by construction.
_RELEVANT = f"""nd AS (SELECT doc_id, ltrim(regexp_replace({sql_fold('text')}, '\\s+', ' ', 'g')) AS h
                  FROM documents),
    nb AS (SELECT item_id, trim(regexp_replace({sql_fold('trim(text)')}, '\\s+', ' ', 'g')) AS q
           FROM benchmark),
    rel AS (SELECT item_id AS query_id, doc_id FROM nb JOIN nd ON q <> '' AND contains(h, q))"""


def relevant(spark, sf):
    """Documents holding a whole passage."""
    passages = B.read(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.rtrim(EV.normalised(F.trim("text"))).alias("needle"))
    texts = docs(spark, sf).select("doc_id", EV.normalised(F.col("text")).alias("haystack"))
    return SE.holding(passages, texts)


_PER_QUERY = """pq AS (
      SELECT b.item_id AS query_id, coalesce(h.returned, 0) AS returned, coalesce(w.wanted, 0) AS wanted,
             coalesce(h.f5, 0) AS f5, coalesce(h.f3, 0) AS f3, coalesce(h.t3, 0) AS t3, h.fg
      FROM benchmark b LEFT JOIN (
        SELECT l.query_id, count(*) AS returned,
               count(*) FILTER (WHERE rel.doc_id IS NOT NULL AND rank <= 5) AS f5,
               count(*) FILTER (WHERE rel.doc_id IS NOT NULL AND rank <= 3) AS f3,
               count(*) FILTER (WHERE rank <= 3) AS t3,
               min(rank) FILTER (WHERE rel.doc_id IS NOT NULL) AS fg
        FROM {hits} l LEFT JOIN rel ON rel.query_id = l.query_id AND rel.doc_id = l.doc_id
        WHERE rank <= 10 GROUP BY 1) h ON h.query_id = b.item_id
      LEFT JOIN (SELECT query_id, count(DISTINCT doc_id) AS wanted FROM rel GROUP BY 1) w
        ON w.query_id = b.item_id),
    m AS (SELECT query_id, wanted = 0 AS expects_nothing, returned = 0 AS answered_nothing,
             CASE WHEN wanted = 0 THEN 1.0::DOUBLE ELSE f5::DOUBLE / wanted END AS recall_at_5,
             CASE WHEN wanted = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 5.0::DOUBLE / wanted) END
               AS recall_at_5_ceiling,
             coalesce(f3::DOUBLE / nullif(t3, 0), 0)::DOUBLE AS precision_at_3,
             coalesce(1.0::DOUBLE / fg, 0)::DOUBLE AS reciprocal_rank FROM pq)"""


@query("search_metrics_per_query", f"""
    WITH {_BM25}, {_RELEVANT}, {_PER_QUERY.format(hits='lex')}
    SELECT query_id, {r('recall_at_5')} AS recall_at_5, {r('recall_at_5_ceiling')}
      AS recall_at_5_ceiling, {r('precision_at_3')} AS precision_at_3, {r('reciprocal_rank')}
      AS reciprocal_rank, expects_nothing, answered_nothing FROM m""")
def _(spark, sf):
    hits = SE.bm25(docs(spark, sf), asks(spark, sf), 10)
    m = M.search_metrics(hits, cut_lineage(relevant(spark, sf)), asks(spark, sf))
    names = ("recall_at_5", "recall_at_5_ceiling", "precision_at_3", "reciprocal_rank")
    return m.select("query_id", *[rounded(F.col(n)).alias(n) for n in names],
                    "expects_nothing", "answered_nothing")


_AGG = """SELECT '{0}' AS mode,
      avg(recall_at_5) FILTER (WHERE NOT expects_nothing) AS recall_at_5,
      avg(recall_at_5_ceiling) FILTER (WHERE NOT expects_nothing) AS recall_at_5_ceiling,
      avg(reciprocal_rank) FILTER (WHERE NOT expects_nothing) AS mrr,
      avg(precision_at_3) FILTER (WHERE NOT expects_nothing) AS precision_at_3,
      count(*) FILTER (WHERE expects_nothing AND answered_nothing)::DOUBLE
        / greatest(1, count(*) FILTER (WHERE expects_nothing)) AS empty_queries_handled FROM {1}"""
_NAMES = ("recall_at_5", "recall_at_5_ceiling", "mrr", "precision_at_3", "empty_queries_handled")


@query("search_evaluation", f"""
    WITH {_BM25}, {_VEC}, {_RRF}, {_RELEVANT}, {_PER_QUERY.format(hits='lex')},
    {_PER_QUERY.format(hits='hyb').replace('pq AS', 'pq2 AS').replace('FROM pq)', 'FROM pq2)')
        .replace('m AS (SELECT', 'm2 AS (SELECT')},
    a AS ({_AGG.format('lexical', 'm')} UNION ALL {_AGG.format('hybrid', 'm2')})
    SELECT mode, {', '.join(f'{r(n)} AS {n}' for n in _NAMES)} FROM a""")
def _(spark, sf):
    questions, truth = asks(spark, sf), cut_lineage(relevant(spark, sf))
    first = cut_lineage(SE.bm25(docs(spark, sf), questions, 20).select("query_id", "doc_id", "rank"))
    lexical = first.where("rank <= 10")
    hybrid = cut_lineage(SE.search(docs(spark, sf), questions, vecs(spark, sf), 10, first))
    rows = None
    for mode, hits in (("lexical", lexical), ("hybrid", hybrid)):
        one = M.search_aggregate(M.search_metrics(hits, truth, questions)).withColumn(
            "mode", F.lit(mode))
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("mode", *[rounded(F.col(n)).alias(n) for n in _NAMES])


# --- Linkage ------------------------------------------------------------------------------
_LINKS = f"""rec AS (
      SELECT doc_id AS record_id, regexp_extract(text, '[\\w.+-]+@[\\w-]+\\.[\\w.]+') AS email,
             regexp_extract(text, '\\+\\d[\\d ().-]{{7,15}}\\d') AS phone0,
             sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS name, source
      FROM documents),
    re AS (SELECT *, CASE WHEN length(regexp_replace(phone0, '\\D', '', 'g')) >= 9
                     THEN right(regexp_replace(phone0, '\\D', '', 'g'), 9) ELSE '' END AS phone FROM rec),
    pr0 AS (
      SELECT a.record_id AS a, b.record_id AS b, lower(a.email) = lower(b.email) AND a.email <> '' AS e,
             a.phone = b.phone AND a.phone <> '' AS p, a.name = b.name AS n, a.source = b.source AS c
      FROM re a JOIN re b ON a.record_id < b.record_id AND (
        (a.email <> '' AND lower(a.email) = lower(b.email)) OR (a.phone <> '' AND a.phone = b.phone)
        OR a.name = b.name)),
    pr AS (SELECT *, least(1.0, CASE WHEN e THEN 0.70 ELSE 0 END + CASE WHEN p THEN 0.55 ELSE 0 END
                     + CASE WHEN n THEN 0.30 ELSE 0 END + CASE WHEN c THEN 0.25 ELSE 0 END)::DOUBLE AS conf
           FROM pr0),
    ok AS (SELECT * FROM pr WHERE conf >= 0.55)"""
_GROUPS = """, und AS (SELECT a, b FROM ok UNION SELECT b, a FROM ok),
    walk(node, seen) AS (SELECT a, a FROM und UNION SELECT w.node, u.b FROM walk w JOIN und u ON u.a = w.seen),
    comp AS (SELECT node AS record_id, min(seen) AS group_id FROM walk GROUP BY 1),
    ev AS (SELECT group_id, max(conf) AS confidence, bool_or(e) AS e, bool_or(p) AS p, bool_or(n) AS n,
             bool_or(c) AS c FROM ok JOIN comp ON comp.record_id = ok.a GROUP BY 1)"""


def link_records(spark, sf):
    base = B.linkage_records(spark, sf)
    return base.select(
        "record_id", F.lower("email").alias("email"), T.phone_key(F.col("phone")).alias("phone"),
        F.col("name_key").alias("name"), F.array(T.fold_key(F.col("company"))).alias("careers"))


@query("duplicate_links", f"""
    WITH {_LINKS}, k AS (
      SELECT 'email' AS rule, lower(email) AS key, record_id FROM re WHERE email <> ''
      UNION ALL SELECT 'phone', phone, record_id FROM re WHERE phone <> ''
      UNION ALL SELECT 'name+career', name || source, record_id FROM re)
    SELECT rule, record_id, hub_id FROM (
      SELECT rule, record_id, min(record_id) OVER (PARTITION BY rule, key) AS hub_id FROM k)
    WHERE record_id <> hub_id""")
def _(spark, sf):
    rows = LK.stars(LK.blocks(link_records(spark, sf)))
    return rows.where(F.col("rule").isin("email", "phone", "name+career")).where(
        "record_id <> hub_id").select("rule", "record_id", "hub_id")


@query("entity_resolution", f"""
    WITH RECURSIVE {_LINKS}{_GROUPS}
    SELECT record_id, group_id, {r('confidence', 4)} AS confidence,
           concat_ws(',', CASE WHEN c THEN 'career' END, CASE WHEN e THEN 'email' END,
                     CASE WHEN n THEN 'name' END, CASE WHEN p THEN 'phone' END) AS reasons
    FROM comp JOIN ev USING (group_id)""")
def _(spark, sf):
    res = LK.resolve_entities(link_records(spark, sf))
    return res.withColumn("confidence", rounded(F.col("confidence"), 4))


@query("duplicate_statistics", f"""
    WITH RECURSIVE {_LINKS}{_GROUPS}
    SELECT count(DISTINCT group_id) AS groups, count(*) AS records,
           count(DISTINCT group_id) FILTER (WHERE confidence >= 0.9) AS certain
    FROM comp JOIN ev USING (group_id)""")
def _(spark, sf):
    return LK.group_statistics(LK.resolve_entities(link_records(spark, sf)))


# --- Merge ----------------------------------------------------------------------------------
_SAME = "c_nationkey || '|' || c_mktsegment || '|' || floor(c_acctbal / 100)::BIGINT"
_MERGE = f"""grp AS (
      SELECT candidate_id, created_at, {_SAME} AS k FROM candidates JOIN customer ON c_custkey = candidate_id),
    big AS (SELECT * FROM grp WHERE k IN (SELECT k FROM grp GROUP BY 1 HAVING count(*) > 1)),
    moved AS (SELECT candidate_id, first_value(candidate_id) OVER w AS primary_id, row_number() OVER w AS seq
              FROM big WINDOW w AS (PARTITION BY k ORDER BY created_at, candidate_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def merge_groups(spark, sf):
    """Customers alike in nation, segment and balance band stand for one person."""
    customer = B.read(spark, sf, "customer")
    key = F.concat_ws("|", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 100))
    keyed = customer.select(F.col("c_custkey").alias("record_id"), key.alias("k"))
    sized = keyed.groupBy("k").agg(F.min("record_id").alias("group_id"), F.count("*").alias("n"))
    groups = keyed.join(sized.where("n > 1"), "k").select("record_id", "group_id")
    records = B.staged(spark, sf, B.candidates).select(F.col("candidate_id").alias("record_id"), "created_at")
    return cut_lineage(LK.survivors(groups, records))


@query("merge_skills", f"""
    WITH {_MERGE} SELECT primary_id, name, max(years) AS years, max(last_used_year) AS last_used_year
    FROM candidate_skills JOIN moved USING (candidate_id) GROUP BY 1, 2""",
       "candidates candidate_skills")
def _(spark, sf):
    return LK.merge_skills(B.staged(spark, sf, B.candidate_skills), merge_groups(spark, sf))


@query("merge_languages", f"""
    WITH {_MERGE} SELECT primary_id, arg_min(language, (seq, language, level)) AS language,
           arg_min(level, (seq, language, level)) AS level
    FROM candidate_languages JOIN moved USING (candidate_id) GROUP BY primary_id, lower(trim(language))""",
       "candidates candidate_languages")
def _(spark, sf):
    return LK.merge_languages(B.staged(spark, sf, B.candidate_languages), merge_groups(spark, sf))


@query("merge_applications", f"""
    WITH {_MERGE} SELECT primary_id, offer_id, application_id, stage FROM (
      SELECT primary_id, offer_id, application_id, stage, row_number() OVER (
        PARTITION BY primary_id, offer_id ORDER BY list_position({list(V.STAGE_ORDER)}, stage) DESC, seq)
        AS rn FROM applications JOIN moved USING (candidate_id)) WHERE rn = 1""",
       "candidates applications")
def _(spark, sf):
    return LK.merge_applications(B.staged(spark, sf, B.applications), merge_groups(spark, sf))


@query("merge_fields", f"""
    WITH {_MERGE} SELECT primary_id, arg_min(full_name, seq) AS full_name,
           max(highest_education) AS highest_education,
           strftime(max(retention_until), '%Y-%m-%d') AS retention_until
    FROM candidates JOIN moved USING (candidate_id) GROUP BY 1""", "candidates")
def _(spark, sf):
    m = LK.merge_fields(B.staged(spark, sf, B.candidates), merge_groups(spark, sf), ("full_name",),
                        ("highest_education", "retention_until"))
    return m.withColumn("retention_until", F.date_format("retention_until", "yyyy-MM-dd"))


@query("merge_reparented_experiences", f"""
    WITH {_MERGE} SELECT experience_id, coalesce(primary_id, e.candidate_id) AS candidate_id
    FROM experiences e LEFT JOIN moved USING (candidate_id)""", "candidates experiences")
def _(spark, sf):
    return LK.reparent(B.staged(spark, sf, B.experiences), merge_groups(spark, sf)).select(
        "experience_id", "candidate_id")


# --- Evidence ---------------------------------------------------------------------------------
def _last_words(text, n):
    words = F.split(text, " ")
    return F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - n + 1), n), " ")


def quotes(spark, sf):
    """The quotes as a stored table, as a deployment has them."""
    return cut_lineage(made_quotes(spark, sf), "quotes")


def made_quotes(spark, sf):
    """Four quotes per document: exact, broken, one word, and a foreign passage."""
    passages = B.read(spark, sf, "benchmark").select(
        F.col("item_id").alias("pick"), F.col("text").alias("foreign"))
    many = passages.agg(F.count("*")).scalar()
    d = docs(spark, sf).withColumn("pick", F.pmod(F.col("doc_id"), many)).join(passages, "pick", "left")
    parts = F.filter(F.split("text", r"[\n.;]+"), lambda p: F.length(F.trim(p)) >= 12)
    made = F.array(
        F.struct(F.lit(1).alias("kind"), F.lower(F.try_element_at(parts, F.lit(1))).alias("quote")),
        F.struct(F.lit(2).alias("kind"), F.concat(
            _last_words(F.try_element_at(parts, F.lit(-1)), 40), F.lit(" xqz")).alias("quote")),
        F.struct(F.lit(3).alias("kind"), F.element_at(F.split("text", r"\s+"), 1).alias("quote")),
        F.struct(F.lit(4).alias("kind"), F.col("foreign").alias("quote")))
    return d.select(F.col("doc_id").alias("document_id"), F.explode(made).alias("q")).select(
        (F.col("document_id") * 4 + F.col("q.kind") - 1).alias("quote_id"), "document_id",
        F.col("q.quote").alias("quote")).where("quote IS NOT NULL")


def quote_pages(spark, sf):
    return docs(spark, sf).select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), "text")


_WORD_CHAR = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
_QUOTES = rf"""
    parts AS (SELECT doc_id, text, [p FOR p IN regexp_split_to_array(text, '[\n.;]+')
                     IF length(trim(p)) >= 12] AS ps, regexp_split_to_array(text, '\s+')[1] AS w
              FROM documents),
    q0 AS (SELECT doc_id, 0 AS k, lower(ps[1]) AS quote FROM parts
           UNION ALL SELECT doc_id, 1, array_to_string(string_split(ps[-1], ' ')[-40:], ' ') || ' xqz' FROM parts
           UNION ALL SELECT doc_id, 2, w FROM parts
           UNION ALL SELECT doc_id, 3, b.text FROM parts p JOIN benchmark b ON item_id = doc_id % (SELECT count(*) FROM benchmark)),
    asked AS (SELECT doc_id * 4 + k AS quote_id, doc_id AS document_id,
                     regexp_replace(quote, '^{EV.SPACES}+|{EV.SPACES}+$', '', 'g') AS quote
              FROM q0 WHERE quote IS NOT NULL),
    hay AS (SELECT doc_id AS document_id, text,
                   ltrim(regexp_replace({sql_fold('text')}, '{EV.SPACES}+', ' ', 'g')) AS hay FROM documents WHERE text IS NOT NULL),
    q AS (SELECT quote_id, document_id, hay, ltrim(regexp_replace({sql_fold('quote')}, '{EV.SPACES}+', ' ', 'g')) AS needle
          FROM asked JOIN hay USING (document_id) WHERE length(quote) >= 3),
    tier AS (
      SELECT *, length(needle) < 12 AS short, CASE WHEN length(needle) >= 12 THEN instr(hay, needle)
        WHEN regexp_matches(hay, '(^|[^{_WORD_CHAR}])' || regexp_escape(needle) || '($|[^{_WORD_CHAR}])')
        THEN length(regexp_extract(hay, '(?s)^(.*?(?:^|[^{_WORD_CHAR}]))' || regexp_escape(needle) || '(?:$|[^{_WORD_CHAR}])', 1)) + 1
        ELSE 0 END AS pos
      FROM q WHERE needle <> '')"""
# What no tier holds: starts from which enough characters stand on the page, then the longest from each.
_ANCHORED = rf"""{_QUOTES},
    starts AS (
      SELECT *, ceil(0.6 * length(needle))::INT AS least,
             list_filter(generate_series(1, length(needle) - ceil(0.6 * length(needle))::INT + 1),
                         lambda i: contains(hay, substr(needle, i, ceil(0.6 * length(needle))::INT))) AS firsts
      FROM tier WHERE pos = 0 AND NOT short),
    halves AS (
      SELECT quote_id, least AS lo, length(needle) AS hi FROM starts WHERE len(firsts) > 0
      UNION ALL
      SELECT quote_id, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid - 1 END FROM (
        SELECT h.*, (lo + hi + 1) // 2 AS mid,
               len(list_filter(firsts, lambda i: i + (lo + hi + 1) // 2 <= length(needle) + 1
                               AND contains(hay, substr(needle, i, (lo + hi + 1) // 2)))) > 0 AS ok
        FROM halves h JOIN starts USING (quote_id) WHERE lo < hi)),
    part AS (
      SELECT quote_id, struct_pack(size := lo, pos := list_min(list_filter(
               list_transform(firsts, lambda i: CASE WHEN i + lo <= length(needle) + 1
                              THEN instr(hay, substr(needle, i, lo)) ELSE 0 END), lambda x: x > 0))) AS b
      FROM halves JOIN starts USING (quote_id) WHERE lo = hi),
    placed AS (
      SELECT quote_id, pos, length(needle) AS size, CASE WHEN short THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS ratio
      FROM tier WHERE pos > 0
      UNION ALL SELECT quote_id, b.pos, b.size, b.size / length(needle)::DOUBLE FROM part JOIN tier USING (quote_id)),
    letters AS (SELECT document_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i
                FROM (SELECT document_id, string_split(text, '') AS cs FROM hay)),
    marked AS (SELECT document_id, i, c, regexp_full_match(c, '{EV.SPACES}') AS blank FROM letters),
    kept AS (
      SELECT document_id, any_value(text) AS text, list(i ORDER BY i) AS origin FROM (
        SELECT *, lag(blank, 1, true) OVER (PARTITION BY document_id ORDER BY i) AS after_blank FROM marked)
      JOIN hay USING (document_id)
      WHERE NOT (blank AND after_blank) AND NOT regexp_full_match(c, '[\x{{300}}-\x{{36F}}]') GROUP BY 1),
    anchored AS (
      SELECT quote_id, a.document_id, CASE WHEN p.pos IS NULL THEN NULL ELSE 1 END::INT AS page,
             coalesce({r('p.ratio', 3)}, 0)::DOUBLE AS ratio,
             (origin[p.pos] - 1)::INT AS char_start, CASE WHEN p.pos IS NOT NULL THEN origin[least(p.pos + p.size - 1, len(origin))] END::INT AS char_end,
             substr(text, origin[p.pos], origin[least(p.pos + p.size - 1, len(origin))] - origin[p.pos] + 1) AS text,
             coalesce(p.ratio, 0) >= 0.6 AS verified
      FROM asked a LEFT JOIN placed p USING (quote_id) LEFT JOIN kept k ON k.document_id = a.document_id)"""


@query("quote_exact_tiers", f"""
    WITH {_QUOTES}
    SELECT quote_id, CASE WHEN short THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS ratio FROM tier WHERE pos > 0""")
def _(spark, sf):
    return EV.exact_tiers(quotes(spark, sf), quote_pages(spark, sf)).select("quote_id", "ratio")


@query("quote_anchoring", f"""
    WITH RECURSIVE {_ANCHORED}
    SELECT quote_id, document_id, coalesce(page, 0) AS page, ratio, coalesce(char_start, -1) AS char_start,
           coalesce(char_end, -1) AS char_end, coalesce(text, '') AS text, verified FROM anchored""")
def _(spark, sf):
    missing = {"page": 0, "char_start": -1, "char_end": -1, "text": ""}
    return EV.anchor_quotes(quotes(spark, sf), quote_pages(spark, sf)).na.fill(missing)


@query("evidence_counts", f"""
    WITH RECURSIVE {_ANCHORED} SELECT document_id, count(*) FILTER (WHERE verified) AS verified, count(*) AS total
    FROM anchored GROUP BY 1""")
def _(spark, sf):
    return EV.evidence_counts(EV.anchor_quotes(quotes(spark, sf), quote_pages(spark, sf)))


@query("quote_confidence", f"""
    WITH RECURSIVE {_ANCHORED}
    SELECT quote_id, CASE WHEN length(quote) < 3 THEN 0.4::DOUBLE WHEN NOT verified THEN 0.3::DOUBLE
                          ELSE round_even(least(1.0::DOUBLE, ratio), 2) END AS confidence
    FROM anchored JOIN asked USING (quote_id)""")
def _(spark, sf):
    """Confidence that a quote lends to what was read from it."""
    asked = quotes(spark, sf)
    usable = F.length(EV.stripped(F.col("quote"))) >= V.EVIDENCE_MIN_LENGTH
    found = EV.anchor_quotes(asked, quote_pages(spark, sf)).join(
        asked.select("quote_id", usable.alias("usable")), "quote_id")
    return found.select("quote_id", S.evidence_confidence(
        F.col("usable"), F.col("verified"), F.col("ratio")).alias("confidence"))


# --- Redirection --------------------------------------------------------------------------------
def _current(spark, sf):
    return cut_lineage(graded(spark, sf).select(
        "application_id", "candidate_id", "offer_id", F.col("overall").alias("score")))


@query("offers_examined", """
    SELECT application_id, (SELECT count(*) FROM offers WHERE status = 'open')
           - (o.status = 'open')::INT AS offers_examined
    FROM applications JOIN offers o USING (offer_id)""", "applications offers")
def _(spark, sf):
    return RD.offers_examined(B.staged(spark, sf, B.applications), B.staged(spark, sf, B.offers))


# The SQL side scores every (candidate, open offer) pair through the same views
# with `applications` replaced by all pairs.
def _redirect_sql() -> str:
    from rolewise.plans.sql_views import VIEWS, _needs

    names, stack = set(), ["scores"]
    while stack:
        n = stack.pop()
        if n not in names:
            names.add(n)
            stack.extend(_needs(n))
    order = [n for n in VIEWS if n in names]
    ctes = [f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in order]
    swapped = {"applications", "skill_matches", "skill_scores", "language_scores",
               "certificate_scores", "criteria", "scores"}
    extra = []
    import re

    for n in order:
        if n not in swapped:
            continue
        if n == "applications":
            body = ("SELECT p.candidate_id, o.offer_id, p.candidate_id || '-' || o.offer_id "
                    "AS application_id FROM candidates p JOIN offers o ON o.status = 'open'")
        else:
            body = VIEWS[n]
            for s in swapped:
                body = re.sub(rf"(FROM|JOIN) {s}\b", rf"\1 all_{s}", body)
        extra.append(f"all_{n} AS MATERIALIZED ({body})")
    return f"""WITH {', '.join(ctes + extra)},
    cur AS (SELECT application_id, candidate_id, offer_id, {r('overall', 4)} AS score FROM scores),
    best AS (SELECT candidate_id, offer_id, {r('overall', 4)} AS new_score FROM all_scores),
    cand AS (SELECT c.application_id, c.candidate_id, b.offer_id AS suggested, b.new_score,
               row_number() OVER (PARTITION BY c.application_id ORDER BY b.new_score DESC, b.offer_id) AS rank
             FROM cur c JOIN best b ON b.candidate_id = c.candidate_id AND b.offer_id <> c.offer_id
             WHERE c.score < 0.75 AND b.new_score >= 0.75 AND c.application_id NOT IN (
               SELECT application_id FROM applications WHERE stage IN ('withdrawn', 'hired')))
    SELECT application_id, suggested, rank, new_score,
           (candidate_id || '-' || suggested) IN (SELECT application_id FROM applications)
             AS already_applied
    FROM cand WHERE rank <= 5"""


@query("redirection", _redirect_sql())
def _(spark, sf):
    out = RD.redirect(B.tables(spark, sf), _current(spark, sf), 0.75, B.REF_YEAR,
                      grid=lambda c: rounded(c, 4), cell=1e-4)
    return out.select("application_id", "suggested", F.col("rank").cast("long").alias("rank"),
                      "new_score", "already_applied")
