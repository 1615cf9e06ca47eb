"""Evaluation queries: metrics, calibration, bias, agreement, scenarios."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from rolewise import fixed_values as V
from rolewise.operators import agreement as AG
from rolewise.operators import bias as BI
from rolewise.operators import calibration as CA
from rolewise.operators import metrics as M
from rolewise.operators import ranking as R
from rolewise.operators import scenarios as SN
from rolewise.operators import scoring as SC
from rolewise.plans import bindings as B
from rolewise.plans.registry import day, query, rounded, sql_rounded as r
from rolewise.plans.sql_views import sql_place, sql_weighted
from rolewise.session import cut_lineage, work_path

GRID = lambda c: rounded(c, 4)
METRICS = ["ndcg_at_5", "precision_at_3", "pair_accuracy", "spearman"]

_NDCG = """
    SELECT case_id, coalesce(actual / nullif(ideal, 0), 0)::DOUBLE AS ndcg_at_5 FROM (
      SELECT case_id,
        sum(CASE WHEN rn <= 5 THEN relevance / (ln(rn + 1.0::DOUBLE) / ln(2.0::DOUBLE)) END) AS actual,
        sum(CASE WHEN ideal <= 5 THEN relevance / (ln(ideal + 1.0::DOUBLE) / ln(2.0::DOUBLE)) END)
          AS ideal
      FROM predicted GROUP BY 1)"""
_PREC = """
    SELECT case_id, CASE WHEN available = 0 THEN 1.0::DOUBLE
                         ELSE found::DOUBLE / least(3, available) END AS precision_at_3 FROM (
      SELECT case_id, count(*) FILTER (WHERE relevance >= 2) AS available,
             count(*) FILTER (WHERE relevance >= 2 AND rn <= 3) AS found
      FROM predicted GROUP BY 1)"""
_PAIR = """
    SELECT c.case_id, coalesce(p.accuracy, 1.0)::DOUBLE AS pair_accuracy
    FROM (SELECT DISTINCT case_id FROM predicted) c LEFT JOIN (
      SELECT a.case_id,
             sum(CASE WHEN a.relevance > b.relevance THEN 1 ELSE 0 END)::DOUBLE / count(*) AS accuracy
      FROM predicted a JOIN predicted b
        ON a.case_id = b.case_id AND a.rn < b.rn AND a.relevance <> b.relevance
      GROUP BY 1) p ON p.case_id = c.case_id"""
_SPEAR = """
    SELECT case_id, CASE WHEN count(*) < 2 THEN 1.0::DOUBLE
      WHEN var_pop(x) <= 0 OR var_pop(y) <= 0 THEN 0.0::DOUBLE ELSE corr(x, y) END AS spearman FROM (
      SELECT case_id,
        rank() OVER (PARTITION BY case_id ORDER BY score)
          + (count(*) OVER (PARTITION BY case_id, score) - 1) / 2.0::DOUBLE AS x,
        rank() OVER (PARTITION BY case_id ORDER BY relevance)
          + (count(*) OVER (PARTITION BY case_id, relevance) - 1) / 2.0::DOUBLE AS y
      FROM predicted) GROUP BY 1"""
_ALL = (f"ndcg AS ({_NDCG}), prec AS ({_PREC}), pair AS ({_PAIR}), spear AS ({_SPEAR}), "
        "per_case AS (SELECT * FROM ndcg JOIN prec USING (case_id) JOIN pair USING (case_id) "
        "JOIN spear USING (case_id))")


def _metric(name, sql, job):
    column = METRICS[("ndcg", "precision", "pair", "spearman").index(name.split("_")[0])]

    @query(name, f"SELECT case_id, {r(column)} AS {column} FROM ({sql})", "predicted")
    def _(spark, sf):
        return job(B.judgments(spark, sf)).select(
            "case_id", rounded(F.col(column)).alias(column))


_metric("ndcg_per_case", _NDCG, M.ndcg_at_k)
_metric("precision_per_case", _PREC, M.precision_at_k)
_metric("pair_accuracy_per_case", _PAIR, M.pair_accuracy)
_metric("spearman_per_case", _SPEAR, M.spearman)


@query("ranking_evaluation", f"""
    WITH {_ALL}, macro AS (
      SELECT 'ndcg_at_5' AS metric, avg(ndcg_at_5) AS value, 0.90::DOUBLE AS lim FROM per_case
      UNION ALL SELECT 'precision_at_3', avg(precision_at_3), 0.85 FROM per_case
      UNION ALL SELECT 'pair_accuracy', avg(pair_accuracy), 0.85 FROM per_case
      UNION ALL SELECT 'spearman', avg(spearman), 0.75 FROM per_case)
    SELECT metric, {r('value')} AS value, lim AS "limit", value < lim AS failed FROM macro""",
       "predicted")
def _(spark, sf):
    per_case = M.ranking_metrics(cut_lineage(B.judgments(spark, sf)))
    gated = M.against_minimums(M.macro_average(per_case, METRICS), V.RANKING_MINIMUMS)
    return gated.select("metric", rounded(F.col("value")).alias("value"), "limit", "failed")


# The earlier scoring: the same cases, scored by an engine that counts length more steeply.
_EARLIER = "floor(10000::DOUBLE * n_chars / (n_chars + 400 * (1 + item_id % 3))) / 10000::DOUBLE"


def _earlier_sql(text: str) -> str:
    for name in ("ndcg", "prec", "pair", "spear", "per_case"):
        text = re.sub(rf"\b{name}\b", f"{name}_then", text)
    return text.replace("FROM predicted", "FROM predicted_then").replace("JOIN predicted b", "JOIN predicted_then b")


@query("regression_against_baseline", f"""
    WITH then0 AS (SELECT j.* REPLACE ({_EARLIER} AS score) FROM judgments j JOIN documents d ON d.doc_id = j.item_id),
    predicted_then AS (
      SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, item_id) AS rn,
             row_number() OVER (PARTITION BY case_id ORDER BY relevance DESC, item_id) AS ideal FROM then0),
    {_ALL}, {_earlier_sql(_ALL)}
    SELECT metric, {r('value')} AS value, {r('baseline')} AS baseline,
           {r('value - baseline + 1')} AS delta_plus_one, value - baseline < -0.01 AS regressed
    FROM ({' UNION ALL '.join(
        f"SELECT '{m}' AS metric, (SELECT avg({m}) FROM per_case) AS value,"
        f" (SELECT avg({m}) FROM per_case_then) AS baseline" for m in METRICS)})""", "predicted judgments")
def _(spark, sf):
    judged = cut_lineage(B.judgments(spark, sf))
    lengths = B.read(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "n_chars")
    steeper = F.floor(10000 * F.col("n_chars") / (F.col("n_chars") + 400 * (1 + F.col("item_id") % 3))) / 10000
    then = cut_lineage(judged.join(lengths, "item_id").withColumn("score", steeper).drop("n_chars"))
    now, earlier = (M.macro_average(M.ranking_metrics(rows), METRICS) for rows in (judged, then))
    return M.compare_to_baseline(now, earlier).select(
        "metric", rounded(F.col("value")).alias("value"),
        rounded(F.col("baseline")).alias("baseline"),
        rounded(F.col("delta") + 1).alias("delta_plus_one"), "regressed")


@query("average_ranks", """
    SELECT case_id, item_id, rank() OVER (PARTITION BY case_id ORDER BY score)
           + (count(*) OVER (PARTITION BY case_id, score) - 1) / 2.0::DOUBLE AS avg_rank
    FROM judgments""", "judgments")
def _(spark, sf):
    j = B.judgments(spark, sf)
    return R.average_ranks(j, ["case_id"], "score", "avg_rank").select(
        "case_id", "item_id", "avg_rank")


_CURVE = """obs AS (SELECT score, relevance >= 2 AS relevant FROM judgments),
    grid AS (SELECT unnest(generate_series(0, 100)) AS step),
    counts AS (
      SELECT step, count(*) FILTER (WHERE score >= step / 100.0::DOUBLE AND relevant) AS tp,
             count(*) FILTER (WHERE score >= step / 100.0::DOUBLE AND NOT relevant) AS fp,
             count(*) FILTER (WHERE score < step / 100.0::DOUBLE AND relevant) AS fn
      FROM grid CROSS JOIN obs GROUP BY 1),
    pr AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p,
                  coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS rc FROM counts),
    curve AS (SELECT *, round(coalesce(5 * p * rc / nullif(4 * p + rc, 0), 0), 4) AS f_beta FROM pr)"""


@query("threshold_curve", f"""
    WITH {_CURVE}
    SELECT step / 100.0::DOUBLE AS threshold, tp + fp AS retained, tp AS true_positive,
           fp AS false_positive, fn AS false_negative, {r('p')} AS precision, {r('rc')} AS recall,
           {r('f_beta', 4)} AS f_beta FROM curve""", "judgments")
def _(spark, sf):
    obs = B.judgments(spark, sf).select("score", (F.col("relevance") >= 2).alias("relevant"))
    c = CA.threshold_curve(obs)
    return c.select(
        "threshold", "retained", "true_positive", "false_positive", "false_negative",
        rounded(F.col("precision")).alias("precision"), rounded(F.col("recall")).alias("recall"),
        rounded(F.col("f_beta"), 4).alias("f_beta"))


@query("threshold_recommendation", f"""
    WITH {_CURVE}, best AS (SELECT * FROM curve WHERE f_beta = (SELECT max(f_beta) FROM curve)),
    edge AS (SELECT min(step) AS lo, max(step) AS hi FROM best)
    SELECT step / 100.0::DOUBLE AS threshold, tp + fp AS retained, {r('f_beta', 4)} AS f_beta,
           lo / 100.0::DOUBLE AS plateau_low, hi / 100.0::DOUBLE AS plateau_high,
           fn = 0 AND fp = 0 AS perfectly_separable
    FROM best CROSS JOIN edge ORDER BY abs(step - (lo + hi) / 2.0::DOUBLE), step LIMIT 1""",
       "judgments")
def _(spark, sf):
    obs = B.judgments(spark, sf).select("score", (F.col("relevance") >= 2).alias("relevant"))
    return CA.recommend(CA.threshold_curve(obs)).select(
        "threshold", "retained", rounded(F.col("f_beta"), 4).alias("f_beta"),
        "plateau_low", "plateau_high", "perfectly_separable")


@query("threshold_curve_sampled", f"""
    WITH {_CURVE}, best AS (SELECT * FROM curve WHERE f_beta = (SELECT max(f_beta) FROM curve)),
    edge AS (SELECT min(step) AS lo, max(step) AS hi FROM best),
    pick AS (SELECT step FROM best CROSS JOIN edge
             ORDER BY abs(step - (lo + hi) / 2.0::DOUBLE), step LIMIT 1)
    SELECT step / 100.0::DOUBLE AS threshold, tp + fp AS retained,
           step IN (SELECT step FROM pick) AS recommended
    FROM curve WHERE step % 5 = 0 OR step IN (SELECT step FROM pick)""", "judgments")
def _(spark, sf):
    obs = B.judgments(spark, sf).select("score", (F.col("relevance") >= 2).alias("relevant"))
    return CA.sampled_curve(CA.threshold_curve(obs)).select("threshold", "retained", "recommended")


# --- Agreement -------------------------------------------------------------------
@query("last_decisions", "SELECT actor, object_id, stage, retained FROM last_decisions",
       "last_decisions")
def _(spark, sf):
    return AG.last_decisions(B.decisions(spark, sf))


@query("rater_pairs_kappa", f"""
    WITH met AS (
      SELECT a.actor AS a, b.actor AS b, count(*) AS common,
             sum(CASE WHEN a.retained = b.retained THEN 1 ELSE 0 END)::BIGINT AS agreed,
             avg(a.retained::INT)::DOUBLE AS pa, avg(b.retained::INT)::DOUBLE AS pb
      FROM last_decisions a JOIN last_decisions b
        ON a.object_id = b.object_id AND a.actor < b.actor GROUP BY 1, 2),
    kap AS (SELECT *, agreed::DOUBLE / common AS obs, pa * pb + (1 - pa) * (1 - pb) AS ex FROM met),
    done AS (SELECT *, CASE WHEN ex >= 1 THEN CASE WHEN obs >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
                       ELSE (obs - ex) / (1 - ex) END AS kappa FROM kap)
    SELECT a, b, common, agreed, {r('obs')} AS raw_agreement, {r('kappa + 2')} AS kappa_plus_two,
           CASE WHEN kappa >= 0.81 THEN 'almost perfect' WHEN kappa >= 0.61 THEN 'substantial'
                WHEN kappa >= 0.41 THEN 'moderate' WHEN kappa >= 0.21 THEN 'fair'
                WHEN kappa >= 0.01 THEN 'slight' ELSE 'none or worse than chance' END AS label,
           common >= 5 AS interpretable FROM done""", "last_decisions")
def _(spark, sf):
    p = AG.rater_pairs(AG.last_decisions(B.decisions(spark, sf)))
    return p.select(
        "a", "b", "common", "agreed", rounded(F.col("raw_agreement")).alias("raw_agreement"),
        rounded(F.col("kappa") + 2).alias("kappa_plus_two"), "label", "interpretable")


_PROFILES = """
    SELECT actor, count(*) AS decisions, count(*) FILTER (WHERE retained) AS retained,
           count(*) FILTER (WHERE effective IS NOT NULL AND retained = (effective >= 0.5)) AS followed,
           count(*) FILTER (WHERE effective IS NOT NULL AND retained <> (effective >= 0.5))
             AS deviated
    FROM last_decisions LEFT JOIN latest ON application_id = object_id GROUP BY 1"""


def _profiles(spark, sf):
    latest = R.latest_scores(B.score_history(spark, sf)).select(
        F.col("application_id").alias("object_id"), "effective")
    return AG.rater_profiles(AG.last_decisions(B.decisions(spark, sf)), latest, 0.5)


@query("rater_profiles", f"""
    SELECT actor, decisions, retained, followed, deviated,
           {r('retained::DOUBLE / decisions')} AS retention_rate,
           {r('coalesce(followed::DOUBLE / nullif(followed + deviated, 0), 0)')} AS score_agreement,
           decisions >= 5 AS enough_decisions, followed + deviated >= 5 AS measurable
    FROM ({_PROFILES})""", "last_decisions latest")
def _(spark, sf):
    return _profiles(spark, sf).select(
        "actor", "decisions", "retained", "followed", "deviated",
        rounded(F.col("retention_rate")).alias("retention_rate"),
        rounded(F.col("score_agreement")).alias("score_agreement"),
        "enough_decisions", "measurable")


@query("retention_spread", f"""
    SELECT {r('max(rate) - min(rate)')} AS spread FROM (
      SELECT retained::DOUBLE / decisions AS rate FROM ({_PROFILES}) WHERE decisions >= 5)""",
       "last_decisions latest")
def _(spark, sf):
    return AG.retention_spread(_profiles(spark, sf)).select(
        rounded(F.col("spread")).alias("spread"))


# --- Scenarios ---------------------------------------------------------------------
SCENARIOS = {
    "default": {},
    "experience_first": {"skills": 0.20, "experience": 0.45},
    "location_heavy": {"location": 1.0},
    "all_zero": {name: 0.0 for name in V.CRITERIA},
}
# Normalised by hand for the SQL side: 4 decimals, residue on the largest.
_SCENARIO_SQL = {
    "default": (0.45, 0.20, 0.10, 0.10, 0.05, 0.10),
    "experience_first": (0.20, 0.45, 0.10, 0.10, 0.05, 0.10),
    "location_heavy": (0.2368, 0.1053, 0.0526, 0.0526, 0.0263, 0.5264),
    "all_zero": (0.45, 0.20, 0.10, 0.10, 0.05, 0.10),
}
_SCENARIO_VALUES = ", ".join(
    f"('{name}', {', '.join(f'{w}::DOUBLE' for w in ws)})" for name, ws in _SCENARIO_SQL.items()
)


@query("weight_scenarios", f"""
    WITH sc(scenario, {', '.join(f's_{n}' for n in V.CRITERIA)}) AS (VALUES {_SCENARIO_VALUES}),
    re AS (SELECT application_id, candidate_id, offer_id, scenario, {r('overall', 4)} AS before,
                  {r(sql_weighted(weight='s_{0}') + ' * admissibility', 4)} AS after
           FROM scores CROSS JOIN sc)
    SELECT application_id, scenario, before, after, rank_before, rank_after,
           rank_before - rank_after AS movement FROM (
      SELECT *, row_number() OVER (PARTITION BY offer_id, scenario ORDER BY before DESC, candidate_id)
                  AS rank_before,
                row_number() OVER (PARTITION BY offer_id, scenario ORDER BY after DESC, candidate_id)
                  AS rank_after FROM re)""", "scores")
def _(spark, sf):
    crit = SC.criteria(B.tables(spark, sf), ref_year=B.REF_YEAR)
    stored = cut_lineage(SN.rescore(crit, SCENARIOS, GRID))
    return SN.rerank_scenarios(stored, next(iter(SCENARIOS))).select(
        "application_id", "scenario", "before", "after",
        *[F.col(c).cast("long").alias(c) for c in ("rank_before", "rank_after", "movement")])


# --- Bias ----------------------------------------------------------------------------
#: First graduation year that the planted engine counts in full.
RECENT = 1998
LOCAL_VARIANTS = {
    "name": V.BIAS_VARIANTS["name"],
    "location": (("near", "NATION_3, EUROPE"), ("far", "NATION_8, ASIA"), ("none", "Elsewhere")),
    "graduation_year": V.BIAS_VARIANTS["graduation_year"],
    "institution": V.BIAS_VARIANTS["institution"],
}
_VARIANT_ROWS = ", ".join(
    f"('{d}', '{label}', {seq}, '{value if d == 'location' else ''}')"
    for seq, (d, label, value) in enumerate(
        (d, label, value) for d, options in LOCAL_VARIANTS.items() for label, value in options
    )
)


_VARIANT_YEARS = ", ".join(
    f"('{d}', '{label}', {seq}, '{value if d == 'location' else ''}',"
    f" {value if d == 'graduation_year' else 'NULL'}::INT)"
    for seq, (d, label, value) in enumerate(
        (d, label, value) for d, options in LOCAL_VARIANTS.items() for label, value in options
    )
)


def _halved(year: str) -> str:
    return f"CASE WHEN {year} < {RECENT} THEN full_education / 2 ELSE full_education END"


def _observed_sql(blind: bool, weight: str = "w_{0}") -> str:
    names = [n for n in V.CRITERIA if n != "location"] if blind else V.CRITERIA
    own = sql_weighted(names, weight)
    new_location = "NULL::DOUBLE" if blind else (
        "CASE WHEN location IS NULL THEN NULL WHEN place = '' THEN location "
        f"WHEN list_has_any({sql_place('offer_location')}, {sql_place('place')}) THEN 1.0::DOUBLE "
        "WHEN remote_policy = 'hybrid' THEN 0.45::DOUBLE ELSE 0.25::DOUBLE END"
    )
    return f"""vr(dimension, variant, seq, place) AS (VALUES {_VARIANT_ROWS}),
    own AS (SELECT application_id, offer_id, {r(own + ' * admissibility', 4)} AS own FROM criteria),
    alt0 AS (SELECT * REPLACE ({new_location} AS location) FROM criteria CROSS JOIN vr),
    alt AS (SELECT application_id, offer_id, dimension, variant, seq,
                   {r(sql_weighted(names, weight) + ' * admissibility', 4)} AS score FROM alt0),
    steps AS (SELECT offer_id, own AS lvl, count(*) AS at FROM own GROUP BY 1, 2),
    pts AS (SELECT DISTINCT offer_id, score AS x FROM alt UNION SELECT offer_id, own FROM own),
    higher AS (SELECT p.offer_id, p.x, coalesce(sum(s.at), 0)::BIGINT AS above FROM pts p
               LEFT JOIN steps s ON s.offer_id = p.offer_id AND s.lvl > p.x GROUP BY 1, 2),
    observed AS (
      SELECT a.*, o.own, a.score - o.own AS delta,
             h.above - (o.own > a.score)::INT + 1 AS rank, g.above + 1 AS old_rank
      FROM alt a JOIN own o USING (application_id)
      JOIN higher h ON h.offer_id = a.offer_id AND h.x = a.score
      JOIN higher g ON g.offer_id = a.offer_id AND g.x = o.own),
    report AS (
      SELECT dimension, avg(abs(delta)) AS mean_abs_delta, max(abs(delta)) AS max_abs_delta,
             count(*) FILTER (WHERE rank <> old_rank) AS rank_changes, count(*) AS comparisons
      FROM observed GROUP BY 1),
    ratios AS (
      SELECT dimension, CASE WHEN max(rate) = 0 THEN 1.0::DOUBLE ELSE min(rate) / max(rate) END
             AS impact_ratio
      FROM (SELECT dimension, variant, avg((rank <= 3)::INT)::DOUBLE AS rate
            FROM observed GROUP BY 1, 2) GROUP BY 1)"""


def _rescored(spark, sf, blind=None, dimensions=None, engine=SC.criteria):
    return BI.rescore(B.audited(spark, sf), B.REF_YEAR, LOCAL_VARIANTS, dimensions, blind, engine)


def _report(spark, sf, blind=None, engine=SC.criteria):
    return BI.dimension_report(BI.observe(_rescored(spark, sf, blind, engine=engine), GRID))


_EXAMPLE = """CASE WHEN max_abs_delta > 0 THEN e.variant END AS example_variant,
    CASE WHEN max_abs_delta > 0 THEN e.own END AS example_own,
    CASE WHEN max_abs_delta > 0 THEN e.score END AS example_score"""


def _audit_sql(observed: str) -> str:
    return f"""
    WITH {observed}, examples AS (
      SELECT dimension, arg_max({{'variant': variant, 'own': own, 'score': score}},
                                (abs(delta), -seq, application_id)) AS e FROM observed GROUP BY 1)
    SELECT dimension, {r('mean_abs_delta')} AS mean_abs_delta,
           {r('max_abs_delta', 4)} AS max_abs_delta, rank_changes, comparisons,
           {r('impact_ratio')} AS impact_ratio, max_abs_delta > 0.001 AS influences_score,
           impact_ratio >= 0.80 AS passes, {_EXAMPLE}
    FROM report JOIN ratios USING (dimension) JOIN examples USING (dimension)"""


def _audit_columns(rep):
    return rep.select(
        "dimension", rounded(F.col("mean_abs_delta")).alias("mean_abs_delta"),
        rounded(F.col("max_abs_delta"), 4).alias("max_abs_delta"), "rank_changes", "comparisons",
        rounded(F.col("impact_ratio")).alias("impact_ratio"), "influences_score", "passes",
        F.col("example.variant").alias("example_variant"), F.col("example.own").alias("example_own"),
        F.col("example.score").alias("example_score"))


@query("bias_audit", _audit_sql(_observed_sql(False)), "criteria")
def _(spark, sf):
    return _audit_columns(_report(spark, sf))



def counts_recent_degrees(tables, **options):
    """An engine that must not pass: degrees from before RECENT count half."""
    rows = SC.criteria(tables, **options)
    old = F.coalesce(F.col("graduation_year") < RECENT, F.lit(False))
    return rows.withColumn("education", F.when(old, F.col("education") / 2).otherwise(F.col("education")))


@query("bias_audit_of_age_rule", _audit_sql(
    "aged AS (SELECT c.*, e.graduation_year, c.education AS full_education FROM criteria c"
    " JOIN education e USING (candidate_id)), "
    + _observed_sql(False)
    .replace("FROM criteria)", f"FROM (SELECT * REPLACE ({_halved('graduation_year')} AS education) FROM aged))")
    .replace("FROM criteria CROSS JOIN vr", "FROM aged CROSS JOIN vr")
    .replace("AS location)", "AS location, "
             f"{_halved('coalesce(CASE dimension WHEN $graduation_year$ THEN year END, graduation_year)')} AS education)")
    .replace("$", "'").replace("vr(dimension, variant, seq, place)", "vr(dimension, variant, seq, place, year)")
    .replace(_VARIANT_ROWS, _VARIANT_YEARS)), "criteria education")
def _(spark, sf):
    return _audit_columns(_report(spark, sf, engine=counts_recent_degrees))


@query("bias_altered_ranks", f"""
    WITH {_observed_sql(False)}
    SELECT application_id, variant, score, own, rank, old_rank FROM observed
    WHERE dimension = 'location'""", "criteria")
def _(spark, sf):
    obs = BI.observe(_rescored(spark, sf, dimensions=("location",)), GRID).rows
    return obs.select("application_id", "variant", "score", "own",
                      F.col("rank").cast("long").alias("rank"),
                      F.col("old_rank").cast("long").alias("old_rank"))


@query("bias_blind", f"""
    WITH {_observed_sql(True)}
    SELECT dimension, {r('max_abs_delta', 4)} AS max_abs_delta, rank_changes,
           {r('impact_ratio')} AS impact_ratio
    FROM report JOIN ratios USING (dimension)""", "criteria")
def _(spark, sf):
    rep = _report(spark, sf, True)
    return rep.select("dimension", rounded(F.col("max_abs_delta"), 4).alias("max_abs_delta"),
                      "rank_changes", rounded(F.col("impact_ratio")).alias("impact_ratio"))


@query("bias_mitigation", f"""
    WITH {_observed_sql(False)},
    {_observed_sql(True).replace('vr(', 'vr2(').replace('CROSS JOIN vr)', 'CROSS JOIN vr2)')
        .replace('own AS (SELECT', 'own2 AS (SELECT').replace('FROM own ', 'FROM own2 ')
        .replace('FROM own)', 'FROM own2)').replace('JOIN own o', 'JOIN own2 o')
        .replace('alt0', 'alt02').replace('alt AS', 'altb AS').replace('FROM alt ', 'FROM altb ')
        .replace('steps', 'steps2').replace('pts', 'pts2').replace('higher', 'higher2')
        .replace('observed', 'observed2').replace('report AS', 'report2 AS')
        .replace('ratios AS', 'ratios2 AS')}
    SELECT dimension, {r('b.impact_ratio - a.impact_ratio')} AS gain,
           ra.rank_changes AS rank_changes_standard, rb.rank_changes AS rank_changes_blind,
           ra.max_abs_delta > 0.001 AND rb.max_abs_delta <= 0.001 AS neutralised
    FROM ratios a JOIN ratios2 b USING (dimension) JOIN report ra USING (dimension)
    JOIN report2 rb USING (dimension)""", "criteria")
def _(spark, sf):
    reports = [_report(spark, sf, blind) for blind in (None, True)]
    return BI.compare_blind(*reports).select(
        "dimension", rounded(F.col("gain")).alias("gain"), "rank_changes_standard",
        "rank_changes_blind", "neutralised")


_SCENARIO_IMPACT = " UNION ALL ".join(
    f"SELECT * FROM (WITH {_observed_sql(False, 's_{0}')} SELECT '{name}' AS scenario, dimension, impact_ratio"
    f" FROM ratios WHERE dimension = 'location')".replace(
        "FROM criteria", "FROM (SELECT * FROM criteria CROSS JOIN (VALUES ("
        + ", ".join(f"{w}::DOUBLE" for w in ws) + f")) t({', '.join(f's_{n}' for n in V.CRITERIA)}))")
    for name, ws in _SCENARIO_SQL.items())


@query("impact_ratio_for_weights", f"""
    WITH after AS ({_SCENARIO_IMPACT}),
    before AS (SELECT * FROM (WITH {_observed_sql(False)} SELECT impact_ratio FROM ratios WHERE dimension = 'location'))
    SELECT scenario, dimension, {r('after.impact_ratio')} AS impact_ratio, {r('before.impact_ratio')} AS baseline_ratio
    FROM after, before""", "criteria")
def _(spark, sf):
    out = BI.scenario_impact(_rescored(spark, sf, dimensions=("location",)), GRID, SCENARIOS)
    return out.select("scenario", "dimension", rounded(F.col("impact_ratio")).alias("impact_ratio"),
                      rounded(F.col("baseline_ratio")).alias("baseline_ratio"))


_SENIOR = """CASE WHEN experience IS NOT NULL THEN CASE WHEN (years + {extra}) / least_years >= 1
    THEN 1.0::DOUBLE ELSE pow((years + {extra}) / least_years, 0.7::DOUBLE) END END""".format(
        extra=V.EXTRA_SENIORITY_YEARS)


@query("bias_property_checks", f"""
    WITH x AS (SELECT s.*, p.total_experience_years AS years, o.experience_min_years AS least_years
               FROM scores s JOIN candidates p USING (candidate_id) JOIN offers o USING (offer_id)),
    y AS (SELECT * REPLACE ({_SENIOR} AS experience), overall AS own FROM x),
    z AS (SELECT 'seniority_not_penalised' AS property,
                 {sql_weighted()} * admissibility < own - {V.DELTA_TOLERANCE} AS broken FROM y
          UNION ALL
          SELECT 'name_has_no_effect', {sql_weighted()} * admissibility <> overall FROM x)
    SELECT property, count(*) FILTER (WHERE broken) AS violations, count(*) AS checked,
           count(*) FILTER (WHERE broken) = 0 AS holds FROM z GROUP BY 1""", "scores candidates offers")
def _(spark, sf):
    return BI.property_checks(B.tables(spark, sf), B.REF_YEAR, GRID)


_READINGS = """readings AS (
      SELECT event_type AS dimension, ts::DATE AS read_at,
             floor(min(v) / max(v) * 1000) / 1000 AS ratio FROM (
        SELECT event_type, ts, user_id % 2 AS g, 0 AS v FROM events WHERE false
        UNION ALL
        SELECT event_type, max(ts), user_id % 3, sum(value) FROM events
        GROUP BY event_type, ts::DATE, user_id % 3) GROUP BY 1, 2)"""


def readings(spark, sf):
    """Daily ratio of the smallest to the largest activity share per event type."""
    groups = B.read(spark, sf, "events").groupBy(
        F.col("event_type").alias("dimension"), F.to_date("ts").alias("read_at"),
        (F.col("user_id") % 3).alias("g")).agg(F.sum("value").alias("v"))
    return groups.groupBy("dimension", "read_at").agg(
        (F.floor(F.min("v") / F.max("v") * 1000) / 1000).alias("ratio"))


@query("bias_monitoring", f"""
    WITH {_READINGS}, h AS (
      SELECT *, lag(ratio) OVER (PARTITION BY dimension ORDER BY read_at) AS previous FROM readings)
    SELECT dimension, strftime(read_at, '%Y-%m-%d') AS read_at, ratio, previous,
           previous IS NULL AS first_reading,
           CASE WHEN ratio < 0.80 THEN 'legal_gap'
                WHEN previous IS NOT NULL AND previous - ratio >= 0.05 THEN 'drift' ELSE '' END AS alert
    FROM h""")
def _(spark, sf):
    out = BI.monitor_bias(readings(spark, sf))
    return out.select("dimension", day("read_at").alias("read_at"), "ratio", "previous",
                      "first_reading", F.coalesce("alert", F.lit("")).alias("alert"))


_HEAVY = ", ".join(f"{w}::DOUBLE" for w in _SCENARIO_SQL["location_heavy"])
_HEAVY_RATIOS = _observed_sql(False, "s_{0}").replace(
    "FROM criteria", "FROM (SELECT * FROM criteria CROSS JOIN (VALUES ("
    + _HEAVY + f")) t({', '.join(f's_{n}' for n in V.CRITERIA)}))")


@query("bias_monitoring_of_audits", f"""
    WITH first_run AS (SELECT * FROM (WITH {_observed_sql(False)} SELECT dimension, {r('impact_ratio')} AS ratio FROM ratios)),
    second_run AS (SELECT * FROM (WITH {_HEAVY_RATIOS} SELECT dimension, {r('impact_ratio')} AS ratio FROM ratios)),
    runs AS (SELECT dimension, '2002-01-01' AS read_at, ratio, NULL::DOUBLE AS previous FROM first_run
             UNION ALL SELECT dimension, '2002-02-01', s.ratio, f.ratio
             FROM second_run s JOIN first_run f USING (dimension))
    SELECT dimension, read_at, ratio, coalesce(previous, -1)::DOUBLE AS previous, previous IS NULL AS first_reading,
           CASE WHEN ratio < 0.80 THEN 'legal_gap'
                WHEN previous IS NOT NULL AND previous - ratio >= 0.05 THEN 'drift' ELSE '' END AS alert,
           min(ratio) OVER (PARTITION BY read_at) AS worst_ratio FROM runs""", "criteria")
def _(spark, sf):
    """Two audit runs, the second after the weights were changed; it meets the first as recorded."""
    path = work_path(spark, "bias-readings")
    # A reading is a ratio, so both runs need only who is on the shortlist: one pass over the altered rows.
    ratios = cut_lineage(BI.scenario_impact(
        _rescored(spark, sf), GRID, {"location_heavy": SCENARIOS["location_heavy"]}), "ratios")
    runs = [BI.monitor_run(ratios.select("dimension", rounded(F.col(ratio)).alias("ratio")), path, date)
            for ratio, date in (("baseline_ratio", "2002-01-01"), ("impact_ratio", "2002-02-01"))]
    return runs[0].unionByName(runs[1]).select(
        "dimension", day("read_at").alias("read_at"), "ratio", F.coalesce("previous", F.lit(-1.0)).alias("previous"),
        "first_reading", F.coalesce("alert", F.lit("")).alias("alert"), "worst_ratio")
