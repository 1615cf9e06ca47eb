"""Ranking, search and set metrics per case, and their macro averages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolewise import fixed_values as V
from rolewise.operators import ranking as R

GRADES = (0, 1, 2, 3)


def _dcg(position: str, k: int) -> Column:
    gain = F.col("relevance") / (F.log(F.col(position) + 1.0) / F.log(F.lit(2.0)))
    return F.sum(F.when(F.col(position) <= k, gain))


def ndcg_at_k(predictions: DataFrame, k: int = 5) -> DataFrame:
    """DCG of the predicted top k over the ideal one; 0 without gains."""
    actual = R.top_k(
        predictions, ["case_id"], [F.desc("score"), F.asc("item_id")], k, "pos"
    ).groupBy("case_id").agg(_dcg("pos", k).alias("actual"))
    ideal = R.top_k(
        predictions, ["case_id"], [F.desc("relevance"), F.asc("item_id")], k, "pos"
    ).groupBy("case_id").agg(_dcg("pos", k).alias("ideal"))
    return actual.join(ideal, "case_id").select(
        "case_id",
        F.coalesce(F.try_divide("actual", "ideal"), F.lit(0.0)).alias(f"ndcg_at_{k}"),
    )


def precision_at_k(predictions: DataFrame, k: int = 3) -> DataFrame:
    """Relevant share of the top k, bounded by the relevant items there are."""
    relevant = F.col("relevance") >= V.RELEVANT_FROM
    found = R.top_k(
        predictions, ["case_id"], [F.desc("score"), F.asc("item_id")], k, "pos"
    ).groupBy("case_id").agg(F.count_if(relevant).alias("found"))
    available = predictions.groupBy("case_id").agg(F.count_if(relevant).alias("available"))
    return found.join(available, "case_id").select(
        "case_id",
        F.when(F.col("available") == 0, F.lit(1.0))
        .otherwise(F.col("found") / F.least(F.lit(k), F.col("available")))
        .alias(f"precision_at_{k}"),
    )


def pair_accuracy(predictions: DataFrame, grades: tuple[int, ...] = GRADES) -> DataFrame:
    """Concordant over comparable pairs, from running counts per grade.

    No pair is formed: each item counts the better-graded items ahead of it
    (wrong-way pairs are the rest), and comparable pairs follow from the class
    sizes.
    """
    relevance = F.col("relevance")
    ahead = R.running_totals(
        predictions, ["case_id"], "score", "item_id",
        {f"g{g}": (relevance == g).cast("long") for g in grades},
    )
    better = reduce(
        lambda total, g: total + F.when(relevance < g, F.col(f"g{g}")).otherwise(F.lit(0)),
        grades, F.lit(0),
    )
    sizes = [F.count_if(relevance == g) for g in grades]
    items = F.count("*")
    comparable = (items * items - sum((s * s for s in sizes), F.lit(0))) / 2
    return ahead.groupBy("case_id").agg(
        F.coalesce(F.try_divide(F.sum(better), comparable), F.lit(1.0)).alias("pair_accuracy")
    )


def spearman(predictions: DataFrame) -> DataFrame:
    """Rank correlation with average ranks, computed on (score, grade) cells."""
    cells = predictions.groupBy("case_id", "score", "relevance").agg(F.count("*").alias("n"))

    def side(value: str, name: str) -> DataFrame:
        levels = cells.groupBy("case_id", value).agg(F.sum("n").alias("at"))
        below = W.partitionBy("case_id").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
        rank = F.coalesce(F.sum("at").over(below), F.lit(0)) + (F.col("at") + 1) / 2
        return levels.select("case_id", value, rank.alias(name))

    ranked = cells.join(side("score", "x"), ["case_id", "score"]).join(
        side("relevance", "y"), ["case_id", "relevance"]
    )
    sums = ranked.groupBy("case_id").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.col("n") * e).alias(a) for a, e in (
            ("sx", F.col("x")), ("sy", F.col("y")), ("sxy", F.col("x") * F.col("y")),
            ("sxx", F.col("x") * F.col("x")), ("syy", F.col("y") * F.col("y")),
        )],
    )
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    var_x = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    var_y = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    value = F.when(F.col("n") < 2, F.lit(1.0)).when(
        (var_x <= 0) | (var_y <= 0), F.lit(0.0)
    ).otherwise(cov / F.sqrt(var_x * var_y))
    return sums.select("case_id", value.alias("spearman"))


def ranking_metrics(predictions: DataFrame) -> DataFrame:
    """The four ranking metrics, one row per case."""
    return (
        ndcg_at_k(predictions, 5)
        .join(precision_at_k(predictions, 3), "case_id")
        .join(pair_accuracy(predictions), "case_id")
        .join(spearman(predictions), "case_id")
    )


def macro_average(per_case: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, value): the mean over cases, unpivoted."""
    means = per_case.agg(*[F.avg(m).alias(m) for m in metrics])
    return means.unpivot([], metrics, "metric", "value")


def against_minimums(aggregate: DataFrame, minimums: dict[str, float]) -> DataFrame:
    """Threshold gate: which metrics fail their accepted minimum (or maximum)."""
    pairs = [F.lit(x) for item in minimums.items() for x in item]
    limit = F.try_element_at(F.create_map(*pairs), F.col("metric"))
    failed = F.when(
        F.col("metric").isin(*V.LOWER_IS_BETTER), F.col("value") > limit
    ).otherwise(F.col("value") < limit)
    return aggregate.withColumn("limit", limit).where("limit IS NOT NULL").withColumn(
        "failed", failed
    )


def compare_to_baseline(current: DataFrame, baseline: DataFrame, tolerance: float = 0.01
                        ) -> DataFrame:
    """Delta per metric against a stored run, flagged when it regressed."""
    base = baseline.select("metric", F.col("value").alias("baseline"))
    delta = F.col("value") - F.col("baseline")
    return current.join(base, "metric").select(
        "metric", "value", "baseline", delta.alias("delta"), (delta < -tolerance).alias("regressed")
    )


def set_prf(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall, F1 of (keys, item, is_predicted, is_expected) rows."""
    hit = F.count_if(F.col("is_predicted") & F.col("is_expected"))
    counts = pairs.groupBy(*keys).agg(
        hit.alias("hits"),
        F.count_if(F.col("is_predicted")).alias("predicted"),
        F.count_if(F.col("is_expected")).alias("expected"),
    )
    empty = (F.col("predicted") == 0) & (F.col("expected") == 0)
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    scored = counts.withColumns({
        "precision": F.when(empty, F.lit(1.0)).otherwise(
            safe(F.col("hits"), F.col("predicted"))),
        "recall": F.when(empty, F.lit(1.0)).otherwise(safe(F.col("hits"), F.col("expected"))),
    })
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn(
        "f1", F.when(empty, F.lit(1.0)).otherwise(safe(2 * p * r, p + r))
    )


def set_pairs(predicted: DataFrame, expected: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Full outer comparison of two item sets, duplicates removed."""
    left = predicted.select(*keys, item).distinct().withColumn("is_predicted", F.lit(True))
    right = expected.select(*keys, item).distinct().withColumn("is_expected", F.lit(True))
    return left.join(right, [*keys, item], "full_outer").na.fill(
        False, ["is_predicted", "is_expected"]
    )


def search_metrics(hits: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: recall@5 and its ceiling, precision@3 over returned, reciprocal rank.

    `hits` (query_id, doc_id, rank), `relevant` (query_id, doc_id), `queries`
    (query_id) so that a query without hits or answers keeps its row.
    """
    marked = hits.join(
        relevant.select("query_id", "doc_id", F.lit(1).alias("good")), ["query_id", "doc_id"], "left"
    )
    good = F.col("good").isNotNull()
    per_hit = marked.groupBy("query_id").agg(
        F.count("*").alias("returned"),
        F.count_if(good & (F.col("rank") <= 5)).alias("found5"),
        F.count_if(good & (F.col("rank") <= 3)).alias("found3"),
        F.count_if(F.col("rank") <= 3).alias("top3"),
        F.min(F.when(good, F.col("rank"))).alias("first_good"),
    )
    wanted = relevant.groupBy("query_id").agg(F.count_distinct("doc_id").alias("wanted"))
    base = queries.select("query_id").join(per_hit, "query_id", "left").join(
        wanted, "query_id", "left"
    ).na.fill(0, ["returned", "found5", "found3", "top3", "wanted"])
    none = F.col("wanted") == 0
    return base.select(
        "query_id",
        F.when(none, F.lit(1.0)).otherwise(F.col("found5") / F.col("wanted")).alias("recall_at_5"),
        F.when(none, F.lit(1.0))
        .otherwise(F.least(F.lit(1.0), 5 / F.col("wanted"))).alias("recall_at_5_ceiling"),
        F.coalesce(F.try_divide("found3", "top3"), F.lit(0.0)).alias("precision_at_3"),
        F.coalesce(1 / F.col("first_good"), F.lit(0.0)).alias("reciprocal_rank"),
        none.alias("expects_nothing"),
        (F.col("returned") == 0).alias("answered_nothing"),
    )


def search_aggregate(per_query: DataFrame) -> DataFrame:
    """Means over the answerable queries, and how empty queries were handled."""
    asked = ~F.col("expects_nothing")
    return per_query.agg(
        F.avg(F.when(asked, F.col("recall_at_5"))).alias("recall_at_5"),
        F.avg(F.when(asked, F.col("recall_at_5_ceiling"))).alias("recall_at_5_ceiling"),
        F.avg(F.when(asked, F.col("reciprocal_rank"))).alias("mrr"),
        F.avg(F.when(asked, F.col("precision_at_3"))).alias("precision_at_3"),
        (F.count_if(~asked & F.col("answered_nothing"))
         / F.greatest(F.lit(1), F.count_if(~asked))).alias("empty_queries_handled"),
    )
