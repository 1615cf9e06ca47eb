import itertools
import random

import pytest
from pyspark.sql import functions as F

from rolewise.operators import agreement as AG
from rolewise.operators import bias as BI
from rolewise.operators import calibration as CA
from rolewise.operators import dashboards as DB
from rolewise.operators import metrics as M
from rolewise.operators import ranking as R


def cases(spark, relevances, scores=None):
    scores = scores or [1 - i / 100 for i in range(len(relevances))]
    return spark.createDataFrame(
        [("c", i, float(s), r) for i, (s, r) in enumerate(zip(scores, relevances))],
        "case_id string, item_id long, score double, relevance int")


@pytest.mark.parametrize("values, fraction, expected", [
    ([], 0.5, 0.0), ([7.0], 0.5, 7.0), ([1.0, 2.0, 3.0, 4.0], 0.5, 2.5),
    ([1.0, 2.0, 3.0, 4.0, 5.0], 0.95, 4.8), ([10.0, 1.0, 5.0], 0.0, 1.0),
])
def test_percentile(spark, values, fraction, expected):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = DB.exact_percentiles(df, [], "v", {"p": fraction}).first()["p"]
    assert got == pytest.approx(expected)


@pytest.mark.parametrize("ranked, ndcg, precision, pairs", [
    ([3, 2, 1, 0], 1.0, 1.0, 1.0), ([0, 0, 0], 0.0, 1.0, 1.0), ([0, 1, 2, 3], None, 1 / 2, 0.0),
    ([3, 1, 2, 0], None, 1.0, 5 / 6), ([2, 2, 2], 1.0, 1.0, 1.0), ([3, 0, 0, 2], None, 0.5, 3 / 5),
])
def test_ranking_goldens(spark, ranked, ndcg, precision, pairs):
    row = M.ranking_metrics(cases(spark, ranked)).first()
    if ndcg is not None:
        assert row["ndcg_at_5"] == pytest.approx(ndcg)
    assert row["precision_at_3"] == pytest.approx(precision)
    assert row["pair_accuracy"] == pytest.approx(pairs)


def test_spearman_with_ties(spark):
    row = M.spearman(cases(spark, [3, 3, 1], [0.9, 0.8, 0.4])).first()
    assert row["spearman"] == pytest.approx(0.866, abs=1e-3)
    assert M.spearman(cases(spark, [1, 1], [0.1, 0.2])).first()["spearman"] == 0.0
    assert M.spearman(cases(spark, [2])).first()["spearman"] == 1.0


def test_pair_accuracy_equals_brute_force_on_ties(spark):
    rng = random.Random(3)
    rows = [(rng.choice((0.1, 0.2, 0.3)), rng.randint(0, 3)) for _ in range(120)]
    df = cases(spark, [r for _, r in rows], [s for s, _ in rows])
    order = sorted(range(120), key=lambda i: (-rows[i][0], i))
    ranked = [rows[i][1] for i in order]
    pairs = [(a, b) for a, b in itertools.combinations(ranked, 2) if a != b]
    want = sum(a > b for a, b in pairs) / len(pairs)
    assert M.pair_accuracy(df).first()["pair_accuracy"] == pytest.approx(want)
    numbers = {r["item_id"]: r["rank"] for r in R.row_numbers(df, ["case_id"], "score", "item_id").collect()}
    assert numbers == {item: pos for pos, item in enumerate(order, start=1)}


def test_row_numbers_of_text_ids_and_any_scores(spark):
    import uuid

    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice([rng.random(), 0.5]), str(uuid.UUID(int=rng.getrandbits(128))))
            for _ in range(400)]
    got = R.row_numbers(spark.createDataFrame(rows, "g string, s double, id string"), ["g"], "s", "id")
    wanted = {}
    for g in "ab":
        for pos, row in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), start=1):
            wanted[row[2]] = pos
    assert {r.id: r["rank"] for r in got.collect()} == wanted


def test_set_metrics(spark):
    schema = "case_id int, item string, is_predicted boolean, is_expected boolean"
    df = spark.createDataFrame([(1, "a", True, True), (1, "b", True, False), (1, "c", False, True),
                                (2, "x", False, False)], schema)
    got = {r["case_id"]: r for r in M.set_prf(df, ["case_id"]).collect()}
    assert got[1]["f1"] == 0.5 and got[2]["f1"] == 1.0


def test_threshold_point_and_monotone_retention(spark):
    obs = spark.createDataFrame([(0.9, True), (0.7, False), (0.5, True), (0.1, False)],
                                "score double, relevant boolean")
    curve = {round(r["threshold"], 2): r for r in CA.threshold_curve(obs).collect()}
    at = curve[0.6]
    assert (at["true_positive"], at["false_positive"], at["false_negative"]) == (1, 1, 1)
    kept = [curve[k]["retained"] for k in sorted(curve)]
    assert kept == sorted(kept, reverse=True)
    assert curve[0.7]["retained"] == 2 and curve[0.71]["retained"] == 1
    pick = CA.recommend(CA.threshold_curve(obs)).first()
    assert pick["f_beta"] == max(r["f_beta"] for r in curve.values())


def test_kappa_of_raters(spark):
    def pairs(a, b):
        rows = [(who, i, "hired" if keep else "rejected", i)
                for who, series in (("a", a), ("b", b)) for i, keep in enumerate(series)]
        df = spark.createDataFrame(rows, "actor string, object_id long, stage string, event_id long")
        last = AG.last_decisions(df.withColumn("created_at", F.current_timestamp()))
        return AG.rater_pairs(last).first()

    assert pairs([True, False] * 70, [True, False] * 70)["kappa"] == 1.0
    assert pairs([False] * 8, [False] * 8)["kappa"] == 1.0
    mixed = pairs([False] * 8 + [True, False], [False] * 8 + [False, True])
    assert mixed["raw_agreement"] == pytest.approx(0.8) and mixed["kappa"] < 0
    assert mixed["common"] == 10 and mixed["interpretable"]


def test_altered_rank_counts_only_rivals(spark):
    base = spark.createDataFrame([(1, 0.9), (1, 0.8), (1, 0.8), (1, 0.5)], "offer_id int, score double")
    altered = spark.createDataFrame(
        [(1, 0.85, 0.5), (1, 0.1, 0.9), (1, 0.8, 0.8)], "offer_id int, score double, own double")
    got = {r["score"]: r["rank"] for r in R.altered_ranks(altered, base, ["offer_id"]).collect()}
    assert got == {0.85: 2, 0.1: 4, 0.8: 2}


def test_monitoring_alerts(spark):
    rows = [("d", 1, 0.95), ("d", 2, 0.94), ("d", 3, 0.85), ("d", 4, 0.70)]
    df = spark.createDataFrame(rows, "dimension string, read_at int, ratio double")
    got = [r["alert"] for r in BI.monitor_bias(df).orderBy("read_at").collect()]
    assert got == [None, None, "drift", "legal_gap"]


def test_fold_tail_and_bands(spark):
    counts = spark.createDataFrame([(f"s{i}", 20 - i) for i in range(10)], "name string, total long")
    got = [(r["name"], r["total"]) for r in R.fold_tail(counts, "name", "total", 4).orderBy("pos").collect()]
    assert got == [("s0", 20.0), ("s1", 19.0), ("s2", 18.0), ("7 others", 98.0)]
    few = R.fold_tail(counts.limit(3), "name", "total", 4).count()
    assert few == 3
    bands = DB.banded_counts(spark.range(0), F.col("id").cast("double"), (("low", 0.0, 1.0),))
    assert bands.first()["total"] == 0


def test_percentiles_of_many_ranges(spark):
    import random
    import statistics

    rng = random.Random(1)
    rows = [(f"g{rng.randrange(3)}", float(rng.choice([1, 2, 3, rng.randrange(500)]))) for _ in range(2000)]
    got = {r.g: (r.a, r.b) for r in DB.exact_percentiles(
        spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"a": 0.5, "b": 0.95}).collect()}
    for g in ("g0", "g1", "g2"):
        values = sorted(v for k, v in rows if k == g)
        p95 = 0.95 * (len(values) - 1)
        low = values[int(p95)]
        wanted = low + (values[min(int(p95) + 1, len(values) - 1)] - low) * (p95 % 1)
        assert got[g] == (pytest.approx(statistics.median(values)), pytest.approx(wanted))


def test_rater_blocks_change_nothing(spark):
    import random

    rng = random.Random(2)
    rows = [(a, o, rng.random() < 0.5) for a in range(30) for o in range(130) if rng.random() < 0.4]
    last = spark.createDataFrame(rows, "actor bigint, object_id bigint, retained boolean")
    whole = sorted(map(str, AG.rater_pairs(last).collect()))
    assert len(whole) == 30 * 29 // 2
    assert sorted(map(str, AG.rater_pairs(last, block=4).collect())) == whole


def test_rater_pairs_shuffle_no_pairs_and_leave_strangers_apart(spark, monkeypatch):
    """Copies of raters on dossiers of their own meet within the copy only; sums over keys agree."""
    rows = [(f"r{c}-{k:02d}", 1000 * c + d, (k + d) % 3 > 0)
            for c in range(3) for k in range(8) for d in range(70) if (k * 7 + d) % 4]
    last = spark.createDataFrame(rows, "actor string, object_id long, retained boolean")
    got = sorted(map(str, AG.rater_pairs(last, block=3).collect()))
    assert got == sorted(map(str, AG.rater_pairs(last, block=3, held=5).collect()))
    assert len(got) == 3 * 28
    seen = {(a, d): k for a, d, k in rows}
    for r in AG.rater_pairs(last, block=3).collect():
        both = [d for a, d in seen if a == r.a and (r.b, d) in seen]
        assert r.a < r.b and r.common == len(both)
        assert r.agreed == sum(seen[r.a, d] == seen[r.b, d] for d in both)
    plan = AG.rater_pairs(last)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [a#" not in plan
