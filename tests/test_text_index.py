"""The stored text index against the search over all texts."""

import random

from pyspark.sql import functions as F

from rolewise.operators import search as SE
from rolewise.operators import text_index as TI

DOCS, ASKS = "doc_id long, text string", "query_id long, text string"


def made(n=400, seed=1):
    pick = random.Random(seed)
    common = [f"word{i}" for i in range(40)]
    rare = [f"rare{i}" for i in range(60)]
    docs = []
    for i in range(n):
        words = pick.choices(common, k=pick.randint(0, 30)) + pick.choices(rare, k=pick.randint(0, 2))
        docs.append((i, " ".join(words) if i % 50 else None))
    asks = [(q, " ".join(pick.choices(rare, k=2) + pick.choices(common, k=pick.randint(0, 4)))) for q in range(12)]
    return docs, asks + [(100, "unheard"), (101, None), (102, "rare1 rare1 rare1")]


def lists(frame):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score, tuple(r.matched_terms)) for r in frame.collect())


def test_equals_the_search_over_texts(spark, tmp_path):
    docs, asks = made()
    whole, asked = spark.createDataFrame(docs, DOCS), spark.createDataFrame(asks, ASKS)
    path = f"{tmp_path}/index"
    for batch in range(3):
        TI.append(whole.where(F.col("doc_id") % 3 == batch), path, batch, block=16)
    TI.append(whole.where("doc_id % 3 = 1"), path, 1, block=16)  # a repeated batch replaces itself
    expected = lists(SE.bm25(whole, asked, 5))
    assert expected and lists(TI.search(spark, path, asked, 5, first=2)) == expected
    assert lists(TI.search(spark, path, asked.where("query_id < 3"), 5)) == [r for r in expected if r[0] < 3]


def test_blocks_are_skipped(spark, tmp_path):
    docs = [(i, " ".join(["common"] * (1 + i % 3) + ["filler"] * 20)) for i in range(600)]
    docs += [(1000 + i, "common needle needle") for i in range(6)]
    path = f"{tmp_path}/index"
    TI.append(spark.createDataFrame(docs, DOCS), path, 0, block=20)
    asked = spark.createDataFrame([(1, "needle common")], ASKS)
    weights, mean = TI.weighted_terms(spark, path, asked)
    bounds = TI.block_bounds(spark, path, weights, mean, 1.5, 0.75)
    opened = bounds.orderBy(F.desc("bound")).limit(8)
    found = TI.scores_in(spark, path, weights, opened, mean, 1.5, 0.75)
    assert bounds.count() > 20
    assert TI.worth_opening(bounds, found, opened, 3).count() == 0
    assert TI.worth_opening(bounds, found, opened, 1000).count() == bounds.count() - 8
    assert [r.doc_id for r in TI.search(spark, path, asked, 3).orderBy("rank").collect()] == [1000, 1001, 1002]


def test_a_query_batch_reads_no_text(spark, tmp_path):
    docs, asks = made(60)
    path = f"{tmp_path}/index"
    TI.append(spark.createDataFrame(docs, DOCS), path, 0)
    plan = TI.search(spark, path, spark.createDataFrame(asks, ASKS))._jdf.queryExecution().optimizedPlan().collectLeaves()
    names = {n for k in range(plan.size()) for n in plan.apply(k).schema().fieldNames()}
    assert "tf" in names and "text" not in names


def test_empty_batches(spark, tmp_path):
    path = f"{tmp_path}/index"
    TI.append(spark.createDataFrame([], DOCS), path, 0)
    asked = spark.createDataFrame([(1, "word")], ASKS)
    assert TI.search(spark, path, asked).count() == 0
    TI.append(spark.createDataFrame([(5, "a word")], DOCS), path, 1)
    assert [r.doc_id for r in TI.search(spark, path, asked).collect()] == [5]
