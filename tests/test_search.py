"""Searches read texts once and deal their work by document."""

import pytest
from pyspark.sql import functions as F

from rolewise.functions.text import token_list, tokens
from rolewise.operators import search as SE
from tests.test_text_index import ASKS, DOCS, lists, made

TEXTS = [
    "Élan-vital ÀÉÎ K İstanbul ﬁn -- .a-b. c++ c# .net --x-- é́a àb œuvre Straße Σς de la python-3.11",
    "آأإ ٱلعَرَبِيَّة ـــ ٠١٢٣ ۴۵ ﻻ ﷺ ﺍﻟﻌﺮﺑﻴﺔ abc-def-1 مرحبا", "", None, "﻿abc ﷲ éa", "Ångstrom Å Ǻ ñ Ñ ﺂ the The-THE"]


def test_terms_of_a_text_are_those_of_the_expression(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").select(
        "text", tokens(F.col("text")).alias("terms")).collect()
    for r in rows:
        assert sorted(token_list(r.text)) == sorted(r.terms)


def test_counted_terms_keep_documents_without_terms(spark, monkeypatch):
    monkeypatch.setattr(SE, "OUT_ROWS", 3)
    docs = spark.createDataFrame([(1, "b a-b"), (2, None), (3, "bb cc bb a-b")], DOCS)
    got = sorted(tuple(r) for r in SE.term_counts(docs, ["doc_id"]).collect())
    assert got == [(1, 1, "", 1), (1, 1, "a-b", 1), (2, 0, "", 1),
                   (3, 4, "", 1), (3, 4, "a-b", 1), (3, 4, "bb", 2), (3, 4, "cc", 1)]


def reads(frame, name):
    """How often the plan of a frame scans the given column."""
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(name in leaves.apply(k).schema().fieldNames() for k in range(leaves.size()))


@pytest.mark.parametrize("rows", [1 << 18, 20])
def test_scores_do_not_depend_on_the_number_of_tasks(spark, rows):
    docs, asks = made(120)
    whole, asked = spark.createDataFrame(docs, DOCS), spark.createDataFrame(asks, ASKS)
    found = SE.bm25(whole, asked, 5, task_rows=rows)
    assert lists(found) == lists(SE.bm25(whole.repartition(3), asked, 5))
    assert reads(found, "text") == 0


def test_tasks_grow_with_the_postings(spark):
    for n, tasks in ((50, 4), (1000, 10)):
        postings = spark.range(n).withColumnRenamed("id", "doc_id")
        plan = SE.by_document(postings, 100)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.splitlines()[0].rstrip().endswith(f", {tasks}")


def test_texts_are_scanned_once_more_for_the_pairs_that_met(spark, tmp_path):
    texts = [(i, f"word{i % 7} some text number{i} here") for i in range(40)]
    spark.createDataFrame(texts, "doc_id long, haystack string").write.parquet(f"{tmp_path}/t")
    asked = spark.createDataFrame(
        [(1, "some text number3 here"), (2, "number9 h"), (3, "text"), (4, "xt"), (5, ""), (6, "some absent text")],
        "query_id long, needle string")
    stored = spark.read.parquet(f"{tmp_path}/t")
    found = SE.holding(asked, stored)
    want = {(q, d) for q, n in [tuple(r) for r in asked.collect()] for d, h in texts if n and n in h}
    assert {tuple(r) for r in found.collect()} == want
    assert reads(found, "haystack") == 1
