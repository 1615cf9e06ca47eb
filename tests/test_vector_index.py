"""The vector index against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolewise.operators import search as SE
from rolewise.operators import vector_index as VI

SCHEMA = "doc_id long, embedding array<float>"


def test_recall_on_the_supplied_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(
        F.col("vec_id").alias("doc_id"), "embedding")
    asked = table.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    index = VI.build(table)
    assert index.rows.count() == table.count() and len(index.centroids) > 20
    probes = VI.probes_for(index, asked, 10, 0.95)
    assert probes <= len(index.centroids)
    exact = SE.vector_top_k(table, asked, 10)
    row = VI.recall(VI.search(index, asked, 10, probes), exact).first()
    assert row.recall >= 0.9 and row.neighbours == 10 * asked.count()


@pytest.fixture(scope="module")
def crowded():
    pick = np.random.default_rng(3)
    centres = pick.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.2 * pick.normal(size=16)]) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # a third of all are copies of one vector
    return rows + [(5000, None), (5001, []), (5002, [0.0] * 16)]


def test_all_lists_give_the_exact_result(spark, crowded, monkeypatch):
    monkeypatch.setattr(VI, "PIECE", 50)
    monkeypatch.setattr(VI, "QUERY_BLOCK", 8)
    table = spark.createDataFrame(crowded, SCHEMA)
    asked = table.where("doc_id < 40").withColumnRenamed("doc_id", "query_id")
    index = VI.build(table, lists=10)
    pieces = index.rows.groupBy("list", "piece").count().collect()
    assert sum(r["count"] for r in pieces) == 901 and max(r["count"] for r in pieces) < 150
    exact = SE.vector_top_k(table.where("size(embedding) > 0"), asked, 7)
    key = lambda df: sorted((r.query_id, r["rank"], r.doc_id) for r in df.collect())
    assert key(VI.search(index, asked, 7, len(index.centroids))) == key(exact)
    few = VI.search(index, asked, 7, VI.probes_for(index, asked, 7))
    assert VI.recall(few, exact).first().recall >= 0.85


def test_small_tables(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 0.0])], [(1, [0.0, 0.0]), (2, [0.0, 1.0])]):
        table = spark.createDataFrame(rows, SCHEMA)
        index = VI.build(table)
        asked = spark.createDataFrame([(9, [0.0, 1.0])], "query_id long, embedding array<float>")
        got = VI.search(index, asked, 3, VI.probes_for(index, asked, 3)).collect() if index.centroids.shape[1] == 2 else []
        assert len(got) == sum(bool(v) for _, v in rows)


@pytest.mark.parametrize("block", [2048, 7])
def test_similar_skills_equal_all_pairs(spark, block):
    from rolewise.operators import ontology as O

    pick = np.random.default_rng(8)
    centres = pick.normal(size=(6, 12))
    vectors = {f"s{i}": (centres[i % 6] + 0.35 * pick.normal(size=12)).tolist() for i in range(40)}
    frame = spark.createDataFrame([*vectors.items(), ("none", None), ("empty", [])], "skill string, embedding array<double>")
    got = {(r.required, r.held): r.cosine for r in O.similar_skills(frame, block=block).collect()}
    cosine = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = {(a, b): cosine(vectors[a], vectors[b]) for a in vectors for b in vectors if a != b}
    assert got == pytest.approx({k: c for k, c in want.items() if c > 0.7}, abs=1e-8) and len(got) > 50


def test_semantic_degree_counts_where_it_is_larger(spark):
    from dataclasses import replace

    from rolewise.operators import ontology as O
    from rolewise.operators import scoring as SC
    from tests import hiring as H

    tables = H.tables(spark)
    similar = spark.createDataFrame([("fastapi", "python", 0.95), ("docker", "kubernetes", 0.71)],
                                    "required string, held string, cosine double")
    wider = replace(tables, relatedness=O.with_semantic(tables.relatedness, similar))
    rows = {(r.application_id, r.required): r for r in SC.match_skills(wider, H.REF_YEAR).collect()}
    before = {(r.application_id, r.required): r for r in SC.match_skills(tables, H.REF_YEAR).collect()}
    assert rows["a4", "fastapi"].method == "semantic" and rows["a4", "fastapi"].degree == pytest.approx(0.8 * 0.25 / 0.3)
    assert rows["a2", "docker"].degree == max(before["a2", "docker"].degree, 0.8 * 0.01 / 0.3)
