"""An index for vector search: coarse centroids with an inverted list each.

The exact search (`search.vector_top_k`) compares every query with every vector.
Here a query opens only the lists of its nearest centroids, in which it is
compared exactly. How many lists that takes is not guessed: the true neighbours
of some queries are found once, and the number is the smallest that holds the
asked share of them (`probes_for`). The index is written once and read by any
number of query batches.

Centroids are k-means (cosine) over a sample of at most `SAMPLE_PER_LIST` vectors
a list; every vector is indexed. A long list, of many copies or of one crowded
place, is stored in pieces of about `PIECE` vectors, each a group of its own.
Vectors that are null or empty are in no list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolewise.operators.ranking import top_k
from rolewise.operators.search import QUERY_BLOCK, best_of_block, unit, vector_top_k
from rolewise.session import cut_lineage

MAX_LISTS = 4096
SAMPLE_PER_LIST = 64
PIECE = 8192
RECALL = 0.9
#: Queries whose true neighbours are found to choose the number of lists.
TUNING_QUERIES = 64


@dataclass(frozen=True)
class VectorIndex:
    """Unit centroids, and a stored table (doc_id, embedding, list, piece)."""

    centroids: np.ndarray
    rows: DataFrame


def _ordered_lists(vectors: DataFrame, centroids: np.ndarray, count: int) -> DataFrame:
    """The rows with `lists`, their `count` nearest centroids, nearest first."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("array<int>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            off = -(unit(batch) @ sent.value.T)
            yield pd.Series(list(np.argsort(off, axis=1, kind="stable")[:, :count].astype("int32")))

    return vectors.withColumn("lists", nearest("embedding"))


def build(vectors: DataFrame, lists: int | None = None, seed: int = 1) -> VectorIndex:
    """Index (doc_id, embedding); about the square root of the number of vectors as lists."""
    held = vectors.where("size(embedding) > 0").select("doc_id", "embedding")
    total = held.count()
    lists = lists or max(1, min(MAX_LISTS, round(total ** 0.5)))
    share = min(1.0, lists * SAMPLE_PER_LIST / max(1, total))
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    sample = held.where(place <= share).orderBy(place).limit(lists * SAMPLE_PER_LIST).select(
        array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features")).where(
        F.exists(F.col("embedding"), lambda x: x != 0))
    if lists == 1 or sample.limit(2).count() < 2:
        width = held.select(F.size("embedding")).first()
        centroids = np.zeros((1, width[0] if width else 1))
    else:
        model = KMeans(k=lists, seed=seed, maxIter=10, distanceMeasure="cosine").fit(cut_lineage(sample, "sample"))
        centroids = np.array(model.clusterCenters())
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1), 1e-12)[:, None]
    listed = cut_lineage(_ordered_lists(held, centroids, 1).select(
        "doc_id", "embedding", F.col("lists")[0].alias("list")), "listed")
    sizes = listed.groupBy("list").agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
    rows = listed.join(sizes, "list").select(
        "doc_id", "embedding", "list", F.pmod(F.xxhash64("doc_id"), F.col("pieces")).alias("piece"))
    return VectorIndex(centroids, cut_lineage(rows.repartitionByRange("list", "piece"), "index"))


def probes_for(index: VectorIndex, queries: DataFrame, k: int, recall: float = RECALL) -> int:
    """Lists to open so that `recall` of the true k neighbours of the queries are in them.

    True neighbours of up to TUNING_QUERIES queries come from the exact search; a
    neighbour is found from as many lists on as its own stands in the query's order.
    """
    some = queries.where("size(embedding) > 0").orderBy(F.xxhash64("query_id"), "query_id").limit(TUNING_QUERIES)
    some = cut_lineage(some.select("query_id", "embedding"), "tuning")
    truth = vector_top_k(index.rows.select("doc_id", "embedding"), some, k).select("query_id", "doc_id")
    opened = _ordered_lists(some, index.centroids, len(index.centroids)).select("query_id", "lists")
    met = truth.join(index.rows.select("doc_id", "list"), "doc_id").join(opened, "query_id")
    at = F.array_position("lists", F.col("list"))
    counts = met.groupBy(at.alias("at")).agg(F.count("*").alias("n")).orderBy("at").collect()
    total, seen = sum(r["n"] for r in counts), 0
    for r in counts:
        seen += r["n"]
        if seen >= recall * total:
            return int(r["at"])
    return 1


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the k nearest vectors in the opened lists."""
    asked = queries.where("size(embedding) > 0").select("query_id", "embedding")
    opened = _ordered_lists(asked, index.centroids, probes).select(
        "query_id", F.col("embedding").alias("asked"), F.explode("lists").alias("list"))
    # As many blocks of queries as the most asked list needs, pieces as they are stored.
    wanted = opened.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
    pieces = index.rows.select("list", "piece").distinct().join(wanted, "list")
    left = index.rows.join(wanted, "list").select(
        "doc_id", "embedding", "list", "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    right = opened.join(pieces, "list").select(
        "query_id", "asked", "list", "piece", F.pmod(F.xxhash64("query_id"), F.col("blocks")).alias("block"))
    right = right.toDF(*right.columns)  # columns of its own: both sides hold keys of the index
    kinds = [f.schema[c].dataType.simpleString() for f, c in ((opened, "query_id"), (index.rows, "doc_id"))]
    keys = ("list", "piece", "block")
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        best_of_block(k), f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
    return top_k(pairs, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(recall, neighbours): the share of the exact neighbours that were found."""
    hits = exact.select("query_id", "doc_id").join(
        found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return hits.agg((F.count("hit") / F.count("*")).alias("recall"), F.count("*").alias("neighbours"))
