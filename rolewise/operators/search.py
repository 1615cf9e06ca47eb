"""Lexical, vector and fused search for a batch of queries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolewise import fixed_values as V
from rolewise.functions.text import token_list, tokens
from rolewise.operators.ranking import top_k
from rolewise.session import cut_lineage

#: Queries and vectors of a block.
QUERY_BLOCK = 1024
VECTOR_BLOCK = 8192
#: Rows of counted terms that leave a task at a time, and postings that one task scores.
OUT_ROWS = 1 << 16
TASK_ROWS = 1 << 18
# Equal documents must tie whatever order their terms were added in.
SCORE_GRID = 1e9


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, weight): a repeated term counts as often as it is typed."""
    return (
        queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("weight"))
    )


def term_counts(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, length, term, tf): the terms of whole texts, counted where the text is read.

    A document has a row for the empty term too, which no text holds, so that its
    length is known without any other.
    """
    types = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, "text").mapInArrow(_counted(keys), f"{types}, length int, term string, tf long")


def _counted(keys: list[str]):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lengths, terms, tfs = [], [], [], []

            def rows() -> pa.RecordBatch:
                index = pa.array(at, pa.int32())
                return pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(index) for k in keys], pa.array(lengths, pa.int32()),
                     pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], [*keys, "length", "term", "tf"])

            for k, text in enumerate(batch.column("text")):
                counts = Counter(token_list(text.as_py()))
                length = counts.total()
                counts[""] = 1
                at += [k] * len(counts)
                lengths += [length] * len(counts)
                terms += counts.keys()
                tfs += counts.values()
                if len(at) >= OUT_ROWS:
                    yield rows()
                    at, lengths, terms, tfs = [], [], [], []
            yield rows()

    return counted


def by_document(postings: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Stored postings dealt by document to as many tasks as their number asks for."""
    least = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return postings.repartition(max(least, -(-postings.count() // task_rows)), "doc_id")


def bm25(docs: DataFrame, queries: DataFrame, limit: int = 10, k1: float = V.BM25_K1,
         b: float = V.BM25_B, tie: str = "doc_id", task_rows: int = TASK_ROWS) -> DataFrame:
    """Top documents per query with score, rank and matched terms.

    Whole texts are tokenised, once. Only postings of asked terms are written, as
    the size of the corpus, the document frequencies and the scores all need them.
    They are then dealt by document, so that a document meets all its queries in one
    task and only the best of a task are shuffled; the number of tasks grows with
    the postings, so what one of them holds does not.
    """
    spark = docs.sparkSession
    keys = ["doc_id", *({tie} - {"doc_id"})]
    asked = cut_lineage(query_terms(queries), "asked")
    wanted = cut_lineage(asked.select("term").union(spark.range(1).select(F.lit(""))).distinct(), "wanted")
    counted = term_counts(docs, keys)
    stored = cut_lineage(counted.join(wanted, "term", "left_semi"), "postings")
    n, mean = stored.where("term = ''").agg(F.count("*"), F.avg("length")).first()
    postings = stored.where("term <> ''")
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = cut_lineage(asked.join(frequency, "term").withColumn("n", F.lit(n)).select(
        "query_id", "term", (F.col("weight") * idf).alias("idf")), "weights")
    spread = k1 * (1 - b + b * F.greatest(F.col("length"), F.lit(1)) / F.col("mean"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + spread)
    scored = (
        by_document(postings, task_rows).join(weighted, "term")
        .withColumn("mean", F.lit(mean or 0.0))
        .groupBy("query_id", *keys)
        .agg(F.sum(part).alias("raw"), F.array_sort(F.collect_set("term")).alias("matched_terms"))
        .withColumn("score", F.floor(F.col("raw") * SCORE_GRID + 0.5) / SCORE_GRID)
        .where("score > 0")
        .drop("raw")
    )
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc(tie)], limit)


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int,
                 query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """Nearest vectors per query by inner product of unit vectors.

    Vectors and queries are dealt into blocks; every pair of blocks is one
    bounded group with one matrix product, which keeps its own k best per query.
    The global top-k follows. Nothing passes the driver but the two counts that
    say how many blocks there are. Rows without a vector are skipped.
    """
    held = vectors.where("embedding IS NOT NULL").select("doc_id", "embedding")
    asked = queries.where("embedding IS NOT NULL").select(
        F.col("query_id").alias("query_id"), F.col("embedding").alias("asked"))
    wide, deep = (max(1, -(-frame.count() // size)) for frame, size in (
        (held, vector_block), (asked, query_block)))

    def dealt(frame: DataFrame, key: str, mine: str, own: int, other: str, others: int) -> DataFrame:
        return frame.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(own))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))

    left = dealt(held, "doc_id", "v", wide, "q", deep)
    right = dealt(asked, "query_id", "q", deep, "v", wide)

    types = [f.schema[c].dataType.simpleString() for f, c in ((asked, "query_id"), (held, "doc_id"))]
    pairs = left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInPandas(
        best_of_block(k), f"query_id {types[0]}, doc_id {types[1]}, score double")
    return top_k(pairs, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def best_of_block(k: int):
    """The k best vectors of each query within a pair of blocks: one matrix product."""
    def best(docs: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if docs.empty or asks.empty:
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        similar = np.floor(unit(docs["embedding"]) @ unit(asks["asked"]).T * SCORE_GRID + 0.5) / SCORE_GRID
        doc, ids = docs["doc_id"].to_numpy(), asks["query_id"].to_numpy()
        order = np.lexsort((np.broadcast_to(doc[:, None], similar.shape), -similar), axis=0)
        keep = order[: min(k, len(doc))]
        column = np.broadcast_to(np.arange(len(ids)), keep.shape)
        return pd.DataFrame({
            "query_id": ids[column.ravel()], "doc_id": doc[keep.ravel()],
            "score": similar[keep.ravel(), column.ravel()],
        })

    return best


def unit(rows: pd.Series) -> np.ndarray:
    matrix = np.stack(rows.to_numpy()).astype("float64")
    norm = np.linalg.norm(matrix, axis=1)
    return matrix / np.where(norm == 0, 1.0, norm)[:, None]


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of `size` characters; none for a shorter text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.array_distinct(F.filter(
        F.transform(starts, lambda at: F.substr(text, at, F.lit(size))), lambda g: F.length(g) == size))


def holding(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, doc_id) of texts that contain a whole passage.

    `passages` has (query_id, needle), `texts` (doc_id, haystack), words parted by
    single spaces. A word inside a passage is a whole word of every text that
    contains it, so a passage meets texts through the rarest of its inner words
    only; one without inner words through the rarest of its trigrams, or as a
    whole if it is no longer than that. An empty passage is in no text. Pairs are
    stored before the texts are read again, so that these are not shuffled for few.
    """
    asked = cut_lineage(passages.where("needle <> ''"), "passages")
    words = F.split("needle", " ")
    inner = F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))
    parts = asked.select("query_id", "needle", F.when(F.size(inner) > 0, inner).alias("inner"))
    by_word = parts.where("inner IS NOT NULL").select("query_id", "needle", F.explode("inner").alias("key"))
    seen = texts.select("doc_id", F.explode(F.array_distinct(F.split("haystack", " "))).alias("key"))
    pairs = _through_rarest(by_word, seen)
    bare = parts.where("inner IS NULL").select("query_id", "needle", F.least(F.length("needle"), F.lit(3)).alias("size"))
    for (size,) in bare.select("size").distinct().collect():  # at most the sizes 1, 2 and 3
        keys = bare.where(F.col("size") == size).select(
            "query_id", "needle", F.explode(_grams(F.col("needle"), size)).alias("key"))
        pairs = pairs.unionByName(_through_rarest(
            keys, texts.select("doc_id", F.explode(_grams(F.col("haystack"), size)).alias("key"))))
    met = cut_lineage(pairs, "met")
    return texts.join(met, "doc_id").where(F.contains("haystack", F.col("needle"))).select("query_id", "doc_id")


def _through_rarest(keys: DataFrame, seen: DataFrame) -> DataFrame:
    """(query_id, needle, doc_id) met through each passage's key with the fewest texts.

    A key that no text has rules its passage out. The texts are read once: what they
    have of the keys is stored.
    """
    wanted = cut_lineage(keys.select("key").distinct(), "keys")
    stored = cut_lineage(seen.join(wanted, "key", "left_semi"), "seen")
    counts = stored.groupBy("key").agg(F.count("*").alias("n"))
    picked = keys.join(counts, "key", "left").groupBy("query_id", "needle").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("p")).where("p.n > 0")
    chosen = cut_lineage(picked.select("query_id", "needle", F.col("p.key").alias("key")), "chosen")
    return chosen.join(stored, "key").select("query_id", "needle", "doc_id")


def rrf(rankings: dict[str, DataFrame], limit: int = 10, k: int = V.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, doc_id, rank)."""
    merged = None
    for method, ranking in rankings.items():
        rows = ranking.select("query_id", "doc_id", "rank", F.lit(method).alias("method"))
        merged = rows if merged is None else merged.unionByName(rows)
    fused = merged.groupBy("query_id", "doc_id").agg(
        (F.floor(F.sum(1 / (k + F.col("rank"))) * SCORE_GRID + 0.5) / SCORE_GRID).alias("score"),
        F.array_join(F.array_sort(F.collect_set("method")), "+").alias("method"),
    )
    return top_k(fused, ["query_id"], [F.desc("score"), F.asc("doc_id")], limit)


def search(docs: DataFrame, queries: DataFrame, vectors: DataFrame | None = None,
           limit: int = 10, lexical: DataFrame | None = None) -> DataFrame:
    """Hybrid search; without query or document vectors the lexical list alone.

    `lexical` may give the first 2 * `limit` of `bm25`, if they are known.
    """
    if vectors is None or "embedding" not in queries.columns:
        found = bm25(docs, queries, limit) if lexical is None else lexical.where(F.col("rank") <= limit)
        return found.select("query_id", "doc_id", "score", F.lit("bm25").alias("method"), "rank")
    if lexical is None:
        lexical = bm25(docs, queries, limit * 2)
    near = vector_top_k(vectors, queries, limit * 2)
    return rrf({"bm25": lexical, "vector": near}, limit)


def separability(pairs: DataFrame) -> DataFrame:
    """Lowest cosine of near pairs against the highest of unrelated ones."""
    near = F.min(F.when(F.col("kind") == "near", F.col("cosine")))
    far = F.max(F.when(F.col("kind") == "unrelated", F.col("cosine")))
    return pairs.agg(near.alias("lowest_near"), far.alias("highest_unrelated"),
                     (near > far).alias("separable"))


