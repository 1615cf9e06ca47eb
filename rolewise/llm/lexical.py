r"""Ranked lexical search by dual trees.

Items (the queries) and documents are vectors over terms; a document's score for
an item is their inner product. Items stand in a tree, and so do the documents of
each chunk that a task reads; a node holds, for every term, the largest
coordinate below it. The product of an item node and a document node is then a
bound on every score between the two. Pairs of nodes are taken best first; a
pair whose bound is under the weakest k-th best score of its items is left, with
all items and documents below it. Only equal bounds are followed too, as a tie is
decided by doc_id, so the lists are exact.

1. Documents are read once: term counts, of terms that some item may have (a
   table of `SLOTS` bits says so, whatever the number of items), are written.
2. Numbers of documents per term, of documents and of terms come from these.
3. Distinct item texts are searched in blocks of about `BLOCK_BYTES`, one written
   search over the counts for each. A first search over about `SEEDS` documents
   gives k-th scores to start from; they are true lower bounds, and where the
   sample falls decides speed only. Tasks give their k best per item, of which
   the k best overall are taken.

Documents lie in a tree by the group of items they score best with, then by that
score, so that those with little in common with any item fill nodes with small
coordinates. Scores are whole numbers, exact in doubles up to 2**53; items so long
that a score may pass that are multiplied as 64-bit integers.

Cases: a null, empty or separator-only text has no term, so such a document counts
nowhere and such an item finds nothing; equal items get equal lists, and each row
of items its own; repeated documents rank as rows of their own; equal scores go by
doc_id (an integer), null last; fewer than k documents with a score above zero
give a shorter list; very long texts are counted in bounded pieces; empty tables
give an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolewise.llm.common import documents, pieces, small_batches
from rolewise.operators.ranking import top_k
from rolewise.session import cut_lineage

TOP = 20
#: Bits of the table that says which terms may stand in an item.
SLOTS = 1 << 20
BLOCK_BYTES = 64 << 10
SEEDS = 4096
#: Documents, or term counts, of which a task builds one tree.
CHUNK = 2048
CHUNK_ENTRIES = 1 << 19
ITEM_LEAF = 8
DOC_LEAF = 16
FAN = 8
#: Groups of items by which documents are laid out.
GROUPS = 16
EXACT = 1 << 53

#: Digits, letters (lower-cased) and all bytes of other characters stay, the rest becomes a space.
LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256))


def term_counts(data: bytes | None) -> Counter:
    """Terms of a whole text with how often each occurs."""
    found: Counter = Counter()
    for part in pieces(data or b""):
        found.update(part.translate(LETTERS).split())
    return found


def slot(term: bytes) -> int:
    return crc32(term) & (SLOTS - 1)


def contribution(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass(eq=False)
class Node:
    """A part of the items; `most` holds each term's largest coordinate."""

    items: np.ndarray
    most: np.ndarray
    children: list[Node] = field(default_factory=list)


def item_tree(rows: np.ndarray, items: np.ndarray | None = None) -> Node:
    """Items split by the term that divides them most evenly, down to ITEM_LEAF."""
    items = np.arange(len(rows)) if items is None else items
    root = Node(items, rows[items].max(axis=0))
    open_ = [root]
    while open_:
        node = open_.pop()
        if len(node.items) <= ITEM_LEAF:
            continue
        having = (rows[node.items] > 0).sum(axis=0)
        term = int(np.abs(2 * having - len(node.items)).argmin())
        left = rows[node.items, term] > 0
        if left.all() or not left.any():
            left = np.arange(len(node.items)) < len(node.items) // 2
        for part in (node.items[left], node.items[~left]):
            node.children.append(Node(part, rows[part].max(axis=0)))
        open_.extend(node.children)
    return root


def frontier(root: Node, n: int = GROUPS) -> list[Node]:
    """Up to n nodes that cover all items, the largest opened first."""
    found = [root]
    while len(found) < n:
        largest = max((x for x in found if x.children), key=lambda x: len(x.items), default=None)
        if largest is None or len(found) + 1 > n:
            break
        found.remove(largest)
        found.extend(largest.children)
    return found


class Search:
    """The k best documents of each item of a block, chunk by chunk."""

    def __init__(self, rows: np.ndarray, floors: np.ndarray, k: int) -> None:
        self.rows, self.k = rows, k
        self.root = item_tree(rows)
        groups = [rows[node.items].sum(axis=0, dtype=np.float64) for node in frontier(self.root)]
        self.groups = np.array(groups).T
        #: Weakest score that still counts, per item; a score must be above zero.
        self.least = np.maximum(floors, 1).astype(rows.dtype)
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in rows]
        self.scored = 0

    def add(self, ids: list[int | None], starts: np.ndarray, terms: np.ndarray, values: np.ndarray) -> None:
        """One chunk: document j has values[starts[j]:starts[j + 1]] at its terms, at least one."""
        if not ids:
            return
        affinity = np.add.reduceat(values[:, None] * self.groups[terms], starts[:-1], axis=0)
        group = affinity.argmax(axis=1)
        order = np.lexsort((-affinity[np.arange(len(ids)), group], group))
        sizes = np.diff(starts)[order]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(starts[:-1][order] - edges[:-1], sizes) + np.arange(edges[-1])
        terms, values = terms[take], values[take].astype(self.rows.dtype)
        ids = [ids[j] for j in order.tolist()]
        # Levels of the document tree, leaves first; node j of a level covers FAN nodes of the one below.
        leaf = np.repeat(np.arange(len(ids)) // DOC_LEAF, sizes)
        levels = [np.zeros((-(-len(ids) // DOC_LEAF), self.rows.shape[1]), dtype=self.rows.dtype)]
        np.maximum.at(levels[0], (leaf, terms), values)
        while len(levels[-1]) > 1:
            levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), FAN), axis=0))
        open_ = [(self.root, len(levels) - 1, 0, levels[-1][0] @ self.root.most)]
        while open_:
            node, level, at, bound = open_.pop()
            if bound < self.least[node.items].min():
                continue
            if level and (not node.children or len(node.items) <= ITEM_LEAF * FAN ** level):
                below = slice(at * FAN, (at + 1) * FAN)
                bounds = levels[level - 1][below] @ node.most
                for j in np.argsort(bounds, kind="stable").tolist():
                    open_.append((node, level - 1, at * FAN + j, bounds[j]))
            elif node.children:
                met = [(child, level, at, levels[level][at] @ child.most) for child in node.children]
                open_.extend(sorted(met, key=lambda x: x[3]))
            else:
                first, last = at * DOC_LEAF, min((at + 1) * DOC_LEAF, len(ids))
                self.score(node, ids[first:last], edges[first:last + 1], terms, values)

    def score(self, node: Node, ids: list[int | None], edges: np.ndarray, terms: np.ndarray, values: np.ndarray) -> None:
        part = slice(edges[0], edges[-1])
        products = self.rows[node.items][:, terms[part]] * values[part]
        scores = np.add.reduceat(products, edges[:-1] - edges[0], axis=1)
        self.scored += scores.size
        for row, item in enumerate(node.items.tolist()):
            good = np.flatnonzero(scores[row] >= self.least[item])
            if not len(good):
                continue
            # (score descending, known id first, id ascending)
            held = self.best[item] + [
                (-int(scores[row, j]), ids[j] is None, 0 if ids[j] is None else ids[j]) for j in good.tolist()]
            held.sort()
            self.best[item] = held = held[:self.k]
            if len(held) == self.k:
                self.least[item] = max(self.least[item], -held[-1][0])


def counted(docs: DataFrame, bits: bytes) -> DataFrame:
    """(doc_id, n, terms, tfs): documents with a term, and the counts of terms that `bits` lets through."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, last = sent.value, SLOTS - 1
        for batch in source:
            ids, sizes, terms, counts, edges = [], [], [], [], [0]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found = term_counts(text.as_py())
                if not found:
                    continue
                for term, tf in found.items():
                    if wanted[crc32(term) & last]:
                        terms.append(term)
                        counts.append(tf)
                ids.append(doc_id)
                sizes.append(found.total())
                edges.append(len(terms))
            at = pa.array(edges, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field("doc_id").type), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(at, pa.array(terms, pa.binary())),
                 pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs.select("doc_id", F.col("text").cast("binary").alias("text"))).mapInArrow(
        batches, f"doc_id {kind}, n bigint, terms array<binary>, tfs array<bigint>")


def asked_bits(texts: DataFrame) -> bytes:
    """A byte per slot, 1 where some item has a term of that slot."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            slots = {slot(t) for text in batch.column("text") for t in term_counts(text.as_py())}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(slots), pa.int32())], names=["slot"])

    found = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(batches, "slot int").distinct().toArrow()
    bits = np.zeros(SLOTS, dtype=np.uint8)
    bits[found.column("slot").to_numpy()] = 1
    return bits.tobytes()


def _found(held: DataFrame, columns: dict[bytes, int], rows: np.ndarray, floors: np.ndarray,
           n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best of each item."""
    sent = held.sparkSession.sparkContext.broadcast((columns, rows, floors))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, vectors, least = sent.value
        search = Search(vectors, least, k)
        ids: list[int | None] = []
        terms: list[np.ndarray] = []
        values: list[np.ndarray] = []
        kind, entries = None, 0

        def turn_in() -> None:
            nonlocal ids, terms, values, entries
            starts = np.concatenate([[0], np.cumsum([len(t) for t in terms], dtype=np.int64)])
            if ids:
                search.add(ids, starts, np.concatenate(terms), np.concatenate(values))
            ids, terms, values, entries = [], [], [], 0

        for batch in source:
            kind = batch.schema.field("doc_id").type
            lists, edges = batch.column("terms"), batch.column("terms").offsets.to_numpy()
            known = np.array([place.get(t, -1) for t in lists.values.to_pylist()], dtype=np.int64)
            tfs = batch.column("tfs").values.to_numpy()
            for j, (doc_id, n) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist())):
                mine = known[edges[j]:edges[j + 1]]
                hit = mine >= 0
                if not hit.any():
                    continue
                m = 75 + (25 * n * n_docs) // n_terms
                ids.append(doc_id)
                terms.append(mine[hit])
                values.append(contribution(tfs[edges[j]:edges[j + 1]][hit], np.int64(m)))
                entries += len(terms[-1])
                if len(ids) >= CHUNK or entries >= CHUNK_ENTRIES:
                    turn_in()
        turn_in()
        out = [(i, None if lost else d, -s) for i, best in enumerate(search.best) for s, lost, d in best]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), kind, pa.int64()))],
                names=["item", "doc_id", "score"])

    kind = held.schema["doc_id"].dataType.simpleString()
    return held.select("doc_id", "n", "terms", "tfs").mapInArrow(batches, f"item int, doc_id {kind}, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    return top_k(found, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k)


def _block(held: DataFrame, frequencies: DataFrame, texts: list[str], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(text_sha256, rank, doc_id, score) of the texts of one block."""
    spark = held.sparkSession
    asked = [term_counts(t.encode("utf-8")) for t in texts]
    wanted = spark.createDataFrame([(t,) for t in sorted(set().union(*asked))], "term binary")
    df = {bytes(r["term"]): r["df"] for r in frequencies.join(wanted, "term").collect()}
    columns = {t: c for c, t in enumerate(sorted(df))}
    weights = {t: weight(n_docs, n) for t, n in df.items()}
    longest = max((sum(weights.get(t, 0) * r for t, r in a.items()) for a in asked), default=0)
    rows = np.zeros((len(texts), max(1, len(columns))), dtype=np.float64 if longest * 1_000_000 < EXACT else np.int64)
    for i, counts in enumerate(asked):
        for term, repeats in counts.items():
            if term in columns:
                rows[i, columns[term]] = repeats * weights[term]
    floors = np.zeros(len(texts), dtype=np.int64)
    if n_docs > 4 * SEEDS:
        some = held.where(F.pmod(F.xxhash64("doc_id"), F.lit(n_docs // SEEDS)) == 0).coalesce(
            spark.sparkContext.defaultParallelism)
        first = _best(_found(some, columns, rows, floors, n_docs, n_terms, k), k).where(F.col("rank") == k)
        for r in first.select("item", "score").collect():
            floors[r["item"]] = r["score"]
    names = spark.createDataFrame(
        [(i, hashlib.sha256(t.encode("utf-8")).hexdigest()) for i, t in enumerate(texts)], "item int, text_sha256 string")
    best = _best(_found(held, columns, rows, floors, n_docs, n_terms, k), k)
    return best.join(names, "item").select("text_sha256", "rank", "doc_id", "score")


def ranked(items: DataFrame, docs: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents."""
    texts = items.where("text IS NOT NULL").select("text").distinct()
    held = cut_lineage(counted(docs, asked_bits(texts)), "counts")
    n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequencies = cut_lineage(
        held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-n_bytes // block_bytes))
    placed = texts.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    found = None
    for b in range(blocks):
        mine = sorted(r["text"] for r in placed.where(F.col("block") == b).select("text").collect())
        if not mine or not n_docs:
            continue
        lists = _block(held, frequencies, mine, n_docs, n_terms, k)
        # More than one block: each is searched and written before the next is sent out.
        lists = cut_lineage(lists, "lists") if blocks > 1 else lists
        found = lists if found is None else found.unionByName(lists)
    if found is None:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"),
                            F.lit(0).cast("bigint").alias("score")).limit(0)
    return items.select("item_id", F.sha2("text", 256).alias("text_sha256")).join(found, "text_sha256").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents(spark, sf_dir))


_TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
          r" '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

OP12_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL
), s AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
q AS MATERIALIZED (
  SELECT row, item_id, term, count(*) AS repeats FROM (
    SELECT row_number() OVER () AS row, item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL)
  GROUP BY ALL
), p AS MATERIALIZED (
  SELECT rid, doc_id, len, term, count(*) AS tf
  FROM (SELECT rid, doc_id, len(terms) AS len, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s
), c AS (
  SELECT row, item_id, rid, doc_id,
         sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len * n) // l))))::BIGINT AS score
  FROM p JOIN w USING (term) JOIN q USING (term), s GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {TOP}
"""
