"""Near-duplicates by the Jaccard similarity of word shingles.

Two documents are near when their sets of five-word shingles have a Jaccard
similarity of 0.8 or more. Such sets leave about 10 of 64 SimHash bits apart, and
over 16 in one pair of a hundred; pigeonhole blocks for that many bits keep 3 to 4
bits as a key and so compare nearly everything. Candidates are therefore found by
minima of hashes (MinHash): the share of equal minima of two sets is their
similarity. `ROWS` minima make a key, and the number of keys follows from the
recall asked for at the limit itself; pairs above it are found more often.

Documents with the same set meet first. Then every set of a key is held against
the smallest of its group, exactly, by shingles. Sets that this links need no
further comparison with each other; sets of groups that it leaves in several
components meet by the prefixes of their shingles, rarest first (`prefix_pairs`),
which no similar pair can fail. So every similar pair that shares a key is compared
or already linked, a large group of near copies costs one comparison a member, and
so does a large group of pages from one template that are not near.

Cases: a text of fewer than five words is one shingle; a null or empty text, or one
of white space, has an empty set, equal to other empty sets; a null doc_id is left
out of `near_duplicates` and stays in `representatives`; an empty table gives an
empty result; further columns are carried by `representatives`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolewise.llm import simhash
from rolewise.llm.common import slices, small_batches, word_lists
from rolewise.operators.linkage import connected_components
from rolewise.session import cut_lineage

SEED = 42
WIDTH = 5
SIMILARITY = 0.8
ROWS = 5
#: Share of the pairs of exactly the least similarity that must meet.
RECALL = 0.9995
#: Shingles whose minima are worked out together.
TOGETHER = 4096


def bands(similarity: float = SIMILARITY, rows: int = ROWS, recall: float = RECALL) -> int:
    """Keys of `rows` minima each that two sets need to meet with this probability."""
    if not 0 < similarity <= 1 or not 0 < recall < 1:
        raise ValueError("similarity must be in (0, 1] and recall in (0, 1)")
    missed = 1 - similarity ** rows
    return math.ceil(math.log(1 - recall) / math.log(missed)) if missed > 0 else 1


def shingles(text: str | None, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    digest = xxhash.xxh64_intdigest
    parts, carried = [], []
    for words in word_lists((text or "").encode("utf-8").lower()):
        words = carried + words
        hashes = [digest(b" ".join(s), seed) for s in zip(*(words[k:] for k in range(width)))]
        parts.append(np.unique(np.array(hashes, dtype=np.uint64)))
        carried = words[max(0, len(words) - width + 1):]
    if not any(len(p) for p in parts):
        parts = [np.array([digest(b" ".join(carried), seed)] if carried else [], dtype=np.uint64)]
    return np.unique(np.concatenate(parts))


def minima(found: np.ndarray, turns: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The smallest value of the hashes under each of the functions."""
    least = np.full(len(turns), np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(found), TOGETHER):
        part = found[None, start:start + TOGETHER] * turns[:, None]
        part += shifts[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def band_keys(found: np.ndarray, count: int, rows: int = ROWS) -> list[int]:
    """One signed key for each band; none for an empty set."""
    if not len(found):
        return []
    rng = np.random.default_rng(SEED)
    turns = rng.integers(0, 1 << 63, count * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 64, count * rows, dtype=np.uint64, endpoint=False)
    least = minima(found, turns, shifts).reshape(count, rows)
    # The number of the band is the seed, so that keys of different bands do not meet.
    return [xxhash.xxh64_intdigest(least[b].tobytes(), b) - (1 << 63) for b in range(count)]


def sketches(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, sig, fp, keys): hash of the text, hash of its set, keys of its bands."""
    count = bands(similarity)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source):
            prints, keys = [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), width)
                prints.append(xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63))
                keys.append(band_keys(found, count))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("sig"), pa.array(prints, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "sig", "fp", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs.select("doc_id", F.xxhash64("text").alias("sig"), "text")).mapInArrow(
        batches, f"doc_id {kind}, sig bigint, fp bigint, keys array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(fp, found): the shingles of one text of each wanted (doc_id, sig, fp)."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source):
            found = [shingles(t.as_py(), width).view("i8") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("fp"), pa.array(found, pa.list_(pa.int64()))], names=["fp", "found"])

    texts = docs.select("doc_id", "text").withColumn("sig", F.xxhash64("text")).join(
        wanted, ["doc_id", "sig"]).dropDuplicates(["fp"])
    return cut_lineage(small_batches(texts.select("fp", "text")).mapInArrow(
        batches, "fp bigint, found array<bigint>"), "sets")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("fp")).union(pairs.select("v")).distinct()


def _near(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (u, v) whose sets are similar enough."""
    half = cut_lineage(pairs.join(sets.select(F.col("fp").alias("v"), F.col("found").alias("b")), "v"), "half")
    both = half.join(sets.select(F.col("fp").alias("u"), F.col("found").alias("a")), "u")
    shared = F.size(F.array_intersect("a", "b"))
    return cut_lineage(both.where(
        shared >= F.lit(similarity) * (F.size("a") + F.size("b") - shared)).select("u", "v"), "near")


def prefix_pairs(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(u, v): all pairs of (fp, part, found) with different parts that can be similar.

    In one order of all shingles, rarest first, similar sets share a shingle among
    the first ones of both: the smaller set may miss n - ceil(2t / (1 + t) * n) of
    its shingles, the larger n - ceil(t * n). Shingles of a single set take places in
    that order but meet nothing, so pages of one template, alike in frequent shingles
    only, are not compared.
    """
    t = F.lit(similarity)
    least = lambda share: F.ceil(share * F.col("n") - 1e-9)
    rows = sets.select("fp", "part", F.size("found").alias("n"), F.explode("found").alias("shingle"))
    counts = cut_lineage(rows.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1"), "often")
    met = cut_lineage(rows.join(counts, "shingle"), "met")
    order = W.partitionBy("fp").orderBy("often", "shingle")
    of_set = W.partitionBy("fp")
    placed = met.withColumn(
        "place", F.row_number().over(order) + F.col("n") - F.count("*").over(of_set)
    ).where(F.col("place") <= F.col("n") - least(t) + 1)
    placed = cut_lineage(placed.select("shingle", "fp", "part", "n", "place"), "prefixes")
    small = placed.where(F.col("place") <= F.col("n") - least(2 * t / (1 + t)) + 1)
    small = small.select("shingle", *[F.col(c).alias(f"{c}_") for c in ("fp", "part", "n", "place")])
    needed = F.ceil(t / (1 + t) * (F.col("n") + F.col("n_")) - 1e-9)
    reach = F.least("place", "place_") + F.least(F.col("n") - F.col("place"), F.col("n_") - F.col("place_"))
    return placed.join(small, "shingle").where(
        (F.col("part") != F.col("part_"))
        & ((F.col("n_") < F.col("n")) | ((F.col("n_") == F.col("n")) & (F.col("fp_") < F.col("fp"))))
        & (F.col("n_") >= least(t)) & (reach >= needed)
    ).select(F.greatest("fp", "fp_").alias("u"), F.least("fp", "fp_").alias("v")).distinct()


def links(docs: DataFrame, nodes: DataFrame, width: int = WIDTH,
          similarity: float = SIMILARITY) -> DataFrame:
    """(u, v): similar sets, enough of them to connect all that share a key.

    `nodes` holds distinct sets: (fp, keys, first), `first` a document of each.
    """
    def sets_of(wanted: DataFrame) -> DataFrame:
        return _sets(docs, nodes.join(wanted, "fp", "left_semi").select("fp", "first.*"), width)

    placed = nodes.select("fp", F.explode("keys").alias("key"))
    groups = cut_lineage(placed.groupBy("key").agg(
        F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n"), "groups")
    members = cut_lineage(placed.join(groups, "key"), "members")
    tried = cut_lineage(members.where("fp > v").select(F.col("fp").alias("u"), "v").distinct(), "tried")
    near = _near(tried, sets_of(_ends(tried)), similarity)
    joined = connected_components(near)
    parts = cut_lineage(members.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select(
        "key", "fp", F.coalesce("component", "fp").alias("part")), "parts")
    apart = parts.groupBy("key").agg(
        F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select("key")
    split = cut_lineage(parts.join(apart, "key").select("fp", "part").distinct(), "split")
    sets = sets_of(split.select("fp"))
    rest = cut_lineage(prefix_pairs(sets.join(split, "fp"), similarity).join(
        tried, ["u", "v"], "left_anti"), "crossing")
    return near.unionByName(_near(rest, sets, similarity))


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, sig, fp, component_id): the smallest doc_id that links lead to."""
    prints = cut_lineage(sketches(docs, width, similarity).where("doc_id IS NOT NULL"), "prints")
    nodes = cut_lineage(prints.groupBy("fp").agg(
        F.min(F.struct("doc_id", "sig")).alias("first"), F.first("keys").alias("keys")), "nodes")
    members = connected_components(links(docs, nodes, width, similarity))
    parts = cut_lineage(nodes.select("fp", F.col("first.doc_id").alias("node")).join(
        members.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "node", F.coalesce("component", "fp").alias("part")), "parts")
    named = parts.groupBy("part").agg(F.min("node").alias("component_id"))
    classes = parts.join(named, "part").select("fp", "component_id")
    return prints.select("doc_id", "sig", "fp").join(classes, "fp")


def representatives(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all columns."""
    return simhash.representatives(docs, near_duplicates(docs, width, similarity))


def joined(*found: DataFrame) -> DataFrame:
    """(doc_id, sig, component_id): the groups that the links of several methods make together.

    Each of `found` has (doc_id, sig, component_id), the smallest doc_id of a group naming it.
    """
    found = tuple(cut_lineage(f.select("doc_id", "sig", "component_id"), "found") for f in found)
    ends = found[0].limit(0)
    for f in found:
        ends = ends.unionByName(f)
    pairs = ends.where("doc_id <> component_id").select(
        F.col("doc_id").alias("u"), F.col("component_id").alias("v")).distinct()
    members = connected_components(pairs)
    return found[0].select("doc_id", "sig").join(members.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "sig", F.coalesce("component", "doc_id").alias("component_id"))
