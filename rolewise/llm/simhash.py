"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits. Cut into `BLOCKS` blocks, two fingerprints that
differ in at most `DISTANCE` bits agree in all but `DISTANCE` of the blocks, so
they share the key of at least one choice of BLOCKS - DISTANCE blocks. Exact
copies meet first: everything after works on distinct fingerprints, each with
its smallest doc_id.

Groups of a key with at most `PAIRED` members are joined with themselves and
each pair is verified. Larger groups would give pairs without end, so their
members are linked through the points between them: two fingerprints differ in
at most two bits exactly if some 64-bit value is within one bit of both. Each
member names the values within one bit of itself (only bits that differ within
its groups can matter), and all that name the same value are linked to the
smallest of them. Both ways lose no link and make none that is too far.

Cases: a null or empty text, or one of white space, has fingerprint zero and is
linked like any other; a null doc_id is left out of the result, as it can name
no component; rows of one doc_id with several texts keep one row each; an empty
table gives an empty result; further columns are carried by `representatives` and
ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolewise.llm.common import documents, slices, small_batches, unused, word_lists
from rolewise.operators.linkage import connected_components
from rolewise.session import cut_lineage

SEED = 42
SHINGLE = 3
BITS = 64
DISTANCE = 2
BLOCKS = 4
#: Members of a block key up to which its pairs are compared.
PAIRED = 16


def _counts(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit set, bit 0 first."""
    packed = np.array(hashes, dtype="<u8").view(np.uint8).reshape(len(hashes), 8)
    return np.unpackbits(packed, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of a whole text, words taken in bounded lists."""
    digest = xxhash.xxh64_intdigest
    total, ones, carried = 0, np.zeros(BITS, dtype=np.int64), []
    for words in word_lists((text or "").encode("utf-8").lower()):
        words = carried + words
        hashes = [digest(b" ".join(s), seed) for s in zip(*(words[k:] for k in range(width)))]
        if hashes:
            total += len(hashes)
            ones += _counts(hashes)
        carried = words[max(0, len(words) - width + 1):]
    if not total and carried:
        total, ones = 1, _counts([digest(b" ".join(carried), seed)])
    return sum(1 << k for k in np.flatnonzero(2 * ones > total).tolist())


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, sig, fp): the fingerprint as a signed long; `sig` is a hash of the text."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source):
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], dtype="u8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("sig"), pa.array(found.view("i8"))],
                names=["doc_id", "sig", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs.select("doc_id", F.xxhash64("text").alias("sig"), "text")).mapInArrow(
        batches, f"doc_id {kind}, sig bigint, fp bigint")


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """The bits kept by each choice of blocks, as signed longs."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    parts = [sum(1 << b for b in range(edges[k], edges[k + 1])) for k in range(blocks)]
    masks = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS,
          paired: int = PAIRED) -> DataFrame:
    """(u, v): fingerprints within `distance` bits, enough of them to connect all.

    `nodes` holds distinct fingerprints `fp`.
    """
    if distance != 2:
        raise ValueError("points between two fingerprints are worked out for a distance of 2")
    keys = F.array(*[
        F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for k, m in enumerate(block_masks(blocks, distance))])
    placed = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.table", "k.key")
    groups = cut_lineage(placed.groupBy("table", "key").agg(
        F.count("*").alias("n"),
        F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("varying"),
    ).where("n > 1"), "groups")
    members = cut_lineage(placed.join(groups, ["table", "key"]), "members")
    few = members.where(F.col("n") <= paired).select("table", "key", "fp")
    other = few.withColumnRenamed("fp", "v")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    pairs = few.withColumnRenamed("fp", "u").join(other, ["table", "key"]).where("u < v").where(near)
    crowded = members.where(F.col("n") > paired).groupBy("fp").agg(F.bit_or("varying").alias("varying"))
    around = F.expr(
        "concat(array(fp), transform(filter(sequence(0, 63), b -> (shiftright(varying, b) & 1) = 1),"
        " b -> fp ^ shiftleft(1L, b)))")
    points = crowded.select("fp", F.explode(around).alias("point"))
    hubs = cut_lineage(points.groupBy("point").agg(
        F.min("fp").alias("v"), F.max("fp").alias("last")).where("v < last"), "hubs")
    through = points.join(hubs, "point").where("fp > v").select(F.col("fp").alias("u"), "v")
    return pairs.select("u", "v").unionByName(through).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, sig, fp, component_id): the smallest doc_id that links lead to."""
    prints = cut_lineage(fingerprints(docs).where("doc_id IS NOT NULL"), "prints")
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    edges = links(nodes.select("fp"))
    named = edges.join(nodes.select(F.col("fp").alias("u"), F.col("node").alias("a")), "u").join(
        nodes.select(F.col("fp").alias("v"), F.col("node").alias("b")), "v").select(
        F.col("a").alias("u"), F.col("b").alias("v"))
    members = connected_components(named)
    classes = nodes.join(members, "node", "left").select(
        "fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(classes, "fp")


def representatives(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all columns.

    Documents without an id belong to no group and stay. `found` are groups like
    those of `near_duplicates`, which is the default.
    """
    of, sig, text_sig = (unused(n, docs) for n in ("kept_id", "kept_sig", "text_sig"))
    found = near_duplicates(docs) if found is None else found
    kept = found.where("doc_id = component_id").groupBy(
        F.col("doc_id").alias(of)).agg(F.min("sig").alias(sig))
    marked = docs.withColumn(text_sig, F.xxhash64("text"))
    named = marked.where("doc_id IS NOT NULL").join(
        kept, F.expr(f"doc_id = {of} AND {text_sig} = {sig}"), "left_semi")
    single = named.dropDuplicates(["doc_id", text_sig])
    return single.unionByName(marked.where("doc_id IS NULL")).select(*[F.col(f"`{c}`") for c in docs.columns])


def hexadecimal(fp: Column) -> Column:
    """16 lowercase hex digits of a long taken as unsigned."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op10_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
