"""Deletion of repeated runs of lines by winnowing over line hashes.

A line ends at a line feed or behind the sentence mark before a space, as
passages are often set into other text without line feeds. A run of consecutive
lines with at least `MIN_WORDS` words is repeated if an equal run starts earlier,
in a smaller doc_id or further up in the same text; every line of a repeated run is deleted, the first
occurrence stays.

A window is a shortest run with enough words, one from every line forwards and
one backwards. Each repeated run is the union of repeated windows, and the
smallest line hash of a window depends on the window alone, so two equal windows
always select the same fingerprint. Only the selected fingerprints of all
documents are counted. Where one occurs twice, the windows that selected it are
joined by content with their first occurrence; overlapping windows extend a
match both ways to the ends of the run. Fingerprints and windows are grouped by
minimum and count, never gathered.

Cases: null texts stay null, and texts with fewer words than a run stay as they
are; lines without a word are no part of a run and are kept; rows with the same
doc_id are not compared with each other; a null doc_id comes after all others; a
text may lose all its lines and is then empty (`deduplicated`
leaves such documents out); an empty table gives an empty result; further columns
are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolewise.llm.common import documents, slices, small_batches, unused
from rolewise.session import cut_lineage

MIN_WORDS = 25


def split_lines(data: bytes) -> list[bytes]:
    """The lines of a text; one byte, a line feed or a space, stands behind each but the last."""
    for mark in (b".", b"!", b"?"):
        data = data.replace(mark + b" ", mark + b"\n")
    return data.split(b"\n")


def line_hashes(data: bytes) -> tuple[list[int], list[int]]:
    """Hashes and numbers of words of the lines that have a word."""
    digest, hashes, words = xxhash.xxh64_intdigest, [], []
    for line in split_lines(data):
        n = len(line.split())
        if n:
            hashes.append(digest(line.strip()))
            words.append(n)
    return hashes, words


def windows(words: np.ndarray, least: int, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and last lines of the shortest runs with `least` words, both ways.

    Lines of several documents may stand one after the other, `sizes` lines of
    each; no run reaches over the end of a document.
    """
    upto = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    sizes = np.array([n]) if sizes is None else sizes
    ends = np.repeat(np.cumsum(sizes), sizes)
    begins = ends - np.repeat(sizes, sizes)
    last = np.searchsorted(upto, upto[:-1] + least) - 1
    first = np.searchsorted(upto, upto[1:] - least, side="right") - 1
    lines = np.arange(n)
    forward, backward = last < ends, (first >= begins) & (upto[1:] >= least)
    both = np.concatenate([lines[forward] * n + last[forward], first[backward] * n + lines[backward]])
    both = np.unique(both)
    return both // max(n, 1), both % max(n, 1)


def lowest(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The smallest hash of each window, by minima over powers of two."""
    out = np.empty(len(first), dtype=np.int64)
    size, level, row = last - first + 1, 0, hashes
    while len(first):
        now = (size >> level) == 1
        out[now] = np.minimum(row[first[now]], row[last[now] - (1 << level) + 1])
        level += 1
        if 1 << level > size.max():
            break
        row = np.minimum(row[:-(1 << (level - 1))], row[1 << (level - 1):])
    return out


def line_tables(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, sig, hashes, words, marks) of documents long enough for a run.

    `marks` are the selected fingerprints, once more if several lines of the
    document have them.
    """
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source):
            kept, hashes, words, sizes = [], [], [], []
            for at, text in enumerate(batch.column("text")):
                h, w = line_hashes(text.as_py().encode("utf-8"))
                if sum(w) >= least:
                    kept.append(at)
                    sizes.append(len(h))
                    hashes += h
                    words += w
            h, w = np.array(hashes, dtype="u8").view("i8"), np.array(words, dtype=np.int64)
            sizes = np.array(sizes, dtype=np.int64)
            first, last = windows(w, least, sizes)
            low = lowest(h, first, last)
            bounds = np.append(0, np.cumsum(sizes))
            cuts = np.searchsorted(first, bounds)
            marks = []
            for a, b, c, d in zip(bounds, bounds[1:], cuts, cuts[1:]):
                selected, values = np.unique(low[c:d]), h[a:b]
                if len(set(hashes[a:b])) < b - a:
                    values, counts = np.unique(values, return_counts=True)
                    selected = np.append(selected, np.intersect1d(selected, values[counts > 1]))
                marks.append(selected)
            picked = batch.select(["doc_id", "sig"]).take(pa.array(kept, pa.int32()))
            ends = pa.array(bounds, pa.int32())
            yield pa.RecordBatch.from_arrays([
                picked.column("doc_id"), picked.column("sig"),
                pa.ListArray.from_arrays(ends, pa.array(h)),
                pa.ListArray.from_arrays(ends, pa.array(w, pa.int32())),
                pa.array(marks, pa.list_(pa.int64())),
            ], names=["doc_id", "sig", "hashes", "words", "marks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs.where("text IS NOT NULL").select("doc_id", signature(), "text")).mapInArrow(
        batches, f"doc_id {kind}, sig int, hashes array<bigint>, words array<int>, marks array<bigint>")


def signature() -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return (F.crc32("text") - (1 << 31)).cast("int").alias("sig")


def same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["sig"] == right["sig"])


def _flat(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def candidate_windows(tables: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(window, doc_id, sig, run, again): windows whose fingerprint occurs elsewhere.

    `run` holds the first line in its upper and the last in its lower half;
    `again` is true if the window stands in the same document before.
    """
    marks = tables.select("doc_id", "sig", F.explode("marks").alias("mark"))
    # Written, so that a join with it can be split where a mark is frequent.
    counts = cut_lineage(marks.groupBy("mark").count().where("count > 1").select("mark"), "marks")
    shared = marks.join(counts, "mark", "left_semi")
    asked = shared.groupBy("doc_id", "sig").agg(F.collect_set("mark").alias("shared"))
    asked = asked.select(F.col("doc_id").alias("of"), F.col("sig").alias("of_sig"), "shared")
    rows = tables.select("doc_id", "sig", "hashes", "words").join(
        asked, F.expr("doc_id <=> of AND sig = of_sig"))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source):
            h, w = _flat(batch.column("hashes")), _flat(batch.column("words")).astype(np.int64)
            sizes = np.array(batch.column("hashes").value_lengths())
            first, last = windows(w, least, sizes)
            # What is shared in one document of the slice is so in all of them.
            found = np.isin(lowest(h, first, last), _flat(batch.column("shared")))
            first, last, raw = first[found], last[found], h.astype("<i8").tobytes()
            keys = np.array([xxhash.xxh64_intdigest(raw[8 * a:8 * b + 8])
                             for a, b in zip(first.tolist(), last.tolist())], dtype="u8").view("i8")
            begins = np.cumsum(sizes) - sizes
            owner = np.searchsorted(begins + sizes, first, side="right")
            order = np.lexsort((first, keys, owner))
            again = np.zeros(len(keys), dtype=bool)
            again[order[1:]] = (np.diff(keys[order]) == 0) & (np.diff(owner[order]) == 0)
            picked = batch.select(["doc_id", "sig"]).take(pa.array(owner))
            run = (first - begins[owner] << 32) + last - begins[owner]
            yield pa.RecordBatch.from_arrays([
                pa.array(keys), picked.column("doc_id"), picked.column("sig"),
                pa.array(run, pa.int64()), pa.array(again),
            ], names=["window", "doc_id", "sig", "run", "again"])

    kind = tables.schema["doc_id"].dataType.simpleString()
    return small_batches(rows.select("doc_id", "sig", "hashes", "words", "shared")).mapInArrow(
        batches, f"window bigint, doc_id {kind}, sig int, run bigint, again boolean")


def repeated_runs(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, sig, runs): the runs to delete, perhaps overlapping, packed like `run`.

    Equal windows are told by 64 bits over 64-bit line hashes.
    """
    tables = cut_lineage(line_tables(docs, least), "lines")
    rows = cut_lineage(candidate_windows(tables, least), "windows")
    firsts = cut_lineage(rows.groupBy("window").agg(
        F.min("doc_id").alias("origin"), F.max("doc_id").alias("final"),
        F.max(F.col("doc_id").isNull()).alias("nameless"),
    ).where("origin < final OR (nameless AND origin IS NOT NULL)").select("window", "origin"), "firsts")
    later = rows.where(~F.col("again")).join(firsts, "window").where(
        F.col("doc_id").isNull() | (F.col("doc_id") > F.col("origin")))
    gone = rows.where("again").select("doc_id", "sig", "run").unionByName(
        later.select("doc_id", "sig", "run"))
    # A set: copies of a row have the same runs, and each copy gets them all.
    return gone.groupBy("doc_id", "sig").agg(F.collect_set("run").alias("runs"))


def without(data: bytes, runs: np.ndarray) -> tuple[bytes, int, int]:
    """(text without the runs, lines deleted, words deleted)."""
    lines = split_lines(data)
    gone = np.zeros(len(lines) + 1, dtype=np.int64)
    np.add.at(gone, runs >> 32, 1)
    np.subtract.at(gone, (runs & 0xFFFFFFFF) + 1, 1)
    inside = (np.cumsum(gone) > 0).tolist()
    kept, at, here, deleted, words = [], 0, 0, 0, 0
    for line in lines:
        n, start = len(line.split()), here
        here += len(line) + 1
        if n:
            at += 1
            if inside[at - 1]:
                deleted += 1
                words += n
                continue
        kept.append(data[start:here])
    return b"".join(kept), deleted, words


def delete_runs(docs: DataFrame, least: int = MIN_WORDS,
                names: tuple[str, str] = ("n_deleted_lines", "n_deleted_words")) -> DataFrame:
    """The documents with their texts cut, and what was deleted in two more columns."""
    names = tuple(unused(n, docs) for n in names)
    of, of_sig, runs, sig = (unused(n, docs) for n in ("runs_of", "runs_sig", "runs", "sig"))
    found = repeated_runs(docs.select("doc_id", "text"), least).select(
        F.col("doc_id").alias(of), F.col("sig").alias(of_sig), F.col("runs").alias(runs))
    joined = docs.withColumn(sig, signature()).join(
        found, F.expr(f"doc_id <=> {of} AND {sig} = {of_sig}"), "left")
    columns = docs.columns

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source):
            lines = np.zeros(batch.num_rows, dtype=np.int64)
            words, cut, texts = lines.copy(), batch.column(runs).is_valid(), []
            for k in np.flatnonzero(cut.to_numpy(zero_copy_only=False)).tolist():
                data = batch.column("text")[k].as_py().encode("utf-8")
                left, lines[k], words[k] = without(data, batch.column(runs)[k].values.to_numpy())
                texts.append(left.decode("utf-8"))
            text = pc.replace_with_mask(batch.column("text"), cut, pa.array(texts, pa.string()))
            arrays = [text if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(lines), pa.array(words)], names=[*columns, *names])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema],
                        *[f"`{n}` bigint" for n in names]])
    return small_batches(joined.select(*[docs[c] for c in columns], runs)).mapInArrow(batches, schema)


def deduplicated(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """The documents with their columns, texts cut; those that lost every word are left out."""
    lines = unused("n_deleted_lines", docs)
    cut = delete_runs(docs, least)
    has_word = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cut.where((F.col(lines) == 0) | has_word).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delete_runs(documents(spark, sf_dir)).select(
        "doc_id", "n_deleted_lines", "n_deleted_words", "text")


OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, text, string_split(replace(replace(replace(
           text, '. ', '.' || chr(10)), '! ', '!' || chr(10)), '? ', '?' || chr(10)), chr(10)) AS parts
  FROM documents
), p AS (
  SELECT doc_id, text, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM d
), l AS (
  SELECT *, len(regexp_extract_all(part, '[^\x20\x09-\x0D]+')) AS words,
         regexp_replace(regexp_replace(part, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS bare,
         sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY place) AS until
  FROM p
), u AS (
  SELECT doc_id, place, bare, words, row_number() OVER w AS line, sum(words) OVER w AS upto
  FROM l WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY place)
), s AS (
  SELECT a.doc_id, a.line AS first, min(b.line) AS last FROM u a JOIN u b
    ON a.doc_id = b.doc_id AND b.line BETWEEN a.line AND a.line + {MIN_WORDS - 1}
  WHERE b.upto - a.upto + a.words >= {MIN_WORDS} GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.line), b.line FROM u a JOIN u b
    ON a.doc_id = b.doc_id AND a.line BETWEEN b.line - {MIN_WORDS - 1} AND b.line
  WHERE b.upto - a.upto + a.words >= {MIN_WORDS} GROUP BY b.doc_id, b.line
), t AS (SELECT doc_id, list(bare ORDER BY line) AS bares FROM u GROUP BY 1
), c AS (
  SELECT doc_id, first, last, array_to_string(bares[first:last], chr(10)) AS content
  FROM s JOIN t USING (doc_id)
), r AS (
  SELECT doc_id, first, last, min(doc_id) OVER (PARTITION BY content) < doc_id
           OR min(first) OVER (PARTITION BY content, doc_id) < first AS again FROM c
), g AS (
  SELECT DISTINCT u.doc_id, u.place FROM u JOIN r
    ON r.again AND u.doc_id = r.doc_id AND u.line BETWEEN r.first AND r.last
), k AS (
  SELECT l.doc_id, l.place, words, g.place IS NOT NULL AS gone,
         part || substr(text, until::BIGINT, 1) AS whole
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.place = g.place
), m AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_lines,
         coalesce(sum(words) FILTER (WHERE gone), 0)::BIGINT AS n_words,
         coalesce(string_agg(whole, '' ORDER BY place) FILTER (WHERE NOT gone), '') AS kept
  FROM k GROUP BY 1
)
SELECT doc_id, coalesce(n_lines, 0) AS n_deleted_lines, coalesce(n_words, 0) AS n_deleted_words,
       kept AS text
FROM documents LEFT JOIN m USING (doc_id)
"""
