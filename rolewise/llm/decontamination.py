"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and benchmark items are sequences of lower-cased words. A document is
contaminated by an item of N words if some stretch of it is within an edit
distance of N // 5 words of the item (similarity 0.8 or more).

Paths of a random walk drift apart with the number of edits, so long items are
searched by pieces of at least `PIECE` words: if every piece had more than a fifth of its words
edited, so would the item. Some piece is thus within a fifth of its own length,
whatever the length of the item and the kind of its edits.

The search runs over windows as long as a piece, one from every word. A random
walk (CGK) reads a window and stays on a word or moves on by a random bit of
(repetition, step, word), which turns a small edit distance into a small Hamming
distance of what is read. Some steps of the walk are sampled as the key of a
repetition; a window that meets a piece in any repetition is a candidate, and
the whole item is verified exactly around it. Before the walk, windows are left out
that cannot be near any piece: with at most d edits all but 3d of the piece's word
pairs must stand in the window.

The benchmark is the query set. Its distinct texts reach the tasks in blocks of bounded
size, one pass over the documents for each; what is found, not the documents, is joined
with the items.

Cases: a null or empty text has no match, nor has an item without a word; a null
doc_id or item_id is carried; rows that occur twice are reported twice; items of
fewer than five words must occur as they are; empty tables give an empty result;
further columns are carried by `decontaminated` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolewise.llm.common import documents, slices, small_batches, word_lists
from rolewise.session import cut_lineage

#: An item of N words may be changed by N // TOLERANCE edits.
TOLERANCE = 5
REPETITIONS = 24
SAMPLED = 3
#: Items of twice as many words are searched by pieces of at least so many.
PIECE = 10
#: Bytes of item texts sent to the tasks at once, about.
BLOCK_BYTES = 4 << 20
#: Words of documents looked at together.
TOGETHER = 400_000
SEED = 7


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def distance_within(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(smallest edit distance of the item to any stretch of the text, its end).

    Bit-parallel: one step per word of the text, all rows of a column at once.
    """
    size = len(item)
    places: dict[int, int] = {}
    for k, word in enumerate(item.tolist()):
        places[word] = places.get(word, 0) | 1 << k
    top, full = 1 << (size - 1), (1 << size) - 1
    up, down, score = full, 0, size
    best, end = size, 0
    for at, word in enumerate(text.tolist()):
        same = places.get(word, 0)
        across = (((same & up) + up) ^ up) | same | down
        rise, fall = down | (full & ~(across | up)), up & across
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up, down = fall | (full & ~((same | down) | rise)), rise & (same | down)
        if score < best:
            best, end = score, at + 1
    return best, end


def _spread(low: np.ndarray, high: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each low to below its high, and the label of each."""
    many = np.maximum(high - low, 0)
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(low, many) + offset, np.repeat(labels, many)


def cuts(size: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of an item."""
    count = max(1, size // PIECE)
    edges = [size * k // count for k in range(count + 1)]
    return list(zip(edges, edges[1:]))


@dataclass
class Items:
    """One block of the benchmark, ready for searching."""

    ids: list
    texts: list[str]
    repetitions: int = REPETITIONS
    sampled: int = SAMPLED

    def prepare(self) -> Items:
        self.vocabulary: dict[bytes, int] = {}
        self.words = []
        for text in self.texts:
            known = self.vocabulary
            self.words.append(np.array(
                [known.setdefault(w, len(known) + 1) for w in words_of(text)], dtype=np.int64))
        self.base = len(self.vocabulary) + 2
        placed = [(k, low, w[low:high]) for k, w in enumerate(self.words) if len(w)
                  for low, high in cuts(len(w))]
        #: The item of each piece and its place in it.
        self.owners = np.array([k for k, *_ in placed], dtype=np.int64)
        self.offsets = np.array([low for _, low, _ in placed], dtype=np.int64)
        pieces = [w for *_, w in placed]
        self.lengths = np.array(sorted({len(w) for w in pieces}), dtype=np.int64)
        self.edits = self.lengths // TOLERANCE
        if not len(self.lengths):
            return self
        # Word pairs and the lengths of the pieces they stand in.
        owned = np.unique(np.concatenate([np.stack(
            [w[:-1] * self.base + w[1:], np.full(len(w) - 1, np.searchsorted(self.lengths, len(w)))],
            axis=1) for w in pieces]), axis=0)
        self.pairs, at = np.unique(owned[:, 0], return_index=True)
        self.pair_classes, self.pair_starts = owned[:, 1], np.append(at, len(owned))
        rng = np.random.default_rng(SEED)
        steps = 2 * int(self.lengths.max())
        odd = rng.integers(0, 1 << 63, (self.repetitions, steps), dtype=np.uint64) * np.uint64(2)
        self.turns = odd + np.uint64(1)
        # What each sampled step adds to a key; 0 where a step is not sampled.
        self.adds = np.zeros((self.repetitions, len(self.lengths), steps), dtype=np.uint64)
        for r in range(self.repetitions):
            for c, length in enumerate(self.lengths.tolist()):
                chosen = rng.choice(2 * length, min(self.sampled, 2 * length), replace=False)
                self.adds[r, c, chosen] = rng.integers(
                    0, 1 << 63, len(chosen), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        classes = np.searchsorted(self.lengths, [len(w) for w in pieces])
        flat = np.concatenate(pieces)
        starts = np.cumsum([0, *(len(w) for w in pieces)])[:-1]
        self.tables = []
        for r in range(self.repetitions):
            keys = self.walk(r, flat, starts, classes)
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], order))
        return self

    def walk(self, r: int, text: np.ndarray, starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Keys of the windows at `starts`, as long as pieces of their class."""
        length = self.lengths[classes]
        last = np.minimum(starts + length, len(text))
        at, keys = starts.copy(), np.zeros(len(starts), dtype=np.uint64)
        # The class is part of the key: windows meet pieces of their own length.
        keys += classes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        outside = np.uint64(self.base - 1)
        for step in range(2 * int(length.max(initial=0))):
            inside = at < last
            read = np.where(inside, text[np.minimum(at, len(text) - 1)].astype(np.uint64), outside)
            keys += self.adds[r, classes, step] * read
            at += (((read + np.uint64(1)) * self.turns[r, step]) >> np.uint64(63)).astype(np.int64)
        return keys

    def encode(self, text: str | None) -> np.ndarray:
        """Word numbers of a text, 0 for a word of no item."""
        known = self.vocabulary.get
        parts = [np.fromiter(map(known, words, repeat(0)), np.int64, len(words))
                 for words in word_lists((text or "").encode("utf-8").lower())]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def windows(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, class) of the windows with enough word pairs of pieces of their length.

        `ends` gives for each word where its document ends.
        """
        here = np.flatnonzero((text[:-1] > 0) & (text[1:] > 0) & (ends[:-1] == ends[1:]))
        codes = text[here] * self.base + text[here + 1]
        at = np.minimum(np.searchsorted(self.pairs, codes), max(0, len(self.pairs) - 1))
        known = self.pairs[at] == codes if len(self.pairs) else np.zeros(len(here), dtype=bool)
        here, at = here[known], at[known]
        classes, places = _spread(self.pair_starts[at], self.pair_starts[at + 1], here)
        classes = self.pair_classes[classes]
        order = np.argsort(classes, kind="stable")
        classes, places = classes[order], places[order]
        length, edits = self.lengths[classes], self.edits[classes]
        # The pair that is the last needed one if this is the first in a window.
        final = np.arange(len(places)) + np.maximum(length - 1 - 3 * edits, 1) - 1
        inside = final < len(places)
        final = np.minimum(final, max(0, len(places) - 1))
        inside &= (classes[final] == classes) & (ends[places[final]] == ends[places])
        inside &= places[final] - places <= length - 2
        classes, places, final = classes[inside], places[inside], places[final[inside]]
        low = np.maximum(final - self.lengths[classes] + 2, 0)
        starts, classes = _spread(low, places + 1, classes)
        if self.lengths[0] == 1:
            single = np.unique(np.array([w[0] for w in self.words if len(w) == 1]))
            alone = np.flatnonzero(np.isin(text, single))
            starts, classes = np.append(starts, alone), np.append(classes, np.zeros(len(alone), np.int64))
        fits = starts + self.lengths[classes] - self.edits[classes] <= ends[starts]
        both = np.unique(classes[fits] * len(text) + starts[fits])
        return both % len(text), both // len(text)

    def candidates(self, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Distinct (piece, start) rows that share a key in some repetition."""
        starts, classes = self.windows(text, ends)
        found = [np.empty((0, 2), dtype=np.int64)]
        if len(starts):
            for r, (keys, pieces) in enumerate(self.tables):
                mine = self.walk(r, text, starts, classes)
                low, high = np.searchsorted(keys, mine), np.searchsorted(keys, mine, side="right")
                rows, at = _spread(low, high, starts)
                found.append(np.stack([pieces[rows], at], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text, item, distance, end) of every text and item near each other."""
        if not len(self.lengths):
            return []
        out: list[tuple[int, int, int, int]] = []
        group, total = [], 0
        for k, text in enumerate(texts):
            group.append((k, self.encode(text)))
            total += len(group[-1][1])
            if total > TOGETHER or k == len(texts) - 1:
                out += self._search(group)
                group, total = [], 0
        return out

    def _search(self, group: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int, int]]:
        sizes = np.array([len(e) for _, e in group])
        text = np.concatenate([e for _, e in group])
        if not len(text):
            return []
        limits = np.cumsum(sizes)
        ends = np.repeat(limits, sizes)
        found = self.candidates(text, ends)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        # Where the item of each piece would start, document by document.
        rows = np.unique(np.stack([
            self.owners[found[:, 0]], np.searchsorted(limits, found[:, 1], side="right"),
            found[:, 1] - self.offsets[found[:, 0]]], axis=1), axis=0)
        row = 0
        while row < len(rows):
            item, doc, start = rows[row].tolist()
            words = self.words[item]
            edits = len(words) // TOLERANCE
            reach = start
            # Starts of one item close together are verified as one stretch.
            while (row < len(rows) and rows[row, 0] == item and rows[row, 1] == doc
                   and rows[row, 2] <= reach + len(words)):
                reach = int(rows[row, 2])
                row += 1
            # Edits before a piece and in its window both move the start.
            origin = int(limits[doc] - sizes[doc])
            low = max(origin, start - 2 * edits)
            high = min(int(limits[doc]), reach + len(words) + 2 * edits)
            if low >= high:
                continue
            distance, end = distance_within(words, text[low:high])
            if distance <= edits:
                at = (distance, low + end - origin)
                best[(doc, item)] = min(best.get((doc, item), at), at)
        return [(group[d][0], i, *at) for (d, i), at in sorted(best.items())]


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The distinct texts of the benchmark in blocks of about `block_bytes`.

    A text is named by its hash, so copies of an item add nothing to a block.
    """
    rows = benchmark.where("text IS NOT NULL").select("text").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    rows = rows.withColumn("item", F.xxhash64("text"))
    for k in range(blocks):
        part = sorted(rows.where(F.pmod("item", F.lit(blocks)) == k).collect(), key=lambda r: r.text)
        yield Items([r.item for r in part], [r.text for r in part])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, item_words, end_word) for every near document and item.

    A task holds one block. Texts are searched once; items of equal text share what is found.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item bigint, distance int, item_words int, end_word int"
    found = docs.sparkSession.createDataFrame([], schema)
    for k, block in enumerate(item_blocks(benchmark)):
        shipped = docs.sparkSession.sparkContext.broadcast((block.ids, block.texts))

        def batches(source: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            items = Items(*shipped.value).prepare()
            for batch in slices(source):
                found = items.search(batch.column("text").to_pylist())
                picked = batch.select(["doc_id"]).take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    picked.column("doc_id"),
                    pa.array([items.ids[f[1]] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.int32()),
                    pa.array([len(items.words[f[1]]) for f in found], pa.int32()),
                    pa.array([f[3] for f in found], pa.int32()),
                ], names=["doc_id", "item", "distance", "item_words", "end_word"])

        part = small_batches(docs.select("doc_id", "text")).mapInArrow(batches, schema)
        found = found.unionByName(part) if k else part
    named = benchmark.where("text IS NOT NULL").select(F.xxhash64("text").alias("item"), "item_id")
    return found.join(named, "item").select("doc_id", "item_id", "distance", "item_words", "end_word")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are near no item, with all their columns.

    What one block leaves is written before the next, so a task holds one block.
    """
    for k, block in enumerate(item_blocks(benchmark)):
        shipped = docs.sparkSession.sparkContext.broadcast((block.ids, block.texts))
        docs = cut_lineage(docs, "clean") if k else docs

        def batches(source: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            items = Items(*shipped.value).prepare()
            for batch in slices(source):
                kept = np.ones(batch.num_rows, dtype=bool)
                kept[[f[0] for f in items.search(batch.column("text").to_pylist())]] = False
                yield batch.filter(pa.array(kept))

        docs = small_batches(docs).mapInArrow(batches, docs.schema)
    return docs


def op1_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(documents(spark, sf_dir), benchmark)
