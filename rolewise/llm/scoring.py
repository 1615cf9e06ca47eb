"""Language-model scoring by a hashed maximum-entropy model.

Outcome of a token: its class, then its word. The most frequent training words
share `HEAD_CLASSES` classes of `HEAD_WORDS` words by frequency; any other word,
known or not, is in one of `TAIL_CLASSES` classes by its last bytes. Class and
head word are softmaxes over hashed context features, a bigram (the word before)
and a skip feature (the one before that); a tail word has its smoothed share of its class, with one
share left for all unknown words. So the probabilities of all outcomes add up
to one.

Training starts at the unigram model and goes in rounds. In a round every task
takes gradient steps over its documents of the round from the same weights; the
changes of each weight row are averaged by how often a task met it, summed as a
tree so that no group holds more than `FAN_IN` parts. All training documents
take part, each in one round. Weights have a fixed size and are the only thing
sent to all tasks, with the table of at most `FREQUENT` words. Counts of other
words are joined by word.

Cases: a null text is empty and has one token, the end; a null id is neither
held out nor trained on; repeated rows keep a row each; with no training document
every token scores log10(1) under the base; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolewise.llm.common import bucket, documents, slices, small_batches, word_lists
from rolewise.session import cut_lineage

END = b"\n"
SMOOTH = 0.1
#: Words of the table sent to all tasks, at most, and their bytes.
FREQUENT = 200_000
WORD_BYTES = 64
HEAD_CLASSES, HEAD_WORDS, TAIL_CLASSES = 16, 32, 16
CLASSES = HEAD_CLASSES + TAIL_CLASSES
#: Rows of the weights of classes and of words within a class.
CLASS_ROWS, WORD_ROWS = 1 << 14, 1 << 15
BATCH = 8192
RATE = 0.4
LARGEST = 10.0
ROUNDS = 3
#: Training tokens per task, unless there are cores for more tasks.
TASK_TOKENS = 10_000_000
#: Parts that are summed together.
FAN_IN = 64
BLOCK_ROWS = 1024
#: Distinct words that a counting task holds before it passes them on.
HELD = 200_000


def tail_class(word: bytes) -> int:
    return HEAD_CLASSES + zlib.crc32(word[-3:]) % TAIL_CLASSES


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over whole texts, each with its end."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())],
                names=["word", "n"])
            counts.clear()
            return batch

        for batch in source:
            for text in batch.column("text"):
                for words in word_lists((text.as_py() or "").encode("utf-8").lower()):
                    counts.update(words)
                counts[END] += 1
                if len(counts) > HELD:
                    yield out()
        yield out()

    return small_batches(docs.select("text")).mapInArrow(batches, "word binary, n bigint").groupBy("word").agg(
        F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What every task knows of the training tokens; bounded by FREQUENT words."""

    tokens: int
    types: int
    words: list[bytes]
    counts: np.ndarray
    tail_tokens: np.ndarray
    tail_types: np.ndarray
    numbers: dict[bytes, int] = field(default_factory=dict, repr=False)

    def prepare(self) -> Vocabulary:
        self.numbers = {w: k for k, w in enumerate(self.words)}
        size, head = len(self.words), HEAD_CLASSES * HEAD_WORDS
        self.classes = np.array([tail_class(w) for w in self.words], dtype=np.int64)
        self.places = np.full(size, -1, dtype=np.int64)
        order = np.arange(min(head, size))
        self.classes[:head], self.places[:head] = order // HEAD_WORDS, order % HEAD_WORDS
        self.hashes = np.array([zlib.crc32(w) for w in self.words], dtype=np.int64)
        self.logs = np.log10(self.counts + SMOOTH)
        self.total = math.log10(self.tokens + SMOOTH * (self.types + 1))
        self.tail_total = np.log10(self.tail_tokens + SMOOTH * (self.tail_types + 1))
        # The model before any training: shares of the classes and of words in them.
        first = np.zeros(head)
        first[:min(head, size)] = self.counts[:head]
        words = first.reshape(HEAD_CLASSES, HEAD_WORDS)
        shares = np.concatenate([words.sum(axis=1), self.tail_tokens]) + SMOOTH
        self.class_bias = np.log(shares / shares.sum()).astype(np.float32)
        # A class that is not full gives its empty places no share.
        filled = np.arange(head).reshape(words.shape) < size
        self.word_bias = np.where(filled, np.log(np.where(filled, words, 1) + SMOOTH), -1e9).astype(np.float32)
        return self

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """(classes, places, hashes, words outside the table, their positions)."""
        numbers = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        outside = np.flatnonzero(numbers < 0)
        if len(self.words):
            classes, places, hashes = self.classes[numbers], self.places[numbers], self.hashes[numbers]
        else:
            classes = places = hashes = np.full(len(words), -1)
            classes, places, hashes = classes.copy(), places.copy(), hashes.copy()
        missing = [words[k] for k in outside.tolist()]
        classes[outside] = [tail_class(w) for w in missing]
        places[outside] = -1
        hashes[outside] = [zlib.crc32(w) for w in missing]
        return classes, places, hashes, missing, numbers


def _level() -> Column:
    return F.floor(F.log2("n") * 16).cast("int")


def _in_table(least: int | None) -> Column:
    """Whether a counted word is in the table of frequent words."""
    if least is None:
        return F.lit(False)
    return (_level() >= least) & (F.octet_length("word") <= WORD_BYTES)


def vocabulary(counts: DataFrame, limit: int = FREQUENT) -> tuple[Vocabulary, int | None]:
    """(vocabulary, lowest level of counts in its table).

    The table takes words by a lower bound of their count, found from a
    histogram of fixed size, so it is never larger than `limit`; long words are
    left out of it.
    """
    level = _level()
    rows = counts.groupBy(level.alias("level"), (
        HEAD_CLASSES + F.crc32(F.substring("word", -3, 3)) % TAIL_CLASSES).alias("tail")).agg(
        F.count("*").alias("types"), F.sum("n").alias("tokens")).collect()
    sizes: Counter[int] = Counter()
    for r in rows:
        sizes[r.level] += r.types
    least, total = None, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > limit:
            break
        least = k
    frequent = [] if least is None else counts.where(_in_table(least)).collect()
    frequent.sort(key=lambda r: (-r.n, bytes(r.word)))
    tail_tokens, tail_types = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for r in rows:
        tail_tokens[r.tail - HEAD_CLASSES] += r.tokens
        tail_types[r.tail - HEAD_CLASSES] += r.types
    for r in frequent[:HEAD_CLASSES * HEAD_WORDS]:
        tail_tokens[tail_class(bytes(r.word)) - HEAD_CLASSES] -= r.n
        tail_types[tail_class(bytes(r.word)) - HEAD_CLASSES] -= 1
    found = Vocabulary(
        sum(r.tokens for r in rows), sum(r.types for r in rows), [bytes(r.word) for r in frequent],
        np.array([r.n for r in frequent], dtype=np.float64), tail_tokens, tail_types)
    return found, least


class Model:
    """Weights of the two softmaxes."""

    def __init__(self, vocabulary: Vocabulary, class_rows: np.ndarray | None = None,
                 word_rows: np.ndarray | None = None) -> None:
        self.vocabulary = vocabulary
        self.tables = [
            np.zeros((CLASS_ROWS, CLASSES), np.float32) if class_rows is None else class_rows.copy(),
            np.zeros((WORD_ROWS, HEAD_WORDS), np.float32) if word_rows is None else word_rows.copy()]
        self.met = [np.zeros(len(t), np.float32) for t in self.tables]

    @staticmethod
    def rows(before: np.ndarray, skipped: np.ndarray,
             classes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Weight rows of the bigram and the skip feature, alone and within a class."""
        mixed = [((f * 0x9E3779B1) & 0xFFFFFFFF) >> 7 for f in (before * 3 + 1, skipped * 5 + 2)]
        words = [(((m + (classes + 1) * 0xC2B2AE35) * 0x85EBCA77) & 0xFFFFFFFF) >> 9 for m in mixed]
        return [m % CLASS_ROWS for m in mixed], [w % WORD_ROWS for w in words]

    def _softmax(self, table: int, bias: np.ndarray, rows: list[np.ndarray],
                 outcome: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(natural log of the outcomes, probabilities of all)."""
        weights = self.tables[table]
        logits = weights.take(rows[0], axis=0)
        for r in rows[1:]:
            logits += weights.take(r, axis=0)
        logits += bias
        own = logits[np.arange(len(outcome)), outcome]
        # Logits are sums of few bounded weights: no shift is needed before exp.
        np.exp(logits, out=logits)
        total = logits @ np.ones(logits.shape[1], np.float32)
        logits /= total[:, None]
        return own - np.log(total), logits

    def _step(self, table: int, rows: list[np.ndarray], outcome: np.ndarray, probable: np.ndarray) -> None:
        """One gradient step; the rate of a row falls with the root of how often it was met."""
        probable[np.arange(len(outcome)), outcome] -= 1
        weights, met = self.tables[table], self.met[table]
        for r in rows:
            order = np.argsort(r.astype(np.uint16), kind="stable")
            ordered = r[order]
            first = np.flatnonzero(np.diff(ordered, prepend=-1))
            touched = ordered[first]
            met[touched] += np.diff(first, append=len(r))
            change = np.add.reduceat(probable.take(order, axis=0), first, axis=0)
            change *= (RATE / np.sqrt(met[touched]))[:, None]
            # Bounded weights keep every logit within what exp can take.
            weights[touched] = np.clip(weights.take(touched, axis=0) - change, -LARGEST, LARGEST)

    def run(self, classes: np.ndarray, places: np.ndarray, before: np.ndarray, skipped: np.ndarray,
            train: bool) -> np.ndarray:
        """log10 of class and head word of every token; tail words are left to their counts."""
        out = np.empty(len(classes))
        for start in range(0, len(classes), BATCH):
            part = slice(start, start + BATCH)
            c, p = classes[part], places[part]
            for_class, for_word = self.rows(before[part], skipped[part], c)
            own, probable = self._softmax(0, self.vocabulary.class_bias, for_class, c)
            if train:
                self._step(0, for_class, c, probable)
            head = np.flatnonzero(p >= 0)
            if len(head):
                for_word = [w[head] for w in for_word]
                word, probable = self._softmax(1, self.vocabulary.word_bias[c[head]], for_word, p[head])
                own[head] += word
                if train:
                    self._step(1, for_word, p[head], probable)
            out[part] = own
        return out / math.log(10)


def _contexts(hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes one and two tokens before, 0 before a text begins."""
    before = np.concatenate([[0], hashes[:-1]]) if len(hashes) else hashes
    before[firsts] = 0
    skipped = np.concatenate([[0], before[:-1]]) if len(hashes) else hashes
    skipped[firsts] = 0
    return before, skipped


def _encoded(vocabulary: Vocabulary, texts: list[str | None]):
    """Token arrays of some texts, one after the other, and where each text begins."""
    words, firsts = [], []
    for text in texts:
        firsts.append(len(words))
        for part in word_lists((text or "").encode("utf-8").lower()):
            words += part
        words.append(END)
    return vocabulary.encode(words), np.array(firsts, dtype=np.int64), len(words)


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Weights after all rounds; `docs` are the training documents."""
    context = docs.sparkSession.sparkContext
    shipped = context.broadcast(vocabulary)
    weights = Model(vocabulary).tables
    # Each task passes on its own changes, so there are no more tasks than work for them.
    tasks = max(context.defaultParallelism, vocabulary.tokens // TASK_TOKENS)
    turn = F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds))
    for k in range(rounds):
        current = context.broadcast(weights)

        def steps(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shipped.value.prepare()
            model = Model(known, *current.value)
            for batch in slices(source):
                (classes, places, hashes, _, _), firsts, _ = _encoded(known, batch.column("text").to_pylist())
                model.run(classes, places, *_contexts(hashes, firsts), train=True)
            part = TaskContext.get().partitionId()
            for table, (old, new, met) in enumerate(zip(current.value, model.tables, model.met)):
                for start in range(0, len(new), BLOCK_ROWS):
                    rows = slice(start, start + BLOCK_ROWS)
                    if met[rows].any():
                        weighed = (new[rows] - old[rows]) * met[rows][:, None]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([table], pa.int32()), pa.array([start], pa.int32()),
                            pa.array([part], pa.int64()), pa.array([weighed.tobytes()], pa.binary()),
                            pa.array([met[rows].tobytes()], pa.binary()),
                        ], names=["table", "start", "part", "change", "met"])

        schema = "table int, start int, part bigint, change binary, met binary"
        parts = cut_lineage(docs.where(turn == k).select("text").coalesce(tasks).mapInArrow(
            steps, schema), "changes")
        weights = [w.copy() for w in weights]
        for row in _summed(parts).collect():
            width = weights[row.table].shape[1]
            met = np.frombuffer(row.met, np.float32)
            change = np.frombuffer(row.change, np.float32).reshape(len(met), width)
            weights[row.table][row.start:row.start + len(met)] += change / np.maximum(met, 1)[:, None]
    return weights


def _summed(parts: DataFrame) -> DataFrame:
    """One row per block of weights, summed as a tree with bounded groups."""
    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        change = sum(np.frombuffer(c, np.float32) for c in group["change"])
        met = sum(np.frombuffer(m, np.float32) for m in group["met"])
        return pd.DataFrame({"table": [key[0]], "start": [key[1]], "part": [key[2]],
                             "change": [change.tobytes()], "met": [met.tobytes()]})

    last = parts.agg(F.max("part")).first()[0] or 0
    while last > 0:
        parts = parts.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy(
            "table", "start", "part").applyInPandas(add, parts.schema)
        last //= FAN_IN
    return parts


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    training = docs.where(bucket("doc_id", 10) != 0).select("doc_id", "text")
    counts = cut_lineage(word_counts(training), "counts")
    vocab, least = vocabulary(counts)
    weights = train(training, vocab) if vocab.tokens else Model(vocab.prepare()).tables
    vocab.numbers = {}
    context = docs.sparkSession.sparkContext
    shipped = context.broadcast((vocab, weights))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tables = shipped.value
        known = known.prepare()
        model, part, at = Model(known, *tables), TaskContext.get().partitionId() << 33, 0
        rare = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
        for batch in slices(source):
            (classes, places, hashes, missing, numbers), firsts, total = _encoded(
                known, batch.column("text").to_pylist())
            own = model.run(classes, places, *_contexts(hashes, firsts), train=False)
            tail = places < 0
            own[tail] -= known.tail_total[classes[tail] - HEAD_CLASSES]
            inside = numbers >= 0
            logs = np.zeros(total)
            logs[inside] = known.logs[numbers[inside]] if len(known.words) else 0
            own[tail] += logs[tail]
            sizes = np.diff(firsts, append=total)
            outside = np.add.reduceat((~inside).astype(np.int64), firsts)
            words, k = [], 0
            for n in outside.tolist():
                words.append([{"word": w, "n": c} for w, c in Counter(missing[k:k + n]).items()])
                k += n
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(part + at + np.arange(batch.num_rows)),
                pa.array(sizes, pa.int64()), pa.array(sizes - outside, pa.int64()),
                pa.array(np.add.reduceat(logs, firsts)), pa.array(np.add.reduceat(own, firsts)),
                pa.array(words, rare),
            ], names=["doc_id", "row", "n_tokens", "n_frequent", "logs", "own", "rare"])
            at += batch.num_rows

    rows = cut_lineage(small_batches(docs.select("doc_id", "text")).mapInArrow(
        batches, f"doc_id {kind}, row bigint, n_tokens bigint, n_frequent bigint, logs double, "
                 "own double, rare array<struct<word: binary, n: int>>"), "scores")
    log = F.log10(F.coalesce(F.col("c"), F.lit(0)) + SMOOTH)
    others = counts.where(~_in_table(least)).select("word", F.col("n").alias("c"))
    rest = rows.select("row", F.inline("rare")).join(others, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * log).alias("rest"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("known"))
    rest_log = F.coalesce("rest", F.lit(0.0))
    return rows.drop("rare").join(rest, "row", "left").select(
        "doc_id", "n_tokens",
        (F.col("n_frequent") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + rest_log - F.col("n_tokens") * F.lit(_total(vocab))).alias("base_score"),
        (F.col("own") + rest_log).alias("score"))


def _total(vocabulary: Vocabulary) -> float:
    return math.log10(vocabulary.tokens + SMOOTH * (vocabulary.types + 1))


def op3_maxent_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(bucket("doc_id", 10) == 0, F.lit(False)).alias("held_out")
    return scored(documents(spark, sf_dir)).select("doc_id", held, "n_tokens", "n_known", "train_tokens",
                                                   "base_score", "score")
