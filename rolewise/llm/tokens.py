"""Token counts by a two-tier lookup inside the map.

A byte-level BPE tokenizer first cuts a text into pre-tokens, and the tokens of
each depend on it alone. Most of a corpus is a few pre-tokens, so the tasks get
one compact table of frequent ones with their number of tokens; any other is
encoded by the tokenizer itself and remembered in a bounded cache of the worker.
Pre-tokens never leave their task: no shuffle but that of the counts for the
frequent table, which come from a sample bounded by `sample_docs` and `sample_chars` and decide
only how fast the rest goes, never a result.

Cases: a null text counts like an empty one, 0 bytes and 0 tokens; special
strings standing in a text are one token each, as the library has it by default;
any id, also null or repeated, keeps its row; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolewise.llm.common import documents, slices, small_batches

LIMIT = 512
#: Rows of the frequent table and pre-tokens of a worker's cache, at most.
FREQUENT = 65_536
CACHED = 400_000
#: Pre-tokens longer than this many characters are encoded and not remembered.
LONG = 64
#: The sample for the frequent table: so many documents, of so many characters at most.
SAMPLE_DOCS = 8_192
SAMPLE_CHARS = 16_384
#: Texts whose misses are encoded together.
BATCH = 256

# The white space of the tokenizer's pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    """(tokenizer, special strings): only byte-level BPE with the usual pattern."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before = spec["pre_tokenizer"]
    plain = spec["normalizer"] is None and spec["model"]["type"] == "BPE"
    if not plain or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
        raise ValueError(f"{path}: not a byte-level BPE without normalizer")
    added = spec["added_tokens"]
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
        raise ValueError(f"{path}: added tokens with conditions on their surroundings")
    return Tokenizer.from_file(path), sorted((a["content"] for a in added), key=len, reverse=True)


@lru_cache(maxsize=1)
def _pattern():
    """The tokenizer's pattern, with the commonest alternatives tried first.

    They start with different characters, so their order does not matter.
    """
    return regex.compile(
        rf" ?\p{{L}}+| ?\p{{N}}+|'(?:s|t|re|ve|m|ll|d)| ?[^{SPACE}\p{{L}}\p{{N}}]+"
        rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class Counting:
    """Counts the tokens of texts with the frequent table and a cache of its own."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None) -> None:
        self.tokenizer, self.special = _tokenizer(path)
        self.frequent = frequent or {}
        self.cache: dict[str, int] = {}
        self.split = _pattern().findall
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def parts(self, text: str) -> tuple[int, list[str]]:
        """Number of special tokens in a text, and its stretches between them."""
        if self.specials is None:
            return 0, [text]
        found = self.specials.split(text)
        return len(found) - 1, found

    def texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Misses of a batch are encoded together."""
        totals, lookup, cache = [], self.frequent.get, self.cache
        missing: dict[str, int] = {}
        waiting: list[tuple[int, Counter]] = []
        for at, text in enumerate(texts):
            total, stretches = self.parts(text)
            for stretch in stretches:
                unknown = None
                for piece, n in Counter(self.split(stretch)).items():
                    known = lookup(piece)
                    if known is None:
                        known = cache.get(piece)
                    if known is not None:
                        total += n * known
                    else:
                        if unknown is None:
                            unknown = Counter()
                        unknown[piece] += n
                        missing[piece] = 0
                if unknown:
                    waiting.append((at, unknown))
            totals.append(total)
        if missing:
            names = list(missing)
            for k in range(0, len(names), 4096):
                block = names[k:k + 4096]
                encoded = self.tokenizer.encode_batch_fast(block, add_special_tokens=False)
                missing.update(zip(block, map(len, encoded)))
            for at, unknown in waiting:
                totals[at] += sum(n * missing[piece] for piece, n in unknown.items())
            if len(cache) + len(missing) > CACHED:
                cache.clear()
            cache.update((p, n) for p, n in missing.items() if len(p) <= LONG)
            while len(cache) > CACHED:
                cache.popitem()
        return totals


def frequent_pieces(docs: DataFrame, path: str, rows: int = FREQUENT,
                    sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, int]:
    """Number of tokens of the most frequent pre-tokens of a bounded sample.

    The sample is about `sample_docs` documents of at most `sample_chars`
    characters, picked by a hash of their text; it does not grow with the table.
    """
    whole = 1_000_003
    share = min(whole, sample_docs * whole // max(1, docs.count()) + 1)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in source:
            for text in batch.column("text").to_pylist():
                counts.update(p for p in _pattern().findall(text) if len(p) <= LONG)
        yield pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
            names=["piece", "n"])

    picked = docs.where(F.length("text") <= sample_chars).where(
        F.pmod(F.xxhash64("text"), F.lit(whole)) < share)
    counted = picked.select("text").mapInArrow(batches, "piece string, n bigint")
    best = counted.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(rows)
    pieces = [r.piece for r in best.collect()]
    tokenizer, _ = _tokenizer(path)
    encoded = tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
    return dict(zip(pieces, map(len, encoded)))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of whole texts."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_pieces(docs, path))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(path, frequent.value)
        for batch in slices(source, BATCH):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                pa.array(counting.texts(texts), pa.int64()),
            ], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs.select("doc_id", "text")).mapInArrow(
        batches, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
