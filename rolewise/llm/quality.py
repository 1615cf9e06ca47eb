"""Quality rules kept in a ledger of bits.

Every document is measured once. Each rule is evaluated once on the measures and
leaves a bit where the document fails it. The ledger keeps bits and measures;
a policy is a version with a mask of rules, so applying another version, or
asking what single rules cost, is arithmetic on bits without a text.

Cases: a null text has no words and fails `few_words`; any id, also null or
repeated, keeps its row; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolewise.llm.common import documents, slices, small_batches, word_lists

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaimed")

#: Rule: the condition under which a document fails it. The order gives the bits.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "exclaimed": "10 * n_exclaimed > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 15 * n_words",
    "short_words": "word_chars < 2 * n_words",
}
BASE = ("few_words", "repeats")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


POLICIES = {p.version: p for p in (Policy("base", BASE), Policy("full", tuple(RULES)))}


def repeated_words(numbers: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in a window of `width` words found twice or more."""
    n = len(numbers) - width + 1
    if n < 2:
        return 0
    # Windows get numbers word by word, so that codes stay small.
    code, size = numbers[:n], int(numbers.max()) + 1
    for k in range(1, width):
        code = np.unique(code * size + numbers[k:k + n], return_inverse=True)[1]
    twice = np.bincount(code)[code] > 1
    marks = np.zeros(len(numbers) + 1, dtype=np.int64)
    np.add.at(marks, np.flatnonzero(twice), 1)
    np.subtract.at(marks, np.flatnonzero(twice) + width, 1)
    return int((np.cumsum(marks) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of a whole text."""
    text = text or ""
    known: dict[bytes, int] = {}
    parts, exclaimed = [], 0
    for words in word_lists(text.encode("utf-8")):
        parts.append(np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64))
        exclaimed += sum(b"!!" in w for w in words) if "!!" in text else 0
    numbers = np.concatenate(parts)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(numbers), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(numbers), len(lines), exclaimed)


def failures() -> Column:
    """The bits of the rules that a measured document fails."""
    bits = F.lit(0).cast("long")
    for k, condition in enumerate(RULES.values()):
        bits = bits + F.when(F.expr(condition), 1 << k).otherwise(0)
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measures..., failures): one row per document, every rule evaluated."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source):
            rows = [measure(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*rows))],
                names=["doc_id", *MEASURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{m} bigint" for m in MEASURES)])
    return small_batches(docs.select("doc_id", "text")).mapInArrow(batches, schema).withColumn("failures", failures())


def passes(policy: Policy) -> Column:
    return F.col("failures").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(rows: DataFrame, policies: dict[str, Policy] = POLICIES) -> DataFrame:
    """(version, rule, failed, failed_alone, kept, kept_without): what each rule costs.

    One pass over the ledger; its size is that of the rules.
    """
    entries = []
    for policy in policies.values():
        under = F.col("failures").bitwiseAND(F.lit(policy.mask))
        for rule in policy.rules:
            bit = Policy("", (rule,)).mask
            entries.append(F.struct(
                F.lit(policy.version).alias("version"), F.lit(rule).alias("rule"),
                F.count_if(under.bitwiseAND(F.lit(bit)) != 0).alias("failed"),
                F.count_if(under == bit).alias("failed_alone"),
                F.count_if(under == 0).alias("kept"),
                F.count_if(under.bitwiseAND(F.lit(~bit)) == 0).alias("kept_without")))
    return rows.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def op7_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(documents(spark, sf_dir)).select(
        "doc_id", *MEASURES, "failures",
        (~passes(POLICIES["base"])).alias("base_failed"), passes(POLICIES["full"]).alias("kept"))


_BITS = " + ".join(f"CASE WHEN {c} THEN {1 << k} ELSE 0 END" for k, c in enumerate(RULES.values()))

OP7_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), w AS (
  SELECT rid, unnest(generate_series(1, len(words) - 2)) AS pos, words FROM d
), t AS (
  SELECT rid, pos, count(*) OVER (PARTITION BY rid, words[pos], words[pos + 1], words[pos + 2]) AS n FROM w
), r AS (
  SELECT rid, count(DISTINCT pos + k) AS n_repeat_words
  FROM t, (VALUES (0), (1), (2)) AS s(k) WHERE n > 1 GROUP BY rid
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
         len(list_filter(words, lambda x: contains(x, '!!')))::BIGINT AS n_exclaimed
  FROM d LEFT JOIN r USING (rid)
), b AS (SELECT *, ({_BITS})::BIGINT AS failures FROM m)
SELECT *, failures & {POLICIES["base"].mask} <> 0 AS base_failed,
       failures & {POLICIES["full"].mask} = 0 AS kept FROM b
"""
