"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash of its id. A source that is to give a
budget of words takes its documents in hash order until the budget is met. No
sort is needed for that: words are summed by source and leading hash digits,
the digit in which the running sum passes the budget is found, and only the
documents of that one bucket are looked at again with the next digits. The
result is one threshold per source, applied as a filter.

Columns, joins, groupings and bounded windows only; no Python touches a row.

Cases: a null text or one without words has size 0 and is taken 0 words; a null
source is a source of its own and comes last; a null id hashes like an empty
one; rows with the same id and source stand or fall together; an empty table
gives an empty result; further columns, whatever their names, are carried by
`take` and ignored by `mixture`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolewise.llm.common import WORD, documents, unused
from rolewise.session import cut_lineage

WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MOST = 3
DIGIT_BITS = 10
HASH_BITS = 60


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def hash_of(doc_id: Column) -> Column:
    """The first 60 bits of the MD5 of the id as text."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def ranked_sources(rows: DataFrame) -> DataFrame:
    """(source, source_size, rank): sources by code point from 0, null last.

    Sources are sorted in ranges; the number of rows before a range comes from
    the counts of the ranges, so no task sees all sources.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = cut_lineage(
        sums.orderBy(F.asc_nulls_last("source")).withColumn("at", F.monotonically_increasing_id()),
        "sources",
    ).withColumn("range", F.shiftright("at", 33))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("range").count().select(
        "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    index = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(offsets, "range").select(
        "source", "source_size", (index + F.col("offset")).alias("rank"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): weighted shares of all words, capped.

    A share above `most` times its source stops there and the excess is shared
    anew by weight. Each round of that is one aggregate over the sources; the
    level share / among only rises, so the set of capped sources only grows and
    the rounds end.
    """
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    weighed = cut_lineage(ranked_sources(rows).select(
        "source", "source_size",
        F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).alias("w"),
    ), "weights")
    total, among = weighed.agg(F.sum("source_size"), F.sum("w")).first()
    total, among = total or 0, among or 1
    share = total
    cap = F.col("source_size") * most
    while True:
        above = cap.cast("decimal(20,0)") * F.lit(among).cast("decimal(18,0)") < (
            F.col("w").cast("decimal(18,0)") * F.lit(share).cast("decimal(20,0)"))
        stopped, free = weighed.agg(
            F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("w"))),
        ).first()
        if not free or (total - stopped, free) == (share, among):
            break
        share, among = total - stopped, free
    level = (F.col("w") * F.lit(share)).cast("double") / F.lit(among)
    return weighed.select("source", "source_size",
                          F.when(above, cap.cast("double")).otherwise(level).alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source the hash threshold that takes its target.

    `copies` whole passes are taken; what is left of the target is `budget`,
    taken from documents with hash >> shift below `prefix`, and those equal to
    it if `edge`, which is decided by the nearer sum. After each level the
    boundary bucket of a source is 1,024 times smaller; levels end when every
    boundary holds one document, or when all bits are used and it holds equal
    hashes.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    fixed = ("source", "source_size", "target", "copies", "budget")
    state = cut_lineage(
        goals.withColumn("copies", F.coalesce(copies, F.lit(0)).cast("long")).select(
            "*", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"),
            F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base")),
        "budgets")
    counted = rows.where("size > 0").select(F.col("source").alias("of"), "size", "key")
    same = F.expr("of <=> source")
    for shift in range(HASH_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        histogram = (
            counted.join(state.select("source", "prefix"), same)
            .where(F.shiftright("key", shift + DIGIT_BITS) == F.col("prefix"))
            .groupBy("of", F.shiftright("key", shift).alias("digit"))
            .agg(F.sum("size").alias("here"), F.count("*").alias("n"))
            .withColumn("upto", F.sum("here").over(W.partitionBy("of").orderBy("digit")))
        )
        passed = histogram.join(state.select("source", "budget", "base"), same).where(
            F.col("base") + F.col("upto") > F.col("budget"))
        edge = passed.groupBy("of").agg(
            F.min_by(F.struct("digit", "here", "n", "upto"), "digit").alias("e"))
        # Without a bucket that passes the budget everything is taken.
        end = F.shiftleft(F.col("prefix") + 1, DIGIT_BITS)
        state = cut_lineage(state.join(edge, same, "left").select(
            *fixed,
            F.coalesce("e.digit", end).alias("prefix"),
            (F.col("base") + F.coalesce(F.expr("e.upto - e.here"), F.lit(0))).alias("base"),
            F.coalesce("e.here", F.lit(0)).alias("words"),
            F.coalesce("e.n", F.lit(0)).alias("n"),
            F.lit(shift).alias("shift"),
        ), "edges")
        if (state.agg(F.max("n")).first()[0] or 0) <= 1:
            break
    nearest = (F.col("words") > 0) & (F.col("budget") - F.col("base") >= F.col("words") / 2)
    return state.select("source", "source_size", "target", "copies", "prefix", "shift",
                        nearest.alias("edge"))


def copies_of(key: str, names: dict[str, str] | None = None) -> Column:
    """How often the document with the hash in `key` is taken under its source's plan."""
    name = (names or {}).get
    digit = F.expr(f"shiftright({key}, {name('shift', 'shift')})")
    prefix = F.col(name("prefix", "prefix"))
    more = (digit < prefix) | ((digit == prefix) & F.col(name("edge", "edge")))
    return F.col(name("copies", "copies")) + F.when(more, 1).otherwise(0)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key), written once: later passes read no text."""
    return cut_lineage(docs.select(
        "doc_id", "source", size_of(F.col("text")).alias("size"),
        hash_of(F.col("doc_id")).alias("key")), "sizes")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every document."""
    rows = measured(docs)
    plan = thresholds(rows, targets(rows, weights, most)).withColumnRenamed("source", "of")
    return rows.join(plan, F.expr("source <=> of")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies_of("key")).alias("taken"))


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
         column: str = "copies") -> DataFrame:
    """The documents that the mix takes, with the number of times in `column`.

    `column` gets underscores appended while the documents have one of its name.
    """
    rows = measured(docs)
    plan = thresholds(rows, targets(rows, weights, most))
    column = unused(column, docs)
    names = {c: unused(f"mix_{c}", docs) for c in ("source", "copies", "prefix", "shift", "edge", "key")}
    renamed = plan.select(*[F.col(c).alias(n) for c, n in names.items() if c != "key"])
    times = copies_of(names["key"], names)
    return (
        docs.withColumn(names["key"], hash_of(F.col("doc_id")))
        .join(renamed, docs["source"].eqNullSafe(F.col(names["source"])))
        .select(*[docs[c] for c in docs.columns], times.alias(column))
        .where(F.col(column) > 0)
    )


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
         sum(w) OVER (ORDER BY source_size / w, source NULLS LAST
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
         row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS r
  FROM s
), l AS (
  SELECT r, total - stopped AS share, free AS among FROM o
  WHERE 3 * source_size * free >= w * (total - stopped) ORDER BY r LIMIT 1
), g AS (
  SELECT o.source, source_size,
         CASE WHEN o.r < l.r THEN (3 * source_size)::DOUBLE
              ELSE (w * share)::DOUBLE / among::DOUBLE END AS target
  FROM o, l
), p AS (
  SELECT source, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies
  FROM g
), c AS (
  SELECT doc_id, size, source_size, target, copies, target - copies * source_size AS budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY key) AS upto,
         sum(size) OVER (PARTITION BY d.source, key) AS here
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN upto <= budget OR (upto - here <= budget
         AND budget - (upto - here) >= here / 2) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
