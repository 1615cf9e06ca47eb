"""A corpus from raw documents: told languages, no repeats, no benchmark, a set mix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rolewise.llm import decontamination, language, lines, mixing, near, simhash
from rolewise.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go."""
    return language.identified(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines are cut out; documents emptied by that go."""
    return lines.deduplicated(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that SimHash (op10) and Jaccard links together make.

    Fingerprints within two bits link, as in op10; five-word shingles of a Jaccard
    similarity of 0.8 link too, most of which lie further apart than that.
    """
    return simhash.representatives(docs, near.joined(simhash.near_duplicates(docs), near.near_duplicates(docs)))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often it takes each."""
    return mixing.take(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", tell_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: Compression, edit distances and these fingerprints cannot be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
