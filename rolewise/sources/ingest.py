"""Ingest: upload checks, content-hash identity, upserts by natural key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolewise import fixed_values as V


def validate_uploads(files: DataFrame, suffixes: tuple[str, ...] = V.UPLOAD_SUFFIXES,
                     max_bytes: int = V.UPLOAD_MAX_BYTES) -> DataFrame:
    """(path, length, ...) rows with a reason when they must be refused."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    reason = F.when(~suffix.isin(*suffixes), F.lit("unsupported format")).when(
        F.col("length") > max_bytes, F.lit("too large"))
    return files.withColumns({"suffix": suffix, "refusal": reason})


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def new_documents(incoming: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """First arrival of every content not stored yet.

    `incoming` has (content_hash, ...), `existing` (content_hash). The first
    copy is an aggregate per hash, so a content repeated any number of times
    is reduced before the shuffle.
    """
    rest = [c for c in incoming.columns if c != "content_hash"]
    first = incoming.groupBy("content_hash").agg(
        F.min_by(F.struct(*rest), F.col(order)).alias("row"), F.count("*").alias("copies"))
    fresh = first.join(existing.select("content_hash"), "content_hash", "left_anti")
    return fresh.select("content_hash", "row.*", "copies")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], largest: tuple[str, ...],
           last: tuple[str, ...], seq: str = "load_seq") -> DataFrame:
    """Merge by natural key: largest value of some fields, last write of the others."""
    columns = [*keys, *largest, *last, seq]
    both = old.select(*columns).unionByName(new.select(*columns))
    return both.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in largest],
        *[F.max_by(c, seq).alias(c) for c in last],
        F.max(seq).alias(seq),
    )


def upsert_identity(old: DataFrame, new: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Merge by lower-case e-mail: a new non-empty value replaces the old one.

    New records without an e-mail cannot be recognised and are all kept.
    """
    address = F.lower(F.trim(F.coalesce("email", F.lit(""))))
    keyed = new.withColumn("email", address)
    known = keyed.where("email <> ''")
    latest = known.groupBy("email").agg(*[
        F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("load_seq"))).alias(f"new_{c}")
        for c in fields
    ])
    base = old.withColumn("email", address)
    named = base.where("email <> ''").select("email", *fields)
    merged = named.join(latest, "email", "full_outer").select("email", *[
        F.coalesce(F.nullif(F.col(f"new_{c}"), F.lit("")), F.col(c)).alias(c) for c in fields])
    nameless = base.where("email = ''").select("email", *fields).unionByName(
        keyed.where("email = ''").select("email", *fields))
    return merged.unionByName(nameless)
