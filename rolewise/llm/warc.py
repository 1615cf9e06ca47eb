"""Resolution of not-modified revisits in a web archive.

A revisit record says that a page was not modified; its content is that of the
latest earlier full response for the same canonical URL, if their validators
agree. The headers that a not-modified answer may change replace the stored ones.

The as-of join sorts captures by range of (URL, time, record), so a URL with a
third of all captures is spread over as many ranges as it fills. Within a range
the latest response is a running value; a URL that goes on into the next range
takes along the last response before it, of which there is one per range.

Records have record_id, url, at (seconds), kind (`response` or `revisit`), etag,
last_modified, digest, length and headers, a map with lower-case names.

Cases: a null URL resolves nothing (`no_url`); of captures at the same second the
smaller record_id is the earlier; a null time comes before all others; validators
that are absent on either side are passed over, and with none in common the
revisit stays open (`no_validator`); repeated revisits keep a row each; null
headers count as none; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolewise.session import cut_lineage

#: Headers of a not-modified answer that replace stored ones.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = "utm_[a-z_]*|ref|gclid|fbclid"
#: Visits of a page in the derived capture log.
VISITS = 4


def canonical(url: Column) -> Column:
    """URL without scheme, `www.`, default port, fragment, tracking fields and last slash."""
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.lower(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    rest = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    rest = F.regexp_replace(rest, rf"([?&])({TRACKING})=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, r"&&+", "&"), r"\?&+", "?")
    return F.concat(host, F.regexp_replace(F.regexp_replace(rest, r"[?&]+$", ""), r"/$", ""))


def latest_responses(records: DataFrame) -> DataFrame:
    """The records with a URL, their `key` and the response before them in `found`."""
    kept = F.struct("record_id", "etag", "last_modified", "digest", "length", "headers")
    response = F.when(F.col("kind") == "response", kept)
    rows = records.select("record_id", "url", "at", "kind", "etag", "last_modified", "digest", "length",
                          "headers").withColumn("key", canonical(F.col("url"))).where("key IS NOT NULL")
    ranged = cut_lineage(
        rows.repartitionByRange("key", "at", "record_id").withColumn("part", F.spark_partition_id()),
        "captures")
    earlier = W.partitionBy("part", "key").orderBy("at", "record_id").rowsBetween(W.unboundedPreceding, -1)
    local = ranged.withColumn("local", F.last(response, ignorenulls=True).over(earlier))
    # Only the first and last URL of a range can go on in another one.
    edges = ranged.groupBy("part").agg(F.array(F.min("key"), F.max("key")).alias("keys"))
    spanning = edges.select("part", F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(
        F.count("*").alias("n")).where("n > 1").select("key")
    ends = ranged.join(spanning, "key").groupBy("key", "part").agg(
        F.max_by(response, F.when(F.col("kind") == "response", F.struct("at", "record_id"))).alias("end"))
    before = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("key", "part", F.last("end", ignorenulls=True).over(before).alias("carried")).where(
        "carried IS NOT NULL")
    return local.join(carried, ["key", "part"], "left").withColumn(
        "found", F.coalesce("local", "carried")).drop("local", "carried", "part")


def agreement() -> Column:
    """Whether the first validator that both sides have agrees; null without one."""
    def strong(etag: Column) -> Column:
        return F.regexp_replace(etag, "^W/", "")

    pairs = [(strong(F.col("etag")), strong(F.col("found.etag"))),
             (F.col("last_modified"), F.col("found.last_modified")), (F.col("digest"), F.col("found.digest"))]
    return F.coalesce(*[a == b for a, b in pairs])


def merged_headers() -> Column:
    """Stored headers, with those that the revisit may replace."""
    permitted = [F.lit(p) for p in PERMITTED]
    new = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")),
                       lambda name, value: name.isin(*permitted) & value.isNotNull())
    old = F.map_filter(F.coalesce("found.headers", F.create_map().cast("map<string,string>")),
                       lambda name, value: ~F.array_contains(F.map_keys(new), name))
    return F.map_concat(old, new)


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, key, outcome, refers_to, digest, length, headers) of every revisit."""
    revisits = latest_responses(records).where("kind = 'revisit'")
    outcome = (F.when(F.col("found").isNull(), "no_earlier_response")
               .when(agreement().isNull(), "no_validator")
               .when(agreement(), "resolved").otherwise("validator_mismatch"))
    good = F.col("outcome") == "resolved"
    known = revisits.withColumn("outcome", outcome).select(
        "record_id", "key", "outcome", F.when(good, F.col("found.record_id")).alias("refers_to"),
        F.when(good, F.col("found.digest")).alias("digest"),
        F.when(good, F.col("found.length")).alias("length"),
        F.when(good, merged_headers()).alias("headers"))
    kinds = dict(known.dtypes)
    without = records.where((F.col("kind") == "revisit") & F.col("url").isNull())
    return known.unionByName(without.select(
        "record_id", F.lit(None).cast("string").alias("key"), F.lit("no_url").alias("outcome"),
        *[F.lit(None).cast(kinds[c]).alias(c) for c in ("refers_to", "digest", "length", "headers")]))


def captures(pages: DataFrame) -> DataFrame:
    """A capture log over the pages: each is visited several times.

    The first visit and about a third of the later ones bring a full response,
    a new version of the page; the others are revisits with the validators of
    the version before them, one in sixteen with a stale one.
    """
    visits = F.explode(F.array(*[F.lit(v) for v in range(VISITS)])).alias("v")
    rows = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("body"),
                        F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size"), visits)

    def draw(visit: Column) -> Column:
        mixed = F.md5(F.concat_ws("-", F.col("page_id").cast("string"), visit.cast("string")))
        return F.conv(F.substring(mixed, 1, 2), 16, 10).cast("int")

    def full(visit: Column) -> Column:
        return (visit == 0) | (draw(visit) >= 160)

    v = F.col("v")
    version = F.when(full(v), v)
    for back in range(1, VISITS):
        version = F.coalesce(version, F.when((v >= back) & full(v - back), v - back))
    at = F.col("page_id") * 60 + v * 604800
    rows = rows.withColumns({
        "kind": F.when(full(v), "response").otherwise("revisit"), "version": version, "at": at})
    digest = F.md5(F.concat_ws("-", F.col("body"), F.col("version").cast("string")))
    stale = (F.col("kind") == "revisit") & (draw(v) % 16 == 0)
    tag = F.concat(F.lit('"'), F.substring(F.when(stale, "stale").otherwise(digest), 1, 12), F.lit('"'))
    rows = rows.withColumns({
        "record_id": F.col("page_id") * VISITS + v,
        "url": F.concat(F.when(v == 1, F.regexp_replace("url", "^http:", "HTTPS:")).otherwise(F.col("url")),
                        F.when((v == 2) & ~F.col("url").contains("#"), "#again").otherwise("")),
        "etag": F.when(F.col("page_id") % 5 != 4, F.when(v == 3, F.concat(F.lit("W/"), tag)).otherwise(tag)),
        "last_modified": F.when(F.col("page_id") % 7 != 6, F.col("page_id") * 60 + F.col("version") * 604800),
        "digest": F.when((F.col("kind") == "response") | (F.col("page_id") % 3 == 0), digest),
        "length": F.when(F.col("kind") == "response", F.col("size"))})
    is_full = F.col("kind") == "response"
    text = F.col("at").cast("string")
    values = {
        "cache-control": F.when(v % 2 == 0, F.concat(F.lit("max-age="), v.cast("string"))),
        "content-length": F.coalesce(F.col("length"), F.lit(0)).cast("string"),
        "content-type": F.when(is_full, "text/html"), "date": text, "etag": F.col("etag"),
        "expires": F.when(~is_full, text), "server": F.when(is_full, "s1").otherwise("s2"),
    }
    every = F.create_map(*[c for name, value in values.items() for c in (F.lit(name), value)])
    headers = F.map_filter(every, lambda name, value: value.isNotNull())
    return rows.withColumn("headers", headers).select(
        "record_id", "url", "at", "kind", "etag", "last_modified", "digest", "length", "headers")


def op4_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the capture log; numbers are -1 where it is not resolved."""
    found = resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return found.withColumns({
        "headers": F.array_join(lines, "\n"), "refers_to": F.coalesce("refers_to", F.lit(-1)),
        "length": F.coalesce("length", F.lit(-1))})


def _draw(visit: str) -> str:
    return f"('0x' || substr(md5(concat_ws('-', page_id::VARCHAR, ({visit})::VARCHAR)), 1, 2))::INT"


_FULL = "(({0}) = 0 OR {1} >= 160)"


def _full(visit: str) -> str:
    return _FULL.format(visit, _draw(visit))


OP4_SQL = rf"""
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS body,
         strlen(coalesce(html, ''))::BIGINT AS size, v
  FROM pages, (VALUES (0), (1), (2), (3)) AS visits(v)
), a AS (
  SELECT *, CASE WHEN {_full("v")} THEN 'response' ELSE 'revisit' END AS kind,
         CASE WHEN {_full("v")} THEN v WHEN v >= 1 AND {_full("v - 1")} THEN v - 1
              WHEN v >= 2 AND {_full("v - 2")} THEN v - 2 ELSE v - 3 END AS version,
         page_id * 60 + v * 604800 AS moment
  FROM p
), b AS (
  SELECT *, md5(concat_ws('-', body, version::VARCHAR)) AS whole,
         '"' || substr(CASE WHEN kind = 'revisit' AND {_draw("v")} % 16 = 0 THEN 'stale'
           ELSE md5(concat_ws('-', body, version::VARCHAR)) END, 1, 12) || '"' AS tag
  FROM a
), c AS (
  SELECT page_id * 4 + v AS record_id, kind, moment, v,
         (CASE WHEN v = 1 THEN regexp_replace(url, '^http:', 'HTTPS:') ELSE url END)
           || CASE WHEN v = 2 AND NOT contains(url, '#') THEN '#again' ELSE '' END AS url,
         CASE WHEN page_id % 5 <> 4 THEN CASE WHEN v = 3 THEN 'W/' ELSE '' END || tag END AS etag,
         CASE WHEN page_id % 7 <> 6 THEN page_id * 60 + version * 604800 END AS modified,
         CASE WHEN kind = 'response' OR page_id % 3 = 0 THEN whole END AS digest,
         CASE WHEN kind = 'response' THEN size END AS length,
         CASE WHEN v % 2 = 0 THEN 'max-age=' || v::VARCHAR END AS cache
  FROM b
), d AS (
  SELECT *, regexp_replace(trim(url), '#.*$', '') AS plain FROM c
), e AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(
           plain, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '')
         || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
           plain, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', ''),
           '([?&])({TRACKING})=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '\?&+', '?', 'g'),
           '[?&]+$', ''), '/$', '') AS key
  FROM d
), f AS (
  SELECT *, last_value(CASE WHEN kind = 'response' THEN struct_pack(
           id := record_id, etag := etag, modified := modified, digest := digest, length := length,
           cache := cache) END IGNORE NULLS) OVER (
           PARTITION BY key ORDER BY moment, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS found
  FROM e
), g AS (
  SELECT *, coalesce(regexp_replace(etag, '^W/', '') = regexp_replace(found.etag, '^W/', ''),
                     modified = found.modified, digest = found.digest) AS agrees
  FROM f WHERE kind = 'revisit'
), h AS (
  SELECT *, CASE WHEN found IS NULL THEN 'no_earlier_response' WHEN agrees IS NULL THEN 'no_validator'
              WHEN agrees THEN 'resolved' ELSE 'validator_mismatch' END AS outcome FROM g
)
SELECT record_id, key, outcome, CASE WHEN outcome = 'resolved' THEN found.id ELSE -1 END AS refers_to,
       CASE WHEN outcome = 'resolved' THEN found.digest END AS digest,
       CASE WHEN outcome = 'resolved' THEN found.length ELSE -1 END AS length,
       CASE WHEN outcome = 'resolved' THEN concat_ws(chr(10),
         'cache-control: ' || coalesce(cache, found.cache), 'content-length: ' || found.length::VARCHAR,
         'content-type: text/html', 'date: ' || moment::VARCHAR, 'etag: ' || coalesce(etag, found.etag),
         'expires: ' || moment::VARCHAR, 'server: s1') END AS headers
FROM h
"""
