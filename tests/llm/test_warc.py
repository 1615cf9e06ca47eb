"""Revisit resolution against a walk over the captures of each URL."""

import random

import pytest
from pyspark.sql import functions as F

from rolewise.llm import warc
from tests.llm.helpers import SMALL

SCHEMA = ("record_id bigint, url string, at bigint, kind string, etag string, last_modified bigint, "
          "digest string, length bigint, headers map<string,string>, part string, found int")


def plain(rows, key):
    out = {}
    for url in {key[r[0]] for r in rows}:
        last = None
        for r in sorted((r for r in rows if key[r[0]] == url), key=lambda r: (r[2], r[0])):
            if r[3] == "response":
                last = r
                continue
            if url is None:
                out[r[0]] = ("no_url", None, None)
            elif last is None:
                out[r[0]] = ("no_earlier_response", None, None)
            else:
                pairs = [(a, b) for a, b in ((r[4] and r[4].removeprefix("W/"), last[4] and last[4].removeprefix("W/")),
                                             (r[5], last[5]), (r[6], last[6])) if a is not None and b is not None]
                if not pairs or pairs[0][0] != pairs[0][1]:
                    out[r[0]] = ("validator_mismatch" if pairs else "no_validator", None, None)
                else:
                    new = {k: v for k, v in (r[8] or {}).items() if k in warc.PERMITTED and v is not None}
                    out[r[0]] = ("resolved", last[0], {**(last[8] or {}), **new})
    return out


def rows_of(rng, n):
    urls = ["http://a.org/x", "HTTPS://www.A.org:443/x#f", "http://a.org/x/?utm_source=q", "http://b.org/?q=1&ref=z",
            "http://b.org?q=1", "http://c.org/only", None, "no url"]
    weights = [30, 30, 30, 3, 3, 1, 1, 1]
    return [(k, rng.choices(urls, weights)[0], rng.randrange(40), rng.choice(["response", "revisit", "revisit"]),
             rng.choice([None, '"1"', 'W/"1"', '"2"']), rng.choice([None, 5]), rng.choice([None, "d"]), 7,
             rng.choice([None, {"date": str(k), "server": "s", "etag": "e"}, {"content-type": "t", "vary": None}]),
             "x", 1) for k in range(n)]


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_random_captures(spark, parts):
    rows = rows_of(random.Random(parts), 300)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, SCHEMA)
        key = {r.record_id: r.key for r in frame.select("record_id", warc.canonical(F.col("url")).alias("key")).collect()}
        got = {r.record_id: (r.outcome, r.refers_to, r.headers) for r in warc.resolve(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == plain(rows, key)


def test_canonical_urls(spark):
    pairs = {"http://a.org/x": "a.org/x", "HTTPS://WWW.A.org:443/X/#top": "a.org/X",
             " http://a.org:80/?utm_source=1&q=2&ref=3 ": "a.org/?q=2", "http://a.org/?ref=3": "a.org",
             "http://a.org:8080/a//": "a.org:8080/a/", "plain": "plain", "": ""}
    frame = spark.createDataFrame([(u,) for u in pairs], "url string")
    got = {r.url: r.key for r in frame.select("url", warc.canonical(F.col("url")).alias("key")).collect()}
    assert got == pairs


def test_repeated_and_empty(spark):
    rows = rows_of(random.Random(0), 40)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert warc.resolve(frame.limit(0)).collect() == []
    once = warc.resolve(frame).count()
    assert warc.resolve(frame.unionAll(frame.where("kind = 'revisit'"))).count() == 2 * once


def test_capture_log(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    log = warc.captures(pages)
    assert log.count() == 4 * pages.count()
    outcomes = {r.outcome for r in warc.resolve(log).collect()}
    assert {"resolved", "validator_mismatch"} <= outcomes
