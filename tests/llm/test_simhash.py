"""SimHash blocks against all pairs."""

import random

import pytest
import xxhash

from rolewise.llm import simhash
from tests.llm.helpers import ODD, empty, odd, small


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """{doc_id: smallest reachable doc_id} by comparing all pairs."""
    lowest = {}
    for d, f in prints:
        lowest[f] = min(d, lowest.get(f, d))
    parent = {f: f for f in lowest}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    values = list(lowest)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for f, d in lowest.items():
        least[root(f)] = min(d, least.get(root(f), d))
    return {(d, f): least[root(f)] for d, f in prints}


def test_fingerprint():
    for text in [None, "", "one", "One two", "a b c", "A b c d a b c d", *(r[1] for r in ODD[:6])]:
        assert simhash.fingerprint(text) == plain(text)


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(str(i % 977) for i in range(5000))
    whole = simhash.fingerprint(text)
    from rolewise.llm import common
    monkeypatch.setattr(common.word_lists, "__defaults__", (64,))
    assert simhash.fingerprint(text) == whole == plain(text)


def test_spark_hash_is_the_same(spark):
    row = spark.sql("SELECT xxhash64('a b c') AS h").first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest("a b c", 42)


@pytest.mark.parametrize("make", [small, odd])
def test_components_equal_all_pairs(spark, make):
    docs = make(spark)
    rows = simhash.near_duplicates(docs).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    wanted = components([(d, plain(t)) for d, t in texts])
    assert sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in rows) == sorted(
        (d, f, wanted[(d, f)]) for d, f in ((d, plain(t)) for d, t in texts))


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == []


@pytest.mark.parametrize("paired", [1, 4, 10**6])
def test_crowded_groups_lose_no_link(spark, paired):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20))
              for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)}
    values |= {v ^ (1 << 63) ^ 1 for v in list(values)[:20]}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp bigint"), paired=paired).collect()
    assert all(((e.u ^ e.v) % (1 << 64)).bit_count() <= 2 for e in edges)
    parent = {v: v for (v,) in signed}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for e in edges:
        parent[root(e.u)] = root(e.v)
    for (a,) in signed:
        for (b,) in signed:
            if ((a ^ b) % (1 << 64)).bit_count() <= 2:
                assert root(a) == root(b)
