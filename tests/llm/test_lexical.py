"""Dual-tree search against scores of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from rolewise.llm import lexical
from tests.llm.helpers import SCHEMA, empty, odd, small

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(items, docs, k=20):
    """(item_id, rank, doc_id, score) by scoring every item with every document."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        asked, scored = Counter(terms(text)), []
        for doc_id, c in counts:
            m = 75 + (25 * c.total() * n_docs) // n_terms
            score = sum(
                r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in asked.items() if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def found(spark, items, docs, **options):
    frame = spark.createDataFrame([(*i, "x", 1) for i in items], ITEMS + ", term string, rank int")
    return sorted(map(tuple, lexical.ranked(frame, docs, **options).collect()), key=str)


def made(n, seed=3):
    pick = random.Random(seed)
    words = [[f"w{g}x{i}" for i in range(60)] for g in range(4)]
    text = lambda g, size: " ".join(pick.choices(words[g], k=size))
    docs = [(i, text(i % 4, pick.randint(1, 40))) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(40)]  # ties
    items = [(i, text(i % 4, pick.randint(1, 30))) for i in range(45)]
    return items + [(100, None), (101, ""), (102, "?!"), (103, items[0][1]), (103, items[1][1]), (None, items[2][1]), (104, "unknown")], docs


def rows(spark, docs):
    return spark.createDataFrame([(d, t, None, None, 0) for d, t in docs], SCHEMA)


@pytest.mark.parametrize("block", [lexical.BLOCK_BYTES, 2000])
def test_equals_all_pairs(spark, monkeypatch, block):
    items, docs = made(600)
    monkeypatch.setattr(lexical, "SEEDS", 50)
    assert found(spark, items, rows(spark, docs), block_bytes=block) == plain(items, docs)


def test_supplied_tables(spark):
    docs = small(spark)
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert found(spark, items, docs) == plain(items, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    docs = odd(spark)
    items = [(1, "Of the thand ÜBER naïve 　 line"), (2, "word one two x"), (3, "x" * 70000), (4, None)]
    assert found(spark, items, docs) == plain(items, [(r.doc_id, r.text) for r in docs.collect()])
    assert found(spark, items, empty(spark)) == [] and found(spark, [], docs) == []


def test_separators_and_case():
    text = "Ab1-c_d Éé x\u0085 中{}~z\x7fq\x00r" + "".join(map(chr, range(128)))
    assert lexical.term_counts(text.encode()) == Counter(t.encode() for t in terms(text))


def test_long_texts_are_counted_in_pieces(monkeypatch):
    from rolewise.llm import common
    text = ("ab Cd,ef " * 500).encode()
    whole = lexical.term_counts(text)
    monkeypatch.setattr(common.pieces, "__defaults__", (16,))
    assert lexical.term_counts(text) == whole


def chunk(seed, n, width, groups=8):
    """Documents of `groups` vocabularies and items of the same."""
    pick = np.random.default_rng(seed)
    span = width // groups
    docs = [np.unique(pick.integers(0, span, 12)) + span * (i % groups) for i in range(n)]
    items = np.zeros((48, width))
    for i in range(len(items)):
        items[i, np.unique(pick.integers(0, span, 9)) + span * (i % groups)] = pick.integers(1, 3000)
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    return items, starts, np.concatenate(docs), pick.integers(1, 900_000, starts[-1])


@pytest.mark.parametrize("kind", [np.float64, np.int64])
def test_trees_give_the_best_and_score_few(kind):
    items, starts, where, values = chunk(4, 2000, 400)
    search = lexical.Search(items.astype(kind), np.zeros(len(items), dtype=np.int64), 5)
    search.add(list(range(1000)), starts[:1001], where[:starts[1000]], values[:starts[1000]])
    search.add(list(range(1000, 2000)), starts[1000:] - starts[1000], where[starts[1000]:], values[starts[1000]:])
    dense = np.zeros((2000, 400), dtype=np.int64)
    dense[np.repeat(np.arange(2000), np.diff(starts)), where] = values
    scores = items.astype(np.int64) @ dense.T
    for i, best in enumerate(search.best):
        expected = sorted((-int(s), False, j) for j, s in enumerate(scores[i]) if s > 0)[:5]
        assert best == expected
    assert search.scored < scores.size / 3


def test_a_known_kth_score_prunes_more():
    items, starts, where, values = chunk(5, 1500, 400)
    first = lexical.Search(items, np.zeros(48, dtype=np.int64), 5)
    first.add(list(range(1500)), starts, where, values)
    again = lexical.Search(items, np.array([-b[-1][0] for b in first.best]), 5)
    again.add(list(range(1500)), starts, where, values)
    assert again.best == first.best and again.scored < first.scored
