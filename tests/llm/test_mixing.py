"""Source mixing against its definition on small rows (and its SQL twin in test_queries)."""

import pytest

from rolewise.llm import mixing
from tests.llm.helpers import empty, odd


def plain(rows, weights=(5, 2, 1), most=3):
    """{source: target} by capping and sharing the excess again."""
    sizes = {}
    for source, size in rows:
        sizes[source] = sizes.get(source, 0) + size
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed = {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (sum(sizes.values()) - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        above = [s for s in free if weight[s] * level > most * sizes[s]]
        if not above:
            return fixed | {s: weight[s] * level for s in free}
        fixed |= {s: most * sizes[s] for s in above}


def words(n):
    return " ".join(["w"] * n)


@pytest.mark.parametrize("shape", [
    {"a": [5] * 40, "b": [700] + [3] * 60, None: [2] * 10, "c": [0, 0]},
    {"x": [10]},
    {"big": [1] * 500, "s1": [4], "s2": [4], "s3": [4], "s4": [1] * 20},
])
def test_targets_and_takings(spark, shape):
    rows = [(i, words(n), s) for i, (s, n) in enumerate((s, n) for s, ns in shape.items() for n in ns)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mixture(docs).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    wanted = plain([(s, n) for s, ns in shape.items() for n in ns])
    taken, largest = {}, {}
    for r in got:
        s = source[r.doc_id]
        assert r.target == pytest.approx(wanted[s])
        assert r.source_size == sum(shape[s]) and r.taken <= 3 * r.size
        assert r.size == 0 or r.taken % r.size == 0
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), r.size)
    for s, t in taken.items():
        assert abs(t - wanted[s]) <= largest[s] / 2 + 1e-6
    again = mixing.mixture(docs.repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_take_agrees_with_mixture(spark):
    docs = odd(spark).withColumnRenamed("score", "copies")
    kept = mixing.take(docs)
    assert kept.columns == [*docs.columns, "copies_"]
    copies = sorted((r.doc_id, r.copies_) for r in kept.collect())
    rows = mixing.mixture(docs).collect()
    assert len(rows) == docs.count()
    wanted = sorted((r.doc_id, r.taken // r.size) for r in rows if r.taken)
    assert [c for c in copies if c[0] not in (2, 3, 4)] == wanted


def test_equal_hashes_are_taken_by_the_nearer_sum(spark):
    docs = spark.createDataFrame([(1, words(5), "a")] * 40 + [(2, words(90), "b")],
                                 "doc_id bigint, text string, source string")
    rows = mixing.mixture(docs).collect()
    assert len({r.taken for r in rows if r.doc_id == 1}) == 1


def test_empty(spark):
    assert mixing.mixture(empty(spark)).collect() == []
    assert mixing.take(empty(spark)).collect() == []
