"""Trie codes against plain loops over all entries."""

import hashlib
import math
import random

import numpy as np
import pytest

from rolewise.llm import codes

SCHEMA = "vec_id bigint, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def rows(n=400, size=8, seed=1):
    pick = random.Random(seed)
    made = [(i, [pick.choice([-0.3, -0.1, 0.0, 0.05, 0.2, pick.uniform(-1, 1)]) for _ in range(size)], pick.choice([0, 1, None]))
            for i in range(n)]
    made += [(1000 + i, made[3][1], 2) for i in range(150)]  # many copies of one vector
    made += [(7, made[9][1], 0), (7, made[9][1], 0), (None, made[4][1], 1)]  # repeated and missing ids
    odd = [(-5, None, 0), (-4, [None] + [0.1] * (size - 1), 0), (-3, [NAN] * size, 0), (-2, [INF] + [0.0] * (size - 1), 0),
           (2000, [0.1] * (size - 1), 0), (2001, [], None), (2002, [1e30, -1e30] + [0.0] * (size - 2), 3)]
    return made + odd


def plain(table, entries, rounds=4):
    """{(vec_id, label, code, error): count} and the digest, entry by entry."""
    kept = [(v, [max(-codes.LIMIT, min(codes.LIMIT, math.floor(float(np.float32(x)) * 1024))) for x in e], l)
            for v, e, l in table if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    size = next(len(q) for v, q, _ in sorted(kept, key=lambda r: (r[0] is None, r[0])) if q and len(q) % 4 == 0)
    width = size // 4
    fit = [r for r in kept if len(r[1]) == size]
    first = {}
    for v, q, _ in fit:
        if v is not None:
            first[v] = min(q, first.get(v, q))
    start = [first[v] for v in sorted(first)[:entries]]
    cut = lambda q, p: q[p * width:(p + 1) * width]
    books = [[cut(q, p) for q in start] for p in range(4)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for _, q, _ in fit:
                groups.setdefault(nearest(cut(q, p), books[p])[1], []).append(cut(q, p))
            for i, members in groups.items():
                books[p][i] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for v, q, l in kept:
        if len(q) != size:
            out.append((v, l, None, None))
            continue
        found = [nearest(cut(q, p), books[p]) for p in range(4)]
        out.append((v, l, tuple(i for _, i in found), sum(d for d, _ in found)))
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(out, key=str), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("entries", [5, 64])
def test_equals_plain_loops(spark, entries):
    table = rows()
    frame = spark.createDataFrame([(*r, "x", 1, 0.5) for r in table], SCHEMA + ", q string, position int, error double")
    got, books = codes.compress(frame, entries=entries)
    found = sorted(((r.vec_id, r.label, None if r.codes is None else tuple(r.codes), r.error) for r in got.collect()), key=str)
    assert (found, codes.digest(books)) == plain(table, entries)


def test_trie_equals_all_distances():
    pick = np.random.default_rng(2)
    for n, depth, spread in [(1, 4, 3), (300, 1, 40), (500, 6, 3), (200, 16, 900), (64, 40, 2)]:
        distinct = np.unique(pick.integers(-spread, spread, (n, depth)), axis=0)
        book = np.concatenate([pick.integers(-spread, spread, (9, depth)), distinct[:3], distinct[:3]])
        off = ((distinct[:, None, :] - book[None]) ** 2).sum(axis=2)
        found, errors = codes.trie_codes(distinct, book)
        assert (found == off.argmin(axis=1)).all() and (errors == off.min(axis=1)).all()
    far = np.array([[codes.LIMIT] * 4, [codes.LIMIT - 1] * 4])[::-1]
    assert codes.trie_codes(far, -far)[1].tolist() == [((2 * codes.LIMIT - 2) ** 2) * 4, ((2 * codes.LIMIT - 1) ** 2) * 4]


def test_a_deep_chain_needs_no_recursion():
    rows_ = np.tril(np.ones((3000, 3000), dtype=np.int64))[::-1]
    order = codes.in_order(rows_)
    found, errors = codes.trie_codes(rows_[order], rows_[order][:4])
    assert found[:4].tolist() == [0, 1, 2, 3] and errors[:4].tolist() == [0] * 4


def test_small_batches(spark, monkeypatch):
    frame = spark.createDataFrame(rows(60), SCHEMA)
    whole = codes.compress(frame, entries=8)
    monkeypatch.setattr(codes, "BATCH", 3)
    cut = codes.compress(frame, entries=8)
    assert codes.digest(whole[1]) == codes.digest(cut[1])
    assert sorted(map(str, whole[0].collect())) == sorted(map(str, cut[0].collect()))


def test_tables_without_vectors(spark, tmp_path):
    for table in ([], [(1, None, 0)], [(1, [], 0), (2, [0.5], None)], [(None, [0.5] * 4, 1)]):
        frame = spark.createDataFrame(table, SCHEMA)
        got, _ = codes.compress(frame)
        assert all(r.codes is None and r.error is None for r in got.collect())
        frame.write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        assert codes.op13_trie_codes(spark, str(tmp_path)).count() == got.count()
