"""Decontamination against exact edit distances, and the recall of its search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolewise.llm import decontamination as D
from tests.llm.helpers import MIDDLE, empty, odd, small


def nearest(item, text):
    """Smallest edit distance of the item to any stretch of the text, row by row."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != v)))
        row = new
    return min(row)


def test_verification_is_exact():
    rng = random.Random(2)
    for _ in range(500):
        item = np.array([rng.randrange(1, 5) for _ in range(rng.randrange(1, 12))])
        text = np.array([rng.randrange(5) for _ in range(rng.randrange(0, 20))], dtype=int)
        assert D.distance_within(item, text)[0] == nearest(item.tolist(), text.tolist())


def prepared(texts):
    return D.Items(list(range(len(texts))), texts).prepare()


def test_recall_of_edited_passages(spark):
    rng = random.Random(1)
    bench = [r.text for r in spark.read.parquet(f"{MIDDLE}/benchmark.parquet").collect()]
    filler = [w for r in small(spark).limit(60).collect() for w in r.text.split()]
    texts, wanted = [], []
    for _ in range(600):
        b = rng.randrange(len(bench))
        words = bench[b].split()
        for _ in range(rng.randint(0, len(words) // D.TOLERANCE)):
            p, kind = rng.randrange(len(words)), rng.randrange(3)
            words[p:p + (kind != 1)] = [] if kind == 2 else [rng.choice(filler)]
        texts.append(" ".join(rng.choices(filler, k=rng.randrange(60)) + words
                              + rng.choices(filler, k=rng.randrange(60))))
        wanted.append(b)
    found = {(t, i) for t, i, *_ in prepared(bench).search(texts)}
    assert sum(w in found for w in enumerate(wanted)) >= 0.98 * len(wanted)


def test_against_brute_force(spark):
    docs = small(spark)
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(12)
    got = {(r.doc_id, r.item_id): r.distance for r in D.contaminated(docs, bench).collect()}
    items = [(r.item_id, D.words_of(r.text)) for r in bench.collect()]
    wanted = {}
    for r in docs.collect():
        words = D.words_of(r.text)
        for item_id, item in items:
            # A stretch within d edits holds all but d of the item's words.
            if len(set(item) & set(words)) >= len(set(item)) - len(item) // 5:
                distance = nearest(item, words)
                if distance <= len(item) // 5:
                    wanted[(r.doc_id, item_id)] = distance
    assert got == wanted


def test_short_and_odd_items(spark):
    docs = odd(spark)
    items = spark.createDataFrame(
        [(1, "One"), (2, "one two"), (3, None), (4, " "), (5, ""), (None, "ONE TWO"), (7, "absent words")],
        "item_id bigint, text string")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in D.contaminated(docs, items).collect()),
                 key=str)
    assert got == sorted([(9, 1, 0), (10, 1, 0), (10, 2, 0), (10, None, 0)], key=str)
    kept = D.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 5, 6, 7, 8, 11]


def test_empty_tables(spark):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert D.contaminated(empty(spark), bench).collect() == []
    assert D.contaminated(small(spark), bench.limit(0)).collect() == []
    assert D.decontaminated(small(spark), bench.limit(0)).count() == small(spark).count()


@pytest.mark.parametrize("size", [1, 10**9])
def test_blocks_of_the_benchmark(spark, size, monkeypatch):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(3)
    monkeypatch.setattr(D.item_blocks, "__defaults__", (size if size > 1 else 200,))
    got = sorted(map(tuple, D.contaminated(small(spark, MIDDLE), bench).collect()))
    monkeypatch.setattr(D.item_blocks, "__defaults__", (1 << 22,))
    assert got == sorted(map(tuple, D.contaminated(small(spark, MIDDLE), bench).collect()))


def test_copies_of_an_item_share_a_block(spark, monkeypatch):
    bench = spark.read.parquet(f"{MIDDLE}/benchmark.parquet").select("item_id", "text")
    hot = bench.orderBy("item_id").limit(1).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(500))))
    copied = bench.unionByName(hot.select((F.col("item_id") + 10**6 + F.col("k")).alias("item_id"), "text"))
    monkeypatch.setattr(D.item_blocks, "__defaults__", (4_000,))
    blocks = list(D.item_blocks(copied))
    distinct = bench.where("text IS NOT NULL").select("text").distinct().count()
    assert len(blocks) > 1 and sum(len(b.texts) for b in blocks) == distinct
    docs = small(spark, MIDDLE).limit(150)
    left = {r.doc_id for r in D.decontaminated(docs, copied).collect()}
    hit = {r.doc_id for r in D.contaminated(docs, bench).select("doc_id").distinct().collect()}
    assert left == {r.doc_id for r in docs.collect()} - hit
