"""Language-model scores: base by plain counting, the model by its probabilities."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from rolewise.llm import scoring as S
from tests.llm.helpers import MIDDLE, empty, odd, small


def tokens(text):
    return (text or "").encode().lower().split() + [S.END]


def remainder(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 10


def check_base(docs, rows):
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    counts = Counter(w for d, t in texts if remainder(d) not in (0, None) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    wanted = []
    for d, t in texts:
        words = tokens(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        wanted.append((d, len(words), sum(counts[w] > 0 for w in words), n, pytest.approx(base, abs=1e-6)))
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows]
    assert len(got) == len(wanted)
    for g, w in zip(sorted(got), sorted(wanted, key=lambda w: (w[0], w[1], w[2]))):
        assert g == w


def test_base_and_model(spark):
    docs = small(spark, MIDDLE)
    rows = S.op3_maxent_scoring(spark, MIDDLE).collect()
    check_base(docs, rows)
    assert all(r.held_out == (remainder(r.doc_id) == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.02 * sum(r.n_tokens for r in held)


@pytest.mark.parametrize("limit", [0, 40, 10**6])
def test_small_tables_change_no_base_score(spark, monkeypatch, limit):
    monkeypatch.setattr(S.vocabulary, "__defaults__", (limit,))
    docs = small(spark).limit(60)
    rows = S.scored(docs).collect()
    check_base(docs, rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_probabilities_add_up_to_one(spark):
    docs = small(spark).limit(80)
    counts = S.word_counts(docs)
    vocab, _ = S.vocabulary(counts)
    weights = S.train(docs, vocab, rounds=2)
    vocab = vocab.prepare()
    assert any(w.any() for w in weights)
    model = S.Model(vocab, *weights)
    known = {bytes(r.word): r.n for r in counts.collect()}
    words = list(known)
    for context in ((0, 0), (zlib.crc32(b"the"), 0), (zlib.crc32(b"of"), zlib.crc32(b"the"))):
        classes, places, _, _, _ = vocab.encode(words)
        before, skipped = (np.full(len(words), c, dtype=np.int64) for c in context)
        own = model.run(classes, places, before, skipped, train=False)
        tail = places < 0
        own[tail] += np.log10([known[w] + 0.1 for w, t in zip(words, tail) if t])
        own[tail] -= vocab.tail_total[classes[tail] - S.HEAD_CLASSES]
        total = (10 ** own).sum()
        # Unknown words have one share in every tail class.
        kinds = np.arange(S.HEAD_CLASSES, S.CLASSES)
        share = model.run(kinds, np.full(len(kinds), -1), *(np.full(len(kinds), c) for c in context), train=False)
        total += (10 ** (share - vocab.tail_total) * 0.1).sum()
        # So have classes of head words that no word fills.
        empty_classes = [k for k in range(S.HEAD_CLASSES) if k * S.HEAD_WORDS >= len(vocab.words)]
        if empty_classes:
            kinds = np.array(empty_classes)
            total += (10 ** model.run(kinds, np.full(len(kinds), -1), *(
                np.full(len(kinds), c) for c in context), train=False)).sum()
        assert total == pytest.approx(1, abs=1e-4)


def test_sums_as_a_tree(spark, monkeypatch):
    monkeypatch.setattr(S, "FAN_IN", 2)
    docs = small(spark).limit(60).repartition(5, "doc_id")
    vocab, _ = S.vocabulary(S.word_counts(docs))
    weights = S.train(docs, vocab, rounds=1)
    assert any(w.any() for w in weights)


def test_odd_rows(spark):
    rows = S.scored(odd(spark)).collect()
    check_base(odd(spark), rows)
    assert all(math.isfinite(r.score) for r in rows)
    assert S.scored(empty(spark)).collect() == []


def test_no_training_document(spark):
    docs = spark.createDataFrame([(next(k for k in range(99) if remainder(k) == 0), "a b")],
                                 "doc_id bigint, text string")
    row = S.scored(docs).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
