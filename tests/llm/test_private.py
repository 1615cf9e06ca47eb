"""Personal data: patterns as written, and what the CRF may add."""

import hashlib
import random
import re
import time

import numpy as np

from rolewise.llm import private as P
from tests.llm.helpers import MIDDLE, empty, odd, small


def plain(text):
    def ok_card(m):
        digits = re.sub(r"\D", "", m)
        total = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1]))
        return 16 <= len(digits) <= 19 and total % 10 == 0

    def ok_phone(m):
        return 8 <= len(re.sub(r"\D", "", m)) <= 15

    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", ok_card), (r"\+[0-9][\x20().0-9-]+[0-9]", ok_phone)]
    return [[m.span() for m in re.finditer(p, text) if ok(m[0])] for p, ok in rules]


def test_patterns():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", "@x.yz", ".", "..", "-", " ", "1", "12", "255.", "256.", "0.0.0.0", "+1", "+49 (", ")",
             "4111 1111 1111 1111", "4111111111111112", "\n", "é", "٣", "%", "a@b", "1.2.3.4.5.6.7.8", "000255."]
    for _ in range(20000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 9)))
        assert P.base_spans(text) == plain(text), text


def test_time_grows_with_the_text():
    start = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "+1" + "(" * 300_000, "1." * 150_000, "@" * 300_000, "a@" * 150_000):
        P.base_spans(text)
    assert time.time() - start < 10


def sample(spark):
    return [r.text for r in small(spark, MIDDLE).collect()]


def test_repeated_numbers_get_one_label(spark):
    model = P.fit(sample(spark))
    words = " the and of was there to see it all. "
    text = ("Call +1 (743) 555-3824 now." + words * 3 + "Then (743) 555-3824 rang." + words
            + "Card 4225 4653 7264 2739 and" + words + "mail re.46@mail8.example.com!" + words)
    base = P.base_spans(text)
    added = P.added_spans([text], [base], model)[0]
    at = text.index("(743) 555-3824 rang")
    assert [text[s:e] for s, e in added[3]] == ["(743) 555-3824"] and added[3][0][0] == at
    taken = [s for kind in base for s in kind]
    assert all(e <= s2 or s >= e2 for kind in added for s, e in kind for s2, e2 in taken)


def test_clean_documents_get_no_spans(spark):
    model = P.fit(sample(spark))
    texts = ["In 1984 there were 12 men and 3 dogs. Version 2.0. of 1,000 at 10:30.",
             'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and 743 twice 743', "no digit at all", ""]
    found = [P.base_spans(t) for t in texts]
    assert all(not kind for doc in P.added_spans(texts, found, model) for kind in doc)


def test_messages_equal_enumeration():
    """On a tree the message passing is exact."""
    rng = np.random.default_rng(1)
    field = P.Field(rng.normal(size=(5, 3)), rng.normal(size=(5, 5)), None)
    skip = rng.normal(size=(5, 5))
    field.skip = (skip + skip.T) / 2
    nodes = P.Nodes([(0, k, k + 1) for k in range(4)], rng.normal(size=(4, 3)), np.array([0, 2, 0, 0]),
                    np.array([[0, 1], [1, 2]]), np.array([[0, 3]]))
    got = field.beliefs(nodes, rounds=60)
    local = nodes.features @ field.unary.T
    wanted = np.zeros((4, 5))
    for code in range(5 ** 4):
        y = [code // 5 ** k % 5 for k in range(4)]
        if y[1] != 2:
            continue
        score = sum(local[k, y[k]] for k in (0, 2, 3))
        score += field.chain[y[0], y[1]] + field.chain[y[1], y[2]] + field.skip[y[0], y[3]]
        for k in range(4):
            wanted[k, y[k]] += np.exp(score)
    assert np.allclose(got, wanted / wanted.sum(axis=1, keepdims=True), atol=1e-6)


def test_documents(spark):
    docs = small(spark, MIDDLE)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = P.op8_skip_chain_pii(spark, MIDDLE).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(b) for b in base]
        assert r.base_sha256 == hashlib.sha256(P.joined(base).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(P.joined(base).split(",")) - {""} <= set(every) and len(every) == sum(map(len, base)) + r.n_added
    assert sum(r.n_added > 0 for r in rows) <= 0.02 * len(rows)


def test_odd_rows(spark):
    rows = P.personal_data(odd(spark)).collect()
    assert len(rows) == odd(spark).count()
    assert {r.base_sha256 for r in rows if r.doc_id == 2} == {hashlib.sha256(b"").hexdigest()}
    assert P.personal_data(empty(spark)).collect() == []
