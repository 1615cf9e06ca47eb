"""The rule ledger against plain counting."""

from rolewise.llm import quality
from tests.llm.helpers import MIDDLE, ODD, empty, odd, small


def plain(text):
    words = [""]
    for c in text or "":
        if c in " \t\n\v\f\r":
            words.append("")
        else:
            words[-1] += c
    words = [w for w in words if w]
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    seen = {}
    for k, w in enumerate(windows):
        seen.setdefault(w, []).append(k)
    covered = {k + j for ks in seen.values() if len(ks) > 1 for k in ks for j in range(3)}
    lines = [x for x in (text or "").split("\n") if any(c not in " \t\v\f\r" for c in x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered), len(lines), sum("!!" in w for w in words))


def test_measures(spark):
    texts = [r[1] for r in ODD] + ["a b c a b c", "a a a a", "a\na\n\n b\na", "x|y <z> !! a!!b",
                                   "a　b", "the end. the end. the end"]
    texts += [r.text for r in small(spark).limit(60).collect()]
    for text in texts:
        assert quality.measure(text) == plain(text)


def test_long_texts_are_read_in_pieces(monkeypatch):
    from rolewise.llm import common
    text = " ".join(str(k % 61 * (k % 7)) + "!!" * (k % 9 == 0) for k in range(3000))
    whole = quality.measure(text)
    monkeypatch.setattr(common.word_lists, "__defaults__", (50,))
    assert quality.measure(text) == whole == plain(text)


def test_verdicts_agree_with_labels(spark):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = quality.op7_rule_ledger(spark, MIDDLE).collect()
    assert all(not r.kept for r in rows if label.get(r.doc_id) == 0)
    assert all(r.kept for r in rows if label.get(r.doc_id) == 1 and not r.base_failed)


def test_ablations_equal_recounting(spark):
    rows = quality.ledger(small(spark, MIDDLE))
    bits = [r.failures for r in rows.collect()]
    got = {(r.version, r.rule): r for r in quality.ablations(rows).collect()}
    for policy in quality.POLICIES.values():
        for rule in policy.rules:
            bit = 1 << list(quality.RULES).index(rule)
            r = got[(policy.version, rule)]
            assert r.failed == sum(bool(b & bit) for b in bits)
            assert r.kept == sum(not b & policy.mask for b in bits)
            assert r.kept_without == sum(not b & policy.mask & ~bit for b in bits) == r.kept + r.failed_alone


def test_odd_rows(spark):
    docs = odd(spark)
    rows = quality.ledger(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.failures & 1 for r in rows if r.doc_id in (2, 3, 4))
    assert quality.ledger(empty(spark)).collect() == []
    assert {r.kept for r in quality.ablations(quality.ledger(empty(spark))).collect()} == {0}
