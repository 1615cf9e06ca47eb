"""Winnowed line deletion against all runs of all documents."""

import random
import re

import numpy as np

from rolewise.llm import lines
from tests.llm.helpers import MIDDLE, empty, odd, small


def plain(docs, least):
    """{(doc_id, text): text left}: every run of every document against all earlier ones."""
    seen, fresh, out, group = set(), set(), {}, object()
    for doc_id, text in sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0)):
        if doc_id != group:
            seen, fresh, group = seen | fresh, set(), doc_id
        parts = [x for x in re.split(rb"(?<=[.!?])( )|(\n)", (text or "").encode()) if x is not None]
        parts, behind = parts[::2], [*parts[1::2], b""]
        units = [(k, p.strip(), len(p.split())) for k, p in enumerate(parts) if p.split()]
        gone, mine = set(), set()
        for a in range(len(units)):
            words, run = 0, []
            for b in range(a, len(units)):
                run.append(units[b][1])
                words += units[b][2]
                if words < least:
                    continue
                if tuple(run) in seen or tuple(run) in mine:
                    gone |= {units[k][0] for k in range(a, b + 1)}
                elif b - a > 60:
                    break
                mine.add(tuple(run))
        fresh |= mine
        out[(doc_id, text)] = text if text is None else b"".join(
            p + e for k, (p, e) in enumerate(zip(parts, behind)) if k not in gone).decode()
    return out


def check(docs, least):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    wanted = plain(rows, least)
    got = lines.delete_runs(docs, least).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(
        map(str, ((d, wanted[(d, t)]) for d, t in rows)))
    return got


def test_random_documents(spark):
    rng = random.Random(3)
    sentences = [" ".join(rng.choices("abcdefghij", k=rng.randrange(1, 9))) + "." for _ in range(25)]
    rows = [(rng.randrange(60) or None, "".join(s + rng.choice([" ", "\n", "\n\n"]) for s in
                                                  rng.choices(sentences, k=rng.randrange(14))))
            for _ in range(120)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), 12)


def test_supplied_documents(spark):
    got = check(small(spark), lines.MIN_WORDS)
    assert sum(r.n_deleted_lines > 0 for r in got) > 5


def test_passage_inside_other_text(spark):
    passage = "Then came the others. They had walked for days through rain and snow. " * 1 + (
        "Nobody knew what they were looking for. When asked they said nothing at all. "
        "In the end the mayor sent them away. It was the last time anyone saw them in the valley.")
    docs = spark.createDataFrame(
        [(k, f"Text {k} begins so and ends {passage} and goes on with {k}.") for k in range(50)]
        + [(99, "A clean text that stands alone. " + " ".join(f"w{k}." for k in range(60)))],
        "doc_id bigint, text string")
    got = {r.doc_id: r for r in lines.delete_runs(docs).collect()}
    assert got[0].n_deleted_lines == 0 and got[99].n_deleted_lines == 0
    assert all(got[k].n_deleted_words >= 35 and "mayor" not in got[k].text for k in range(1, 50))


def test_copies_of_a_row_add_no_runs(spark):
    passage = " ".join(f"Line {k} of a passage is here." for k in range(12))
    rows = [(1, passage)] + [(2, f"Before it. {passage}")] * 60
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    (few,) = lines.repeated_runs(docs.distinct()).collect()
    (many,) = lines.repeated_runs(docs).collect()
    assert sorted(few.runs) == sorted(many.runs)
    check(docs, lines.MIN_WORDS)


def test_windows_cover_every_run():
    rng = np.random.default_rng(0)
    for _ in range(300):
        words = rng.integers(1, 12, rng.integers(1, 14))
        first, last = lines.windows(words, 15)
        covered = np.zeros(len(words), dtype=bool)
        for a, b in zip(first, last):
            assert words[a:b + 1].sum() >= 15
            covered[a:b + 1] = True
        assert covered.all() == (words.sum() >= 15) or not len(first)
        hashes = rng.integers(-9, 9, len(words))
        assert list(lines.lowest(hashes, first, last)) == [hashes[a:b + 1].min() for a, b in zip(first, last)]


def test_odd_rows(spark):
    docs = odd(spark)
    got = check(docs, lines.MIN_WORDS)
    assert len(got) == docs.count()
    assert lines.delete_runs(empty(spark)).collect() == []
    kept = lines.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == [1, 2, 3, 4, 6, 7, 8, 9, 10, 11]
