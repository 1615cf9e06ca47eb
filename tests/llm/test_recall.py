"""Recall of the decontamination search by length of the item and kind of edit."""

import random

import pytest

from rolewise.llm import decontamination as D


@pytest.mark.parametrize("size", [10, 19, 22, 29, 39, 60, 100, 200])
@pytest.mark.parametrize("kind", ["substitution", "insertion", "deletion", "mix"])
def test_recall_at_most_edits(size, kind):
    rng = random.Random(size)
    word = lambda: f"w{rng.randrange(5000)}"
    bench = [" ".join(word() for _ in range(size)) for _ in range(20)]
    texts, wanted = [], []
    for _ in range(150):
        b = rng.randrange(len(bench))
        words = bench[b].split()
        for _ in range(size // D.TOLERANCE):
            k = kind if kind != "mix" else rng.choice(["substitution", "insertion", "deletion"])
            p = rng.randrange(len(words))
            words[p:p + (k != "insertion")] = [] if k == "deletion" else [word()]
        texts.append(" ".join([word() for _ in range(30)] + words + [word() for _ in range(30)]))
        wanted.append(b)
    items = D.Items(list(range(len(bench))), bench).prepare()
    found = {(t, i) for t, i, *_ in items.search(texts)}
    recall = sum(w in found for w in enumerate(wanted)) / len(wanted)
    print(f"{size} words, {kind}: {recall:.3f}")
    assert recall >= 0.98
