"""Near-duplicates of five-word shingles against the exact similarity of all pairs."""

import random

import corpus_pipeline
from rolewise.llm import near
from tests.llm.helpers import MIDDLE, SCHEMA, SMALL, empty, odd, small


def plain(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) or frozenset(
        [tuple(words)] if words else [])


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def components(texts):
    """{doc_id: smallest doc_id} by comparing all pairs."""
    lowest = {}
    for d, t in texts:
        lowest[plain(t)] = min(d, lowest.get(plain(t), d))
    parent = {s: s for s in lowest}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    values = list(lowest)
    for i, a in enumerate(values):
        for b in values[:i]:
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and similar(a, b):
                parent[root(a)] = root(b)
    least = {}
    for s, d in lowest.items():
        least[root(s)] = min(d, least.get(root(s), d))
    return {d: least[root(plain(t))] for d, t in texts}


def test_stage_drops_edited_copies(spark):
    rng = random.Random(3)
    base = [w for r in small(spark).limit(40).collect() for w in r.text.split()]
    rows = []
    for k in range(40):
        words = rng.choices(base, k=300)
        rows += [(k, " ".join(words)), (100 + k, edited(rng, words, 5))]
    docs = spark.createDataFrame([(d, t, "en", "src0", len(t)) for d, t in rows], SCHEMA)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted(r.doc_id for r in stage(spark, docs, SMALL).collect()) == list(range(40))


def test_recall_at_the_limit():
    rng = random.Random(4)
    count, met, total = near.bands(), 0, 0
    while total < 400:
        words = [str(rng.randrange(10**6)) for _ in range(400)]
        other = edited(rng, words, 9)
        a, b = near.shingles(" ".join(words)), near.shingles(other)
        both = len(set(a.tolist()) & set(b.tolist()))
        if 0.8 <= both / (len(a) + len(b) - both) <= 0.84:
            total += 1
            met += bool(set(near.band_keys(a, count)) & set(near.band_keys(b, count)))
    assert met >= 0.99 * total


def test_components_equal_all_pairs(spark):
    for docs in (small(spark, MIDDLE), odd(spark)):
        wanted = components([(r.doc_id, r.text) for r in docs.collect()])
        got = {r.doc_id: r.component_id for r in near.near_duplicates(docs).collect()}
        assert got == wanted


def test_large_groups_lose_no_link(spark):
    """Copies of copies: many are far from the smallest one, but near to another."""
    rng = random.Random(5)
    words = [str(rng.randrange(10**6)) for _ in range(300)]
    rows = [(0, " ".join(words))]
    for d in range(1, 80):
        rows.append((d, edited(rng, rng.choice(rows)[1].split(), 4)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in near.near_duplicates(docs).collect()} == components(rows)


def test_pages_of_a_template_are_not_compared_in_pairs(spark):
    """All share most of their keys with others, and no two are near."""
    rng = random.Random(6)
    template = [str(rng.randrange(10**6)) for _ in range(300)]
    pages = [(d, " ".join(template + [f"own{d}x{k}" for k in range(60)])) for d in range(600)]
    near_pages = [(1000 + d, edited(rng, pages[d][1].split(), 4)) for d in range(0, 40)]
    rows = pages + near_pages
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = spark.createDataFrame(
        [(d, d, near.shingles(t).view("i8").tolist()) for d, t in rows], "fp bigint, part bigint, found array<bigint>")
    pairs = {(r.u, r.v) for r in near.prefix_pairs(sets).collect()}
    assert len(pairs) <= 2 * len(near_pages)
    assert {(1000 + d, d) for d in range(40)} <= pairs
    got = {r.doc_id: r.component_id for r in near.near_duplicates(docs).collect()}
    assert got == {d: d % 1000 for d, _ in rows}


def test_prefixes_lose_no_similar_pair(spark):
    rng = random.Random(7)
    rows = []
    for fp in range(150):
        base = rng.choice(rows)[2] if rows and rng.random() < 0.7 else rng.sample(range(90), rng.randrange(1, 45))
        kept = [x for x in base if rng.random() > 0.06]
        rows.append((fp, fp % 140, sorted({*kept, *rng.sample(range(90), rng.randrange(3))} or {1})))
    sets = spark.createDataFrame(rows, "fp bigint, part bigint, found array<bigint>")
    for similarity in (0.5, 0.8, 1.0):
        wanted = {(a, b) for a, p, s in rows for b, q, r in rows if a > b and p != q
                  and len({*s} & {*r}) >= similarity * len({*s} | {*r})}
        got = {(r.u, r.v) for r in near.prefix_pairs(sets, similarity).collect()}
        assert wanted <= got and len(wanted) > 0


def test_empty(spark):
    assert near.near_duplicates(empty(spark)).collect() == []
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b")], "doc_id bigint, text string")
    assert near.representatives(docs).count() == 3


def test_pipeline_links_by_simhash_and_by_jaccard(spark):
    """Links of both methods join groups; op10 links are among them."""
    import corpus_pipeline
    from rolewise.llm import simhash

    words = [f"w{k}" for k in range(400)]
    first = " ".join(words)
    base = simhash.fingerprint(first)
    other = next(t for k in range(400) for j in range(50) for t in [
        " ".join([*words[:k], f"x{j}", *words[k + 1:]])] if (simhash.fingerprint(t) ^ base).bit_count() <= 2)
    rows = [(1, first), (2, other), (3, "entirely of its own " * 9), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 3, 2), (4, 4, 4)], "doc_id long, sig long, component_id long")
    more = spark.createDataFrame([(1, 1, 1), (2, 2, 1), (3, 3, 3), (4, 4, 4)], "doc_id long, sig long, component_id long")
    joined = {r.doc_id: r.component_id for r in near.joined(found, more).collect()}
    assert joined == {1: 1, 2: 1, 3: 1, 4: 4}
    stays = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert stays == {1, 3, 4}
