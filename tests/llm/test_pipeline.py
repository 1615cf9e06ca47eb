"""The pipeline against its stages worked out plainly."""

import corpus_pipeline
from rolewise.llm import decontamination, language, lines, mixing, simhash
from tests.llm.helpers import SMALL, odd, small
from tests.llm.test_lines import plain as plain_lines
from tests.llm.test_mixing import plain as plain_targets
from tests.llm.test_simhash import components


def test_run_equals_plain_stages(spark):
    rows = {r.doc_id: r for r in small(spark).collect()}
    model = language.Model(language.learn(language.learned_from(small(spark))))
    told = {d: r.text for d, r in rows.items()
            if model.predict(r.text)[0] != "und" and model.predict(r.text)[1] >= language.NARROW}
    cut = {d: t for (d, _), t in plain_lines(list(told.items()), lines.MIN_WORDS).items()}
    cut = {d: t for d, t in cut.items() if t == told[d] or t.split()}
    groups = components([(d, simhash.fingerprint(t)) for d, t in cut.items()])
    kept = {d for (d, _), c in groups.items() if c == d}
    bench = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    items = [decontamination.words_of(t) for t in bench]

    def leaks(text):
        from tests.llm.test_decontamination import nearest

        words = decontamination.words_of(text)
        return any(len(set(i) & set(words)) >= len(set(i)) - len(i) // 5
                   and nearest(i, words) <= len(i) // 5 for i in items)

    clean = {d for d in kept if not leaks(cut[d])}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in got} <= clean
    assert all(r.text == cut[r.doc_id] and r.lang == rows[r.doc_id].lang for r in got)
    sizes = {d: len(cut[d].split()) for d in clean}
    targets = plain_targets([(rows[d].source, sizes[d]) for d in clean])
    for source, target in targets.items():
        mine = [d for d in clean if rows[d].source == source]
        taken = sum(r.copies * sizes[r.doc_id] for r in got if r.source == source)
        assert abs(taken - target) <= max(sizes[d] for d in mine) / 2 + 1e-6


def test_stages_keep_the_columns(spark, tmp_path):
    docs = odd(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.columns == [*columns, "copies"]
    assert last.count() > 0


def test_stages_take_no_rows(spark):
    docs = small(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).collect() == [], name


def test_one_of_repeated_rows_stays(spark):
    docs = odd(spark)
    ids = [r.doc_id for r in simhash.representatives(docs).collect()]
    assert len(ids) == len(set(ids)) and 5 not in ids and 1 in ids
    assert mixing.take(docs).count() > 0
