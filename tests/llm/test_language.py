"""Language by compression: held-out accuracy and odd rows."""

import zlib

from rolewise.llm import language
from tests.llm.helpers import MIDDLE, empty, odd, small


def test_held_out_accuracy(spark):
    docs = small(spark, MIDDLE)
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language.op9_compression_language(spark, MIDDLE).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)
    assert sum(r.accepted for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_documents_are_not_used(spark):
    docs = small(spark)
    from pyspark.sql import functions as F

    changed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "xx")
                              .otherwise(F.col("lang")))
    assert language.learn(language.learned_from(docs)) == language.learn(language.learned_from(changed))


def test_odd_rows(spark):
    docs = odd(spark)
    model = language.learn(language.learned_from(small(spark)))
    rows = language.predictions(docs, model, ["doc_id"]).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert len(rows) == docs.count()
    assert got[2] == got[3] == got[4] == ("und", 0.0)
    assert got[1] == got[5] and got[1][0] == "en"
    kept = language.identified(docs)
    assert kept.columns == docs.columns
    assert not {2, 3, 4} & {r.doc_id for r in kept.collect()}


def test_no_labels_and_no_rows(spark):
    docs = odd(spark).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    assert language.learn(language.learned_from(docs)) == []
    assert {r.lang_pred for r in language.predictions(docs, [], ["doc_id"]).collect()} == {"und"}
    assert language.identified(empty(spark)).collect() == []


def test_letters():
    model = language.Model([("a", b"x" * 100)])
    assert model.predict("123 ,.!") == ("und", 0.0)
    assert model.predict("１２３ ☃") == ("und", 0.0)
    assert model.predict("語") == ("a", 1.0)
    assert language.Model([]).predict("text") == ("und", 0.0)
