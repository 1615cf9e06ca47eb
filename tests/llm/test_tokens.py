"""Token counts against the tokenizer library on whole texts."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from rolewise.llm import tokens
from tests.llm.helpers import MIDDLE, empty, odd, small

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [len(e) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_every_code_point():
    texts = [f"a{chr(c)} 1{chr(c)}b{chr(c)}\n" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    assert tokens.Counting(PATH).texts(texts) == library(texts)


def test_random_texts():
    rng = random.Random(1)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'LL", "'ll", "1", "٣", "!", "<|endoftext|>",
             "<|endoftext", "\x1c", "\x85", "​", "　", "\U0001f600", "\xa0", "x" * 90]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(5000)]
    assert tokens.Counting(PATH, {" a": 1}).texts(texts) == library(texts)


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 3)
    texts = ["alpha beta gamma delta", "delta gamma beta alpha epsilon", ""] * 3
    assert tokens.Counting(PATH).texts(texts) == library(texts)


def test_documents(spark):
    for docs in (small(spark, MIDDLE), odd(spark)):
        rows = docs.select("doc_id", "text").collect()
        wanted = sorted(zip([r.doc_id for r in rows], [len((r.text or "").encode()) for r in rows],
                            library([r.text for r in rows])))
        assert sorted(map(tuple, tokens.token_counts(docs, PATH).collect())) == wanted
    assert tokens.token_counts(empty(spark), PATH).collect() == []
