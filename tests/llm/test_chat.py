"""Prefix-target expansion: examples written out plainly, round trips, odd rows."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from rolewise.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
ROWS = [
    (1, 0, "system", "Be <|end|> kind."), (1, 1, "user", "Hi"), (1, 2, "assistant", "a<|turn user|>\nb"),
    (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "bye"),
    (2, 0, "assistant", "alone \\ <\\|"), (3, 0, "user", "no reply"),
    (4, 1, "assistant", "x"), (4, 1, "assistant", "x"), (4, None, "user", "first"),
    (None, 0, "user", "lost"), (None, 1, "assistant", "found"), (None, 1, "assistant", "found"),
    (5, 0, None, "no role"), (5, 1, "assistant", "Über \U0001f600 " + "long " * 200000), (5, 2, "a|>b<|", "|>"),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "s", 1, True) for r in rows], SCHEMA + ", single string, example int, last boolean")


def plain(rows):
    """The rows of `read_back`, by lists."""
    groups, out = {}, []
    for k, (conv, turn, role, text) in enumerate(rows):
        key = (conv, k if conv is None else None)
        groups.setdefault(key, []).append((turn is not None, turn or 0, role or "", text or ""))
    for (conv, _), members in groups.items():
        said = [(r, t) for *_, r, t in sorted(members)]
        replies = [t for r, t in said if r == "assistant"]
        shown, chars = 0, 0
        for k, (r, t) in enumerate(said):
            shown += len(chat.header(r) + chat.escaped(t) + chat.END)
            if r == "assistant" or k == len(said) - 1:
                chars += shown
        out.append((conv, len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len("".join(replies)),
                    sha("".join(replies)), chars))
    return sorted(out, key=str)


def test_digests_equal_plain_ones(spark):
    got = [tuple(r) for r in chat.read_back(chat.examples(frame(spark))).collect()]
    assert sorted(got, key=str) == plain(ROWS)


def test_each_reply_is_an_example_of_its_own(spark):
    rows = sorted(chat.examples(frame(spark)).where("conv_id = 1").collect(), key=lambda r: r.example)
    assert [(r.n_turns, r.last) for r in rows] == [(3, False), (5, False), (6, True)]
    assert rows[0].text == ("<|turn system|>\nBe <\\|end|> kind.<|end|>\n<|turn user|>\nHi<|end|>\n"
                            "<|turn assistant|>\na<\\|turn user|>\nb<|end|>\n")
    assert rows[0].text[rows[0].loss_start:rows[0].loss_end] == "a<\\|turn user|>\nb"
    assert rows[1].text.startswith(rows[0].text) and rows[1].loss_start == rows[1].loss_end
    assert rows[2].loss_start is None and list(chat.turns(rows[2].text))[-1] == ("user", "bye")


def test_batches_are_cut(spark, monkeypatch):
    whole = sorted(map(tuple, chat.examples(frame(spark)).collect()), key=str)
    monkeypatch.setattr(chat, "FLUSH", 1)
    assert sorted(map(tuple, chat.examples(frame(spark)).collect()), key=str) == whole


def test_empty_table(spark):
    rows = chat.examples(frame(spark, []))
    assert rows.count() == 0 and chat.read_back(rows).count() == 0


marks = st.text(alphabet="<|>\\ae\n", max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(marks, st.one_of(marks, st.sampled_from(["<|end|>\n", "<|turn a|>\n", chat.SAID]))), max_size=4))
def test_any_text_comes_back(said):
    written = "".join(chat.header(r) + chat.escaped(t) + chat.END for r, t in said)
    assert list(chat.turns(written)) == said
    assert written.count(chat.OPEN) == written.count("<|end|>") == len(said)


def test_sql_twin_on_odd_rows(spark):
    import duckdb
    con = duckdb.connect()
    con.register("conversations", frame(spark).select("conv_id", "turn", "role", "text").toPandas().astype(
        {"conv_id": "Int64", "turn": "Int64"}))
    got = con.execute(chat.OP11_SQL).fetchall()
    assert sorted(got, key=str) == plain([*ROWS, (-7, 0, "user", chat.SAID), (-7, 1, "assistant", chat.SAID)])
