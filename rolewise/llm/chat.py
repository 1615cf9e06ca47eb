r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its
context, and only its reply is trainable. A turn is written as

    <|turn ROLE|>
    TEXT<|end|>

and a line feed. Inside texts and roles a control string gets a backslash more
between its `<` and `|` (in roles also between `|` and `>`), so none can be
mistaken for a mark, and taking one backslash away gives the text back. Other
text is left as it is.

Turns behind the last reply are in the context of no example. A conversation
that ends with such turns has one row more, which holds all of it and has no
loss span, so that the examples of a conversation always hold it whole.

A conversation is laid out in one task, sorted by turn, and streamed: a task
keeps the text so far, which the next example needs anyway, and a batch of a
few MB. An example is one string, so it must stay under 2 GB of UTF-8.

Cases: rows are taken by turn (null first), then role, then text, repeated rows
and equal turns included; a null text or role is empty, and only the role
`assistant` is a reply, also an empty one; a row without conv_id is a
conversation of one turn; very long texts are held once in the context and once
in the example; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolewise.llm.common import small_batches, unused

REPLY = "assistant"
OPEN, SHUT, END = "<|turn ", "|>\n", "<|end|>\n"
#: What would be read as the start of a mark, in any text, and as the end of one, in a role.
STARTS = re.compile(r"<(\\*)\|")
ENDS = re.compile(r"\|(\\*)>")
#: Characters of examples after which a batch is passed on.
FLUSH = 4 << 20
EXAMPLE = "example int, n_turns int, text string, loss_start bigint, loss_end bigint, last boolean"


def escaped(text: str) -> str:
    return STARTS.sub(r"<\1\\|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def header(role: str) -> str:
    return OPEN + ENDS.sub(r"|\1\\>", escaped(role)) + SHUT


def turns(text: str) -> Iterator[tuple[str, str]]:
    """The (role, text) of each turn of a formatted example."""
    at = 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise ValueError(f"no turn starts at character {at}")
        shut = text.index(SHUT, at + len(OPEN))
        end = text.index(END, shut + len(SHUT))
        role = unescaped(re.sub(r"\|\\(\\*)>", r"|\1>", text[at + len(OPEN):shut]))
        yield role, unescaped(text[shut + len(SHUT):end])
        at = end + len(END)


def _expanded(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The examples of (conv_id, row number, role, text) that come conversation by conversation."""
    now, context, count, made, waiting = None, "", 0, 0, None
    for conv, single, role, text in rows:
        if (conv, single) != now:
            if waiting is not None:
                yield *waiting, True
            elif count:
                yield now[0], made + 1, count, context, None, None, True
            now, context, count, made, waiting = (conv, single), "", 0, 0, None
        if waiting is not None:
            yield *waiting, False
        count, head, body = count + 1, header(role), escaped(text)
        start = len(context) + len(head)
        context += head + body + END
        waiting = None
        if role == REPLY:
            made += 1
            waiting = (conv, made, count, context, start, start + len(body))
    if waiting is not None:
        yield *waiting, True
    elif count:
        yield now[0], made + 1, count, context, None, None, True


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, text, loss_start, loss_end, last), conversation by conversation.

    `text` is context and reply as formatted; the code points loss_start to
    loss_end (exclusive) are the reply, escaped. `last` marks the last row of a
    conversation, the one that holds all its turns. A task gives the rows of a
    conversation one after the other.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    single = unused("single", conversations)
    rows = small_batches(conversations).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias(single))
    dealt = rows.repartition("conv_id", single).sortWithinPartitions("conv_id", single, "turn", "role", "text")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def told() -> Iterator[tuple]:
            nonlocal schema
            for batch in source:
                schema = batch.schema
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", single, "role", "text")))

        held, size = [], 0
        names = ["conv_id", "example", "n_turns", "text", "loss_start", "loss_end", "last"]

        def packed() -> pa.RecordBatch:
            kinds = [schema.field("conv_id").type, pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)

        for row in _expanded(told()):
            held.append(row)
            size += len(row[3])
            if size >= FLUSH:
                yield packed()
                held, size = [], 0
        if held:
            yield packed()

    return dealt.select("conv_id", single, "role", "text").mapInArrow(batches, f"conv_id {kind}, {EXAMPLE}")


def read_back(rows: DataFrame) -> DataFrame:
    """One row per conversation, read from rows as `examples` gives them.

    turns_sha256 covers role, line feed, text, line feed of each turn of the last
    example; loss_sha256 the unescaped text under the loss spans of all examples.
    """
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, loss_chars, chars = hashlib.sha256(), 0, 0
        for batch in source:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "text", "loss_start", "loss_end", "last"))
            for conv, text, start, end, last in zip(*columns):
                chars += len(text)
                if start is not None:
                    reply = unescaped(text[start:end])
                    loss.update(reply.encode("utf-8"))
                    loss_chars += len(reply)
                if last:
                    said, n = hashlib.sha256(), 0
                    for role, words in turns(text):
                        said.update(f"{role}\n{words}\n".encode())
                        n += 1
                    out.append((conv, n, said.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    loss, loss_chars, chars = hashlib.sha256(), 0, 0
            if out:
                kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                    names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(
        batches, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint,"
                 " loss_sha256 string, formatted_chars bigint")


#: A conversation that says what formats take for marks.
SAID = r"\### Assistant: </turn> ok"
PLANTED = -7


def op11_prefix_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(PLANTED).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(REPLY).alias("role"), F.lit(SAID).alias("text"))
    return read_back(examples(table.unionByName(planted)))


OP11_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS single
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT {PLANTED}, 0, 'user', '{SAID}'
        UNION ALL SELECT {PLANTED}, 1, '{REPLY}', '{SAID}')
), r AS (
  SELECT *, length(role) + length(text) + {len(OPEN + SHUT + END)}
         + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(role, '\|\\*>'))
         + len(regexp_extract_all(text, '<\\*\|')) AS chars,
         row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id, single) AS n
  FROM c WINDOW w AS (PARTITION BY conv_id, single ORDER BY turn NULLS FIRST, role, text)
), s AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id, single ORDER BY k) AS so_far FROM r
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{REPLY}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = '{REPLY}'), '')) AS loss_sha256,
       sum(so_far) FILTER (role = '{REPLY}' OR k = n)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id, single
"""
