"""Language identification by compression.

Every language gets a zstandard raw-content dictionary, made of pieces of its
labelled texts. A text is compressed with each dictionary, block by block so
that a long text goes on being compared with the languages and not with itself,
and belongs to the language under which it becomes smallest. The gap to the
runner-up, as a share of its size, is the score; a gap below `NARROW` is too
little to tell, and the text is rejected.

Cases: a null text and one without a letter are `und` with score 0 and rejected;
with no labelled text at all every text is `und`; equal sizes go to the language
with more labelled documents, then by code point; a null id is neither learned
from nor held out; repeated rows keep a row each; an empty table gives an empty
result; further columns are carried by `identified` and ignored elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolewise.llm.common import bucket, documents, small_batches, unused

UNKNOWN = "und"
#: The training sample per language: so many documents, a piece of so many bytes of each.
SAMPLE_DOCS = 512
SAMPLE_BYTES = 400
#: Bytes of a dictionary, and of all of them together, at most.
DICTIONARY = 1 << 17
DICTIONARIES = 1 << 25
LEVEL = 6
#: A text of fewer bytes is repeated: alone it may be too short to be compressed at all.
SHORT = 200
REPEATS = 8
BLOCK = 4096
NARROW = 0.004

_OTHER = re.compile(rb"[^a-z\x80-\xff]+")


def letters(text: str) -> bytes:
    """Lower-cased bytes of a text with anything but letters made one space."""
    return _OTHER.sub(b" ", text.encode("utf-8").lower())


def has_letter(text: str, plain: bytes) -> bool:
    return (not text.isascii() and any(map(str.isalpha, text))) or (text.isascii() and plain.strip() != b"")


class Model:
    """Dictionaries by language, most labelled documents first."""

    def __init__(self, dictionaries: list[tuple[str, bytes]]) -> None:
        self.languages = [name for name, _ in dictionaries]
        self.compressors = [self._compressor(data) for _, data in dictionaries]

    @staticmethod
    def _compressor(data: bytes):
        content = zstandard.ZstdCompressionDict(
            data.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(
            level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False,
            write_dict_id=False)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score) of a whole text."""
        plain = letters(text) if text else b""
        if not text or not self.languages or not has_letter(text, plain):
            return UNKNOWN, 0.0
        if len(plain) < SHORT:
            plain = (plain.strip() + b" ") * REPEATS
        sizes = [
            sum(len(c.compress(plain[k:k + BLOCK])) for k in range(0, len(plain), BLOCK))
            for c in self.compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.languages[best], 1.0
        second = min(s for k, s in enumerate(sizes) if k != best)
        return self.languages[best], (second - sizes[best]) / second


def learn(labelled: DataFrame) -> list[tuple[str, bytes]]:
    """Dictionaries from (text, lang), by number of documents and code point.

    The sample per language is bounded, so what reaches the driver is too.
    Documents are picked by a hash of their text, each gives its middle piece.
    """
    usable = labelled.where("lang IS NOT NULL")
    counts = usable.groupBy("lang").count().collect()
    languages = sorted(counts, key=lambda r: (-r["count"], r.lang.encode()))
    if not languages:
        return []
    # About twice the sample by hash, so that no language's texts are shuffled whole.
    share = F.create_map(*[F.lit(v) for r in languages for v in (r.lang, 2.0 * SAMPLE_DOCS / r["count"])])
    order = F.xxhash64("text")
    picked = usable.where("text <> ''").where(
        F.pmod(order, F.lit(1_000_003)) / 1_000_003 < share[F.col("lang")])
    ranked = picked.select("lang", order.alias("order"), "text").withColumn(
        "r", F.row_number().over(W.partitionBy("lang").orderBy("order", "text"))
    ).where(F.col("r") <= SAMPLE_DOCS)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            cut = []
            for text in batch.column("text").to_pylist():
                plain = letters(text)
                start = max(0, (len(plain) - SAMPLE_BYTES) // 2)
                cut.append(plain[start:start + SAMPLE_BYTES] + b" ")
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("r"), pa.array(cut, pa.binary())],
                names=["lang", "r", "piece"])

    rows = ranked.select("lang", "r", "text").mapInArrow(
        batches, "lang string, r int, piece binary").collect()
    most = min(DICTIONARY, DICTIONARIES // max(1, len(languages)))
    parts: dict[str, list[bytes]] = {}
    for row in sorted(rows, key=lambda r: r.r):
        parts.setdefault(row.lang, []).append(bytes(row.piece))
    return [(r.lang, b"".join(parts.get(r.lang, []))[:most]) for r in languages]


def predictions(docs: DataFrame, dictionaries: list[tuple[str, bytes]], columns: list[str],
                names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`columns` of the documents, with language and score in `names`."""
    shipped = docs.sparkSession.sparkContext.broadcast(dictionaries)
    # The text travels under a name of its own beside whatever is carried.
    text = unused("text_to_identify", docs)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shipped.value)
        for batch in source:
            found = [model.predict(t.as_py()) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in columns],
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
            ], names=[*columns, *names])

    kept = docs.select(*[F.col(f"`{c}`") for c in columns])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema],
                        f"`{names[0]}` string", f"`{names[1]}` double"])
    texts = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias(text))
    return small_batches(texts).mapInArrow(batches, schema)


def learned_from(docs: DataFrame) -> DataFrame:
    """The labelled documents that are not held out."""
    return docs.where(bucket("doc_id", 4) != 2).select("text", "lang")


def identified(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told, with all their columns."""
    names = unused("lang_found", docs), unused("lang_margin", docs)
    found = predictions(docs, learn(learned_from(docs)), docs.columns, names)
    return found.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= NARROW)).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def op9_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predictions(docs, learn(learned_from(docs)), ["doc_id"])
    accepted = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= NARROW)
    return found.select(
        "doc_id", F.coalesce(bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "lang_pred", "score", accepted.alias("accepted"))
