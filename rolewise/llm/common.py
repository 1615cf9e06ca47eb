"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Texts above this many bytes are cut into words piece by piece.
PIECE = 1 << 22

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % modulus


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """Consecutive parts of a text, cut only where white space stands.

    Keeps the working set of a very long text bounded; a single word longer
    than `size` stays whole.
    """
    if len(data) <= size:
        yield data
        return
    start = 0
    while start < len(data):
        end = start + size
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[start:end]
        start = end


def word_lists(data: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded length, in order."""
    for part in pieces(data, size):
        yield part.split()


#: Rows and bytes of a batch of texts that goes to Python, at most.
BATCH_ROWS = 1_000
BATCH_BYTES = 8 << 20


def small_batches(rows: DataFrame) -> DataFrame:
    """The rows, in a session whose batches to Python are small.

    Texts are long, and both sides of the pipe hold a batch several times over.
    """
    conf = rows.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows


def slices(source: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what a task builds from one stays small."""
    for batch in source:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
