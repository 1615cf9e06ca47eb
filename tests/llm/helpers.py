"""Documents for the tests: odd rows that every operator must take."""

from __future__ import annotations

import os

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TEXT = ("Of the thand onere in that shering was ender to the mast.\nThe erand of tion is "
        "heble and onto the ander whing. It was the thion of all endered things that are.")

ODD = [
    (1, TEXT, "en", "src0", 10), (2, None, None, None, None), (3, "", "", "", 0),
    (4, " \t\n\v\f\r ", "en", "src1", 6), (5, TEXT, "en", "src0", 10), (5, TEXT, "en", "src0", 10),
    (6, "word " * 30000, "en", "src0", 150000), (7, "x" * 70000, "de", None, 70000),
    (8, "Über \U0001f600 naïve \u0000 é 　   line", "de", "src2", 20),
    (9, "one", "fr", "src2", 3), (10, "one two", "fr", "src2", 7), (11, TEXT + " More.", "en", "src1", 9),
]


def odd(spark):
    """ODD with columns whose names operators might use for themselves."""
    return spark.createDataFrame(
        [(*r, "s", 1, "t", 0.5, 3) for r in ODD],
        SCHEMA + ", size string, key int, fp string, score double, words int")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def small(spark, folder: str = SMALL):
    return spark.read.parquet(os.path.join(folder, "documents.parquet"))
