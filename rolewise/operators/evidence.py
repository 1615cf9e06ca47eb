"""Anchoring of quotes in the document they were taken from.

A page meets the quotes of its document as arrays of at most about `CHUNK`
quotes, so its text is folded, read and sent once per array and not per quote.
The exact tiers are column expressions. A long quote that they leave open can
only match in part if one of its blocks stands on the page: a common substring of
`least` characters holds a whole block of ceil(least / 2) characters of the quote
cut into such blocks. Only pages that hold one go on, and of them only the parts
around such blocks go through the suffix automaton of the quotes left open.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolewise import fixed_values as V
from rolewise.functions.text import fold

#: White space of any script, as a character class that Java and RE2 both read.
SPACES = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Quotes of a document that meet its pages in one row, about.
CHUNK = 256


def normalised(text: Column) -> Column:
    """Folded text with single spaces, no leading space."""
    return F.ltrim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), SPACES + "+", " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACES}+|{SPACES}+$", "")


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.^$|?*+()\[\]{}\-])", r"\\$1")


def _blocks(needle: Column) -> Column:
    """The quote cut into blocks; any common substring that counts holds one of them whole."""
    width = F.ceil((F.ceil(F.length(needle) * V.EVIDENCE_MIN_RATIO)) / 2).cast("int")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(needle) - width + 1), width),
        lambda at: F.substr(needle, at, width))


def needles(quotes: DataFrame) -> DataFrame:
    """(document_id, chunk, quotes): usable quotes, normalised, dealt into arrays."""
    bare = stripped(F.col("quote"))
    usable = quotes.where(F.length(bare) >= V.EVIDENCE_MIN_LENGTH).select(
        "quote_id", "document_id", normalised(bare).alias("needle")).where("needle <> ''")
    sizes = usable.groupBy("document_id").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    long = F.length("needle") >= V.EVIDENCE_SHORT_LENGTH
    return usable.join(sizes, "document_id").groupBy(
        "document_id", F.pmod(F.xxhash64("quote_id"), F.col("chunks")).alias("chunk")
    ).agg(F.collect_list(F.struct(
        "quote_id", "needle", (~long).alias("short"),
        F.when(long, _blocks(F.col("needle"))).alias("blocks"))).alias("quotes"))


def page_matches(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, page, text, haystack, matches): per page the quotes that it may hold.

    A match has `at`, the place of a quote that stands there as asked, else 0.
    `quotes` has (quote_id, document_id, quote), `pages` (document_id, page, text).
    """
    # Exploding an array of one keeps the optimizer from repeating what is in it for every use.
    rows = needles(quotes).join(pages.select("document_id", "page", "text"), "document_id").select(
        "document_id", "page", "text", "quotes", F.explode(F.array(normalised(F.col("text")))).alias("haystack"))
    hay = F.col("haystack")

    def match(q: Column) -> Column:
        whole = F.concat(F.lit(r"(?U)(?<!\w)"), _escaped(q["needle"]), F.lit(r"(?!\w)"))
        at = F.when(q["short"], F.regexp_instr(hay, whole)).otherwise(F.instr(hay, q["needle"]))
        return F.struct(
            q["quote_id"].alias("quote_id"), q["needle"].alias("needle"), q["short"].alias("short"), at.alias("at"),
            F.exists(F.coalesce(q["blocks"], F.array().cast("array<string>")), lambda b: F.contains(hay, b)).alias("open"))

    found = F.filter(F.transform("quotes", match), lambda m: (m["at"] > 0) | m["open"])
    return rows.select(
        "document_id", "page", "text", "haystack", F.explode(F.array(found)).alias("matches")).where(F.size("matches") > 0)


def exact_tiers(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """(quote_id, document_id, page, ratio) of quotes that stand on a page as they are.

    A short quote must stand as whole words and is worth .75, a longer one 1.
    """
    rows = page_matches(quotes, pages).select("document_id", "page", F.explode("matches").alias("m")).where("m.at > 0")
    ratio = F.when(F.col("m.short"), F.lit(V.EVIDENCE_SHORT_RATIO)).otherwise(F.lit(1.0))
    return rows.select("m.quote_id", "document_id", "page", ratio.alias("ratio"))


class Automaton:
    """The substrings of several strings: states, edges and suffix links."""

    def __init__(self, strings: list[str]) -> None:
        self.edges: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for string in strings:
            at = 0
            for char in string:
                at = self._extend(at, char)
        self.falling = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)

    def _state(self, length: int, link: int, edges: dict[str, int]) -> int:
        self.edges.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _parted(self, at: int, char: str, onto: int) -> int:
        """The state for the strings of `onto` that are no longer than those behind `at`."""
        if self.length[onto] == self.length[at] + 1:
            return onto
        copy = self._state(self.length[at] + 1, self.link[onto], dict(self.edges[onto]))
        self.link[onto] = copy
        while at >= 0 and self.edges[at].get(char) == onto:
            self.edges[at][char] = copy
            at = self.link[at]
        return copy

    def _extend(self, at: int, char: str) -> int:
        if char in self.edges[at]:
            return self._parted(at, char, self.edges[at][char])
        made = self._state(self.length[at] + 1, 0, {})
        while at >= 0 and char not in self.edges[at]:
            self.edges[at][char] = made
            at = self.link[at]
        if at >= 0:
            self.link[made] = self._parted(at, char, self.edges[at][char])
        return made

    def reached(self, page: str, regions: list[tuple[int, int]] | None = None) -> tuple[list[int], list[int]]:
        """Per state the longest of its strings that stands in the regions of the page, and its first end.

        One step per character; then states hand what ended in them to the
        states of their suffixes, which stand there in full.
        """
        size, end = [0] * len(self.link), [0] * len(self.link)
        first = [len(page) + 1] * len(self.link)
        for start, stop in regions if regions is not None else [(0, len(page))]:
            at = length = 0
            for place, char in enumerate(page[start:stop], start + 1):
                while at and char not in self.edges[at]:
                    at = self.link[at]
                    length = self.length[at]
                if char not in self.edges[at]:
                    continue
                at, length = self.edges[at][char], length + 1
                if length > size[at]:
                    size[at], end[at] = length, place
                if place < first[at]:
                    first[at] = place
        for state in self.falling:
            up = self.link[state]
            if up > 0 and first[state] <= len(page):
                if first[state] < first[up]:
                    first[up] = first[state]
                if size[up] < self.length[up] or end[up] > first[state]:
                    size[up], end[up] = self.length[up], min(
                        first[state], end[up] if size[up] == self.length[up] else first[state])
        return size, end

    def longest(self, string: str, reached: tuple[list[int], list[int]]) -> tuple[int, int]:
        """(start on the page, size) of the longest common substring, the first of that size."""
        size, end = reached
        best, at = (0, 0), 0
        for char in string:
            at = state = self.edges[at][char]
            while state > 0 and not size[state]:
                state = self.link[state]
            if state > 0:
                best = max(best, (size[state], -end[state]))
        return (-best[1] - best[0], best[0]) if best[0] else (-1, 0)


def longest_common(page: str, strings: list[str], regions: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """(start on the page, size) for each string, in time linear in page and strings."""
    automaton = Automaton(strings)
    reached = automaton.reached(page, regions)
    return [automaton.longest(s, reached) for s in strings]


def least_size(needle: str) -> int:
    """Characters of the quote that must stand together on the page."""
    return math.ceil(V.EVIDENCE_MIN_RATIO * len(needle))


def regions(page: str, strings: list[str]) -> list[tuple[int, int]]:
    """The parts of the page around blocks of the quotes; all that is long enough lies in one."""
    found = []
    for string in strings:
        width = -(-least_size(string) // 2)
        for cut in range(0, len(string) - width + 1, width):
            block = string[cut:cut + width]
            at = page.find(block)
            while at >= 0:
                found.append((max(0, at - len(string)), at + width + len(string)))
                at = page.find(block, at + 1)
    merged: list[tuple[int, int]] = []
    for start, stop in sorted(found):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(stop, merged[-1][1]))
        else:
            merged.append((start, stop))
    return merged


_BLANKS = np.array([ord(c) for c in map(chr, range(0x3001)) if re.match(r"\s|\x85", c)], dtype=np.uint32)


def _origins(text: str) -> np.ndarray:
    """Place in the text of each normalised character: accents left out, white space once."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    places = np.flatnonzero((codes < 0x300) | (codes > 0x36F))
    blank = np.isin(codes[places], _BLANKS)
    after = np.concatenate([[True], blank[:-1]])[:len(blank)]
    return places[~(blank & after)]


def _spans(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Per page the (size, char_start, char_end) of each of its matches, size 0 for none."""
    for texts, haystacks, matches in batches:
        out = []
        for text, haystack, listed in zip(texts, haystacks, matches):
            open_ = [m["needle"] for m in listed if not m["at"]]
            partial = iter(longest_common(haystack, open_, regions(haystack, open_)) if open_ else ())
            origin, spans = _origins(text), []
            for m in listed:
                least = least_size(m["needle"])
                start, size = (m["at"] - 1, len(m["needle"])) if m["at"] else next(partial)
                if size < least or size == 0:
                    spans.append({"size": 0, "char_start": 0, "char_end": 0})
                    continue
                end = min(start + size, len(origin))
                spans.append({"size": size, "char_start": int(origin[start]), "char_end": int(origin[end - 1]) + 1})
            out.append(spans)
        yield pd.Series(out)


def anchor_quotes(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """Best page, offsets, ratio and verified flag per quote.

    The first page with the best ratio wins, and one of .999 or more wins over
    later ones. Quotes found nowhere keep a row with ratio 0.
    """
    spans = F.pandas_udf(_spans, "array<struct<size: int, char_start: int, char_end: int>>")
    rows = page_matches(quotes, pages).withColumn("spans", spans("text", "haystack", "matches"))
    each = rows.select("document_id", "page", "text", F.inline(F.arrays_zip("matches", "spans"))).where("spans.size > 0")
    ratio = F.when(F.col("matches.short"), F.lit(V.EVIDENCE_SHORT_RATIO)).otherwise(
        F.col("spans.size") / F.length("matches.needle"))
    placed = each.select(
        "matches.quote_id", "document_id", "page", ratio.alias("ratio"), "spans.char_start", "spans.char_end",
        F.expr("substring(text, spans.char_start + 1, spans.char_end - spans.char_start)").alias("text"))
    best = placed.groupBy("quote_id", "document_id").agg(F.max_by(
        F.struct("page", "ratio", "char_start", "char_end", "text"),
        F.struct(F.least("ratio", F.lit(0.999)), -F.col("page"))).alias("b")).select("quote_id", "document_id", "b.*")
    return quotes.select("quote_id", "document_id").join(best, ["quote_id", "document_id"], "left").select(
        "quote_id", "document_id", "page", F.coalesce(F.round("ratio", 3), F.lit(0.0)).alias("ratio"),
        "char_start", "char_end", "text",
        (F.coalesce("ratio", F.lit(0.0)) >= V.EVIDENCE_MIN_RATIO).alias("verified"))


def evidence_counts(spans: DataFrame) -> DataFrame:
    return spans.groupBy("document_id").agg(
        F.count_if("verified").alias("verified"), F.count("*").alias("total"))
