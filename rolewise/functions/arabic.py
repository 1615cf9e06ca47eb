"""Arabic text as column expressions: normal form, share, line order."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point ranges of the Arabic blocks.
BLOCKS = "\\u0600-\\u06FF\\u0750-\\u077F\\uFB50-\\uFDFF\\uFE70-\\uFEFF"
LETTERS = "\\u0620-\\u064A\\u0671-\\u06D3"
MARKS = "\\u064B-\\u065F\\u0670\\u06D6-\\u06ED"
# Spellings of the same letter, then the two digit sets.
SAME_LETTER = {
    "آ": "ا", "أ": "ا", "إ": "ا", "ٱ": "ا", "ة": "ه", "ى": "ي", "ؤ": "و", "ئ": "ي",
}
TATWEEL = "ـ"
FIRST_DIGITS = (0x0660, 0x06F0)
PRESENTATION = (0xFB50, 0xFEFF)


def _presentation_forms() -> dict[str, str]:
    """Presentation form -> base letters, from the Unicode data of Python."""
    import unicodedata

    forms = {}
    for code in range(PRESENTATION[0], PRESENTATION[1] + 1):
        char = chr(code)
        plain = unicodedata.normalize("NFKC", char)
        if plain != char and plain.strip():
            forms[char] = plain
    return forms


_FORMS = _presentation_forms()
_SINGLE = {form: plain for form, plain in _FORMS.items() if len(plain) == 1}
_LAM_ALEF = {f: p for f, p in _FORMS.items() if len(p) == 2 and 0xFEF5 <= ord(f) <= 0xFEFC}
_SOURCE = "".join(SAME_LETTER) + "".join(chr(first + i) for first in FIRST_DIGITS for i in range(10))
_TARGET = "".join(SAME_LETTER.values()) + "0123456789" * len(FIRST_DIGITS)
_SINGLE_TABLE, _SAME_TABLE = str.maketrans(_SINGLE), str.maketrans(_SOURCE, _TARGET, TATWEEL)
_ANY, _MARK = re.compile(f"[{BLOCKS}]"), re.compile(f"[{MARKS}]")


def contains_arabic(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"[{BLOCKS}]")


def normalise(text: Column) -> Column:
    """Comparable Arabic; any other text comes back unchanged.

    Presentation forms become base letters, marks and tatweel disappear,
    variant letters and digits are unified. `translate` drops source letters
    that have no target, which is how the tatweel goes.
    """
    plain = F.translate(text, "".join(_SINGLE), "".join(_SINGLE.values()))
    for ligature, letters in _LAM_ALEF.items():
        plain = F.replace(plain, F.lit(ligature), F.lit(letters))
    plain = F.regexp_replace(plain, f"[{MARKS}]", "")
    return F.when(contains_arabic(text), F.translate(plain, _SOURCE + TATWEEL, _TARGET)).otherwise(
        F.coalesce(text, F.lit(""))
    )


def normal_form(text: str) -> str:
    """`normalise` of one text, inside a task."""
    if not _ANY.search(text):
        return text
    plain = text.translate(_SINGLE_TABLE)
    for ligature, letters in _LAM_ALEF.items():
        plain = plain.replace(ligature, letters)
    return _MARK.sub("", plain).translate(_SAME_TABLE)


def arabic_share(text: Column) -> Column:
    """Arabic letters over all letters; 0 when there is no letter."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]", "")
    ours = F.regexp_replace(letters, f"[^{BLOCKS}]", "")
    return F.coalesce(
        F.try_divide(F.length(ours).cast("double"), F.length(letters).cast("double")), F.lit(0.0)
    )


def logical_order(text: Column) -> Column:
    """Reverse the lines that are Arabic throughout; mixed lines stay."""
    lines = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\r?\n"),
        lambda line: F.when(
            (F.trim(line) != "") & (arabic_share(line) >= 0.999), F.reverse(line)
        ).otherwise(line),
    )
    return F.array_join(lines, "\n")
