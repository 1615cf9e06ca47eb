"""Dates, years and levels read from loose text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolewise import fixed_values as V
from rolewise.functions.text import fold


def _month_number(name: Column) -> Column:
    pairs = [F.lit(part) for item in V.MONTH_NAMES.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), name)


def parse_month(text: Column, ref_year: int) -> Column:
    """First day of the month named by a loose date, or null.

    Accepts 2021-06, 06/2021, 06-2021, 06.2021, 2021, "juin 2021", "June 2021".
    """
    clean = F.lower(F.trim(text))
    year_first = r"^(\d{4})-(\d{1,2})"
    month_first = r"^(\d{1,2})[/\-.](\d{4})"
    named = r"^([a-z]+)\.?\s+(\d{4})"
    folded = fold(clean)
    year = (
        F.when(clean.rlike(year_first), F.regexp_extract(clean, year_first, 1))
        .when(clean.rlike(month_first), F.regexp_extract(clean, month_first, 2))
        .when(clean.rlike(r"^\d{4}$"), clean)
        .when(folded.rlike(named), F.regexp_extract(folded, named, 2))
    ).cast("int")
    month = (
        F.when(clean.rlike(year_first), F.regexp_extract(clean, year_first, 2).cast("int"))
        .when(clean.rlike(month_first), F.regexp_extract(clean, month_first, 1).cast("int"))
        .when(clean.rlike(r"^\d{4}$"), F.lit(1))
        .when(folded.rlike(named), _month_number(F.regexp_extract(folded, named, 1)))
    )
    valid = year.between(1900, ref_year + 1) & month.between(1, 12)
    return F.when(valid, F.make_date(year, month, F.lit(1)))


def valid_year(value: Column, ref_year: int) -> Column:
    year = value.try_cast("int")
    return F.when(year.between(1900, ref_year + 1), year)


def nearest_education_level(value: Column) -> Column:
    """Closest known level; the lower one on a tie, 0 for no number."""
    level = F.coalesce(value.try_cast("int"), F.lit(V.EDUCATION_LEVELS[0]))
    ranked = F.array(*[
        F.struct(F.abs(F.lit(known) - level).alias("far"), F.lit(known).alias("level"))
        for known in V.EDUCATION_LEVELS
    ])
    return F.array_min(ranked)["level"]


def clean_url(url: Column) -> Column:
    text = F.trim(F.coalesce(url, F.lit("")))
    with_scheme = F.when(text.rlike("^https?://"), text).otherwise(
        F.concat(F.lit("https://"), text)
    )
    return F.when(text == "", F.lit("")).otherwise(F.left(with_scheme, F.lit(200)))


def language_level(code: Column) -> Column:
    """Known CEFR code, or the default level."""
    upper = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    return F.when(upper.isin(*V.LANGUAGE_LEVELS), upper).otherwise(
        F.lit(V.DEFAULT_LANGUAGE_LEVEL)
    )
