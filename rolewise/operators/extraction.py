"""Rule-based profiles from plain text, document quality, extraction metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolewise import fixed_values as V
from rolewise.functions.text import digits, loose_text, same_text
from rolewise.operators.metrics import set_pairs, set_prf


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, r"[\n.;]+"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: F.length(p) >= 12)


def _quote(parts: Column, word: Column) -> Column:
    """First sentence with the word, else the first sentence; at most 110 characters."""
    hits = F.filter(parts, lambda p: F.contains(F.lower(p), F.lower(word)))
    return F.left(F.coalesce(
        F.try_element_at(hits, F.lit(1)), F.try_element_at(parts, F.lit(1)), F.lit("")),
        F.lit(110))


def extract_profiles(documents: DataFrame, skills: tuple[str, ...] = V.SKILL_LEXICON,
                     languages: dict[str, str] = V.LANGUAGE_LEXICON) -> DataFrame:
    """One profile per document: contacts, years, lexicon skills and languages.

    Everything is an expression over the whole text of (document_id, text).
    """
    text = F.col("text")
    base = documents.select(
        "document_id", "text", F.lower(text).alias("low"), sentences(text).alias("parts"))
    years = F.array_sort(F.array_distinct(F.transform(
        F.regexp_extract_all(text, F.lit(V.YEAR_PATTERN), 1), lambda y: y.cast("int"))))
    names = F.slice(F.filter(
        F.array(*[F.lit(s) for s in skills]), lambda s: F.contains(F.col("low"), F.lower(s))), 1, 12)
    pairs = F.array(*[
        F.struct(F.lit(t).alias("token"), F.lit(n).alias("label")) for t, n in languages.items()])
    spoken = F.array_sort(F.array_distinct(F.transform(
        F.filter(pairs, lambda p: F.contains(F.col("low"), p["token"])), lambda p: p["label"])))
    found = base.select(
        "document_id", "parts",
        F.regexp_extract("text", V.EMAIL_PATTERN, 0).alias("email"),
        F.trim(F.regexp_extract("text", V.PHONE_PATTERN, 0)).alias("phone"),
        F.regexp_extract("text", V.LINKEDIN_PATTERN, 0).alias("linkedin"),
        F.regexp_extract("text", V.GITHUB_PATTERN, 0).alias("github"),
        F.left(F.coalesce(F.try_element_at("parts", F.lit(2)), F.lit("")), F.lit(120))
        .alias("headline"),
        years.alias("years"), names.alias("skill_names"), spoken.alias("language_names"),
    )
    quoted = lambda names: F.transform(names, lambda n: F.struct(
        n.alias("name"), _quote(F.col("parts"), n).alias("evidence")))
    month = lambda y: F.concat(y.cast("string"), F.lit("-01"))
    return found.select(
        "document_id", "email", "phone", "linkedin", "github", "headline", "years",
        F.when(F.size("years") > 0, month(F.element_at("years", 1))).alias("start_date"),
        F.when(F.size("years") > 1, month(F.element_at("years", -1))).alias("end_date"),
        F.try_element_at("years", F.lit(-1)).alias("last_year"),
        quoted(F.col("skill_names")).alias("skills"),
        quoted(F.col("language_names")).alias("languages"),
    )


def document_quality(pages: DataFrame, multi_column: DataFrame | None = None,
                     scanned_below: int = V.SCANNED_BELOW_CHARS) -> DataFrame:
    """Characters per page, scan suspicion and the reading route per document.

    `pages` has (document_id, page, text, source); `multi_column` lists
    (document_id, page) found to have a column gutter.
    """
    counted = pages.groupBy("document_id").agg(
        F.sum(F.length("text")).alias("char_count"), F.count("*").alias("page_count"),
        F.max("source").alias("source"))
    if multi_column is not None:
        wide = multi_column.groupBy("document_id").agg(
            F.count("*").alias("multi_column_pages"))
        counted = counted.join(wide, "document_id", "left").na.fill(0, ["multi_column_pages"])
    else:
        counted = counted.withColumn("multi_column_pages", F.lit(0).cast("long"))
    per_page = F.col("char_count") / F.greatest(F.lit(1), F.col("page_count"))
    flagged = counted.withColumns({
        "chars_per_page": per_page, "looks_scanned": per_page < scanned_below,
        "has_text_layer": F.col("char_count") > 0,
    })
    vision = (F.col("looks_scanned") | (F.col("multi_column_pages") > 0)) & (
        F.col("source") == "pdf")
    return flagged.withColumns({
        "needs_vision": F.col("looks_scanned") | (F.col("multi_column_pages") > 0),
        "verifiable": F.col("has_text_layer"),
        "route": F.when(vision & F.col("has_text_layer"), "hybrid").when(vision, "vision")
        .when(F.col("has_text_layer"), "text"),
    })


def column_gutters(words: DataFrame) -> DataFrame:
    """Pages with an empty interior band between two blocks of words.

    `words` has (document_id, page, x0, x1, width). Words become counts per
    bin before anything is windowed, so a page is at most 50 rows.
    """
    bins = V.GUTTER_BINS
    edge = lambda x: F.least(F.lit(bins - 1), F.greatest(
        F.lit(0), F.floor(F.col(x) / F.col("width") * bins))).cast("int")
    page = ["document_id", "page"]
    wide = words.where("width > 0")
    totals = wide.groupBy(*page).agg(F.count("*").alias("words")).where(
        F.col("words") >= V.GUTTER_MIN_WORDS)
    occupied = wide.select(*page, F.explode(F.sequence(edge("x0"), edge("x1"))).alias("bin")).groupBy(
        *page, "bin").agg(F.count("*").alias("n"))
    order = W.partitionBy(*page).orderBy("bin")
    left = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1))
    right = F.sum("n").over(order.rowsBetween(0, W.unboundedFollowing))
    gap = F.col("bin") - F.lag("bin").over(order) - 1
    runs = occupied.withColumns({"gap": gap, "left": left, "right": right}).join(totals, page)
    enough = F.col("words") * V.GUTTER_MIN_SHARE
    return runs.where(
        (F.col("gap") >= V.GUTTER_MIN_BINS) & (F.col("left") >= enough) & (F.col("right") >= enough)
    ).select(*page).distinct()


# --- Extraction metrics ------------------------------------------------------------------
def identity_accuracy(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of the five identity fields that agree, per case."""
    f = found.select("case_id", *[F.col(c).alias(f"f_{c}") for c in IDENTITY])
    both = expected.select("case_id", *IDENTITY).join(f, "case_id")
    checks = [
        same_text(F.col("f_full_name"), F.col("full_name")),
        F.lower("f_email") == F.lower("email"),
        digits(F.col("f_phone")) == digits(F.col("phone")),
        same_text(F.col("f_location"), F.col("location")),
        loose_text(F.col("f_headline"), F.col("headline")),
    ]
    total = sum((F.coalesce(c, F.lit(False)).cast("int") for c in checks), F.lit(0))
    return both.select("case_id", (total / len(checks)).alias("identity_accuracy"))


IDENTITY = ("full_name", "email", "phone", "location", "headline")


def compare_sets(found: DataFrame, expected: DataFrame, keys: list[str], item: str) -> DataFrame:
    return set_prf(set_pairs(found, expected, keys, item), keys)


def missed_and_invented(found: DataFrame, expected: DataFrame, keys: list[str], item: str
                        ) -> DataFrame:
    """Expected but not found, and found but not expected."""
    pairs = set_pairs(found, expected, keys, item)
    return pairs.where("is_predicted <> is_expected").select(
        *keys, item, F.when(F.col("is_expected"), "missed").otherwise("invented").alias("outcome"))


def extraction_aggregate(cases: DataFrame) -> DataFrame:
    """Means over cases; evidence only where a text layer exists to anchor it."""
    ratio = F.coalesce(F.try_divide("anchored", "spans"), F.lit(0.0))
    return cases.agg(
        F.avg("identity_accuracy").alias("identity_accuracy"),
        F.avg("skills_f1").alias("skills_f1"), F.avg("languages_f1").alias("languages_f1"),
        F.avg(F.when(F.col("verifiable"), ratio)).alias("evidence_anchored"),
        F.avg(F.abs(F.col("years_found") - F.col("years_expected"))).alias("experience_years_mae"),
        F.count_if(~F.col("verifiable")).alias("cases_unverifiable"),
    )
