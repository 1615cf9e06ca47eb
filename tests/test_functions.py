import datetime as dt

import pytest
from pyspark.sql import functions as F

from rolewise import fixed_values as V
from rolewise.functions import arabic, dates, scores, text, vectors, weights
from rolewise.operators import ontology


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("name, expected", [
    ("DRF", "django rest framework"), ("  PostGres ", "postgresql"), ("Scikit_Learn", "scikit-learn"),
])
def test_canonical_skill(spark, name, expected):
    assert value(spark, ontology.canonical(F.lit(name), V.SKILL_ALIASES)) == expected


@pytest.mark.parametrize("left, right", [
    ("Badr Sahraoui", "SAHRAOUI Badr"), ("Sara El Amrani", "Sara Amrani"),
    ("José Ben-Ali", "jose ali"), ("أحمد بن", "احمد بن"),
])
def test_name_key(spark, left, right):
    assert value(spark, text.name_key(F.lit(left))) == value(spark, text.name_key(F.lit(right)))


def test_phone_key(spark):
    key = lambda p: value(spark, text.phone_key(F.lit(p)))
    assert key("+212 600 112 233") == key("0600112233") == "600112233"
    assert key("12345") == ""


@pytest.mark.parametrize("loose, expected", [
    ("2023-05", dt.date(2023, 5, 1)), ("05/2023", dt.date(2023, 5, 1)), ("2023", dt.date(2023, 1, 1)),
    ("juin 2021", dt.date(2021, 6, 1)), ("Août 2021", dt.date(2021, 8, 1)), ("2023-13", None),
    ("hier", None), ("", None), (None, None),
])
def test_parse_month(spark, loose, expected):
    assert value(spark, dates.parse_month(F.lit(loose).cast("string"), 2026)) == expected


@pytest.mark.parametrize("level, expected", [("4", 3), ("5", 5), ("7", 8), ("2", 1), ("x", 0), (None, 0)])
def test_nearest_education(spark, level, expected):
    assert value(spark, dates.nearest_education_level(F.lit(level).cast("string"))) == expected


@pytest.mark.parametrize("written, plain", [
    ("أحمد", "احمد"), ("آمنة", "امنه"), ("مصطفى", "مصطفي"), ("مـحـمد", "محمد"), ("٢٠٢٤ س", "2024 س"),
    ("ﻻ", "لا"), ("Casablanca", "Casablanca"),
])
def test_arabic_normal_form(spark, written, plain):
    assert value(spark, arabic.normalise(F.lit(written))) == plain


def test_arabic_share_and_order(spark):
    assert value(spark, arabic.arabic_share(F.lit("سا ab"))) == 0.5
    assert value(spark, arabic.arabic_share(F.lit("12"))) == 0.0
    assert value(spark, arabic.logical_order(F.lit("دمحأ\nabc"))) == "أحمد\nabc"


def test_tokens_keep_compounds_and_digits(spark):
    got = value(spark, text.tokens(F.lit("Bout-en-bout, ISO 27001 C++ des 3-D. Équipe")))
    assert got == ["bout-en-bout", "bout", "bout", "iso", "27001", "c++", "3-d", "equipe"]


def test_ligatures_and_places(spark):
    assert value(spark, text.expand_ligatures(F.lit("eﬃcace"))) == "efficace"
    assert value(spark, text.place_tokens(F.lit("Fès, Fès-Meknès (MA)"))) == ["fes", "meknes"]
    assert value(spark, text.same_place(F.lit("Grand Casablanca"), F.lit("casablanca")))


def test_score_curves(spark):
    half = value(spark, scores.experience_value(F.lit(2.0), F.lit(4)))
    assert 0.58 < half < 0.68
    assert value(spark, scores.education_value(F.lit(1), F.lit(3))) == pytest.approx(1 / 3)
    assert value(spark, scores.language_value(F.lit(2), F.lit(4))) == 0.5
    assert value(spark, scores.coverage(F.lit(4), F.lit(0.0))) == 0.85
    assert value(spark, scores.recency(F.lit(None).cast("int"), 2024)) == pytest.approx(0.9333333)
    assert value(spark, scores.admissibility(F.lit(0.0), F.lit(2))) == pytest.approx(0.2)
    assert value(spark, scores.admissibility(F.lit(0.5), F.lit(2))) == 1.0


@pytest.mark.parametrize("kappa, label", [
    (0.9, "almost perfect"), (0.7, "substantial"), (0.5, "moderate"), (0.3, "fair"), (0.1, "slight"),
    (-0.2, "none or worse than chance"),
])
def test_kappa_label(spark, kappa, label):
    assert value(spark, scores.kappa_label(F.lit(kappa))) == label


@pytest.mark.parametrize("raw", [
    {}, {n: 0.0 for n in V.CRITERIA}, {n: 1.0 for n in V.CRITERIA}, {"skills": 9.0, "location": -1.0},
    {"experience": 0.333},
])
def test_normalised_weights_sum_to_one(spark, raw):
    pairs = [F.lit(x) for item in raw.items() for x in item]
    column = F.create_map(*pairs) if pairs else F.expr("CAST(map() AS MAP<STRING, DOUBLE>)")
    got = value(spark, weights.normalise(column)).asDict()
    assert sum(got.values()) == pytest.approx(1.0, abs=1e-9)
    clamped = {n: min(max(raw.get(n, d), 0.0), 3.0) for n, d in V.DEFAULT_WEIGHTS.items()}
    total = sum(clamped.values())
    plain = {n: round(c / total, 4) for n, c in clamped.items()} if total else V.DEFAULT_WEIGHTS
    heaviest = max(plain, key=plain.get)
    for name in V.CRITERIA:
        if name != heaviest:
            assert got[name] == pytest.approx(plain[name])


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert value(spark, vectors.norm(a)) == 5.0
    assert value(spark, vectors.cosine(a, b)) == pytest.approx(0.96)
    assert value(spark, vectors.normalised(F.array(F.lit(0.0)))) == [0.0]
