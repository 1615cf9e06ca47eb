"""The pairs that can be among a candidate's best against scoring every pair."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolewise.operators import finalists as FI
from rolewise.operators import redirect as RD
from rolewise.operators import scoring as SC
from tests import hiring as H

SKILLS = ("python", "docker", "mysql", "django", "kubernetes", "excel", "fastapi")


def many(spark, offers=60, people=12, seed=3):
    """Varied offers, some alike, some without skills, languages or anything; candidates with and without skills."""
    pick, data = random.Random(seed), H.rows()
    data["offers"], data["job_skills"], data["job_languages"] = [], [], []
    for o in range(offers):
        data["offers"].append((
            o, pick.choice(["Casablanca", "Lyon", "", None]), pick.choice(["onsite", "hybrid", "remote"]),
            pick.choice([0, 2, 5]), pick.choice([0, 3, 5]), pick.choice([[], ["AWS"], ["Scrum", " "]]),
            pick.choice(["open", "open", "closed"]), pick.random() < 0.3, pick.choice([{}, {"skills": 0.7}])))
        data["job_skills"] += [
            (o, s, pick.choice(["required", "preferred"]), pick.choice([1.0, 2.0]), pick.choice([0, 2, 4]))
            for s in pick.sample(SKILLS, pick.randint(0, 4))]
        data["job_languages"] += [(o, n, "B2", pick.random() < 0.5) for n in pick.sample(["Français", "English"], pick.randint(0, 2))]
    for c in range(4, people):
        data["candidates"].append((c, f"Name {c}", pick.choice(["Lyon", "Rabat", None]), pick.choice([0.0, 1.5, 6.0]), pick.choice([0, 3, 5])))
        data["candidate_skills"] += [(c, s, pick.choice([0.0, 1.0, 3.0]), pick.choice([None, 2020, 2024]))
                                     for s in pick.sample(SKILLS, pick.randint(0, 5))]
        data["candidate_languages"] += [(c, "English", pick.choice(["A2", "B2"]))]
    return H.tables(spark, data), data


def every_pair(spark, tables, data):
    rows = [(f"{c[0]}-{o[0]}", c[0], o[0], "received") for c in data["candidates"] for o in data["offers"] if o[6] == "open"]
    scored = SC.score_applications(
        tables.with_applications(spark.createDataFrame(rows, H.SCHEMAS["applications"])), ref_year=H.REF_YEAR)
    return {(r.candidate_id, r.offer_id): r.overall for r in scored.collect()}


@pytest.mark.parametrize("cell", [0.0, 0.05])
def test_the_best_offers_are_among_the_finalists(spark, cell):
    tables, data = many(spark)
    full = every_pair(spark, tables, data)
    level = (lambda s: np.floor(s / cell + 0.5)) if cell else (lambda s: s)
    offers = tables.offers.where("status = 'open'").select("offer_id")
    found = {tuple(r) for r in FI.finalists(
        tables, offers, tables.candidates.select("candidate_id"), 0.5, H.REF_YEAR, 3, cell,
        candidate_block=5, offer_block=16).collect()}
    best = set()
    for c in {c for c, _ in full}:
        own = sorted((-level(s), o) for (k, o), s in full.items() if k == c and s >= 0.5)
        best |= {(c, o) for _, o in own[:3]}
    assert best and best <= found
    if cell:  # pairs that are certain are as few as can be
        assert len(found) < len(full) / 4


def test_redirection_on_a_grid_scores_few_pairs(spark, monkeypatch):
    tables, data = many(spark)
    full, scored = every_pair(spark, tables, data), []
    engine = SC.score_applications
    monkeypatch.setattr(SC, "score_applications", lambda t, **k: scored.append(t.applications.count()) or engine(t, **k))
    rounded = lambda s: np.floor(s * 1e4 + 0.5) / 1e4
    current = spark.createDataFrame(
        [(f"x{c[0]}", c[0], 7, 0.0) for c in data["candidates"]],
        "application_id string, candidate_id long, offer_id long, score double")
    got = {(r.application_id, r["rank"]): (r.suggested, r.new_score) for r in RD.redirect(
        tables, current, 0.5, H.REF_YEAR, top=2, grid=lambda c: F.floor(c * 1e4 + 0.5) / 1e4, cell=1e-4).collect()}
    want = {}
    for c in data["candidates"]:
        best = sorted((-rounded(s), o) for (k, o), s in full.items() if k == c[0] and o != 7 and rounded(s) >= 0.5)[:2]
        want |= {(f"x{c[0]}", n): (o, pytest.approx(-s)) for n, (s, o) in enumerate(best, 1)}
    assert got == want
    assert scored[0] <= 4 * len(data["candidates"]) < len(full) / 4


def test_scores_at_the_edge_of_a_cell_stay(spark):
    edge, cell = 0.75 + 0.5e-4, 1e-4
    scores = np.array([[0.9], [edge], [0.9], [np.nan], [0.9], [0.2]])
    offer, _, _, sure = FI.best(scores, 2, 0.75, cell)
    assert dict(zip(offer.tolist(), sure.tolist())) == {0: True, 2: True, 3: False}
    offer, _, _, sure = FI.best(np.array([[edge], [0.75], [0.75 - 2e-4]]), 3, 0.75, cell)
    assert dict(zip(offer.tolist(), sure.tolist())) == {0: False, 1: True}
