"""A small hiring fixture as plain rows, so that tests can change one thing."""

from __future__ import annotations

import copy

from pyspark.sql import functions as F

from rolewise.functions import weights as WT
from rolewise.operators import ontology as O
from rolewise.operators.scoring import Tables

REF_YEAR = 2024
ROWS = {
    "applications": [("a1", 1, 10, "received"), ("a2", 2, 10, "technical"), ("a3", 3, 10, "rejected"),
                     ("a4", 1, 20, "received"), ("a5", 2, 20, "withdrawn")],
    "candidates": [(1, "Sara El Amrani", "Casablanca, Maroc", 4.0, 3),
                   (2, "Marc Dupont", "Lyon", 1.0, 5), (3, "Wei Chen", "Rabat", 0.0, 0)],
    "candidate_skills": [(1, "python", 4.0, 2024), (1, "docker", 1.0, 2018), (1, "mysql", 0.0, None),
                         (2, "django", 3.0, 2022), (2, "kubernetes", 1.0, 2024), (3, "excel", 9.0, 2020)],
    "candidate_languages": [(1, "Français", "C1"), (1, "Anglais", "A2"), (2, "francais", "NAT")],
    "certifications": [(1, "AWS Solutions Architect"), (2, "Scrum Master")],
    "offers": [(10, "Casablanca", "onsite", 3, 5, ["AWS", "Scrum"], "open", False, {}),
               (20, "Remote", "remote", 0, 0, [], "open", False, {"skills": 0.6})],
    "job_skills": [(10, "django", "required", 2.0, 3), (10, "postgresql", "required", 1.0, 2),
                   (10, "docker", "preferred", 1.0, 0), (20, "python", "required", 1.5, 2),
                   (20, "fastapi", "required", 1.0, 1)],
    "job_languages": [(10, "Français", "B2", True), (10, "English", "B1", False)],
}
SCHEMAS = {
    "applications": "application_id string, candidate_id long, offer_id long, stage string",
    "candidates": "candidate_id long, full_name string, location string, "
                  "total_experience_years double, highest_education int",
    "candidate_skills": "candidate_id long, name string, years double, last_used_year int",
    "candidate_languages": "candidate_id long, language string, level string",
    "certifications": "candidate_id long, name string",
    "offers": "offer_id long, location string, remote_policy string, experience_min_years int, "
              "education_level int, required_certifications array<string>, status string, "
              "blind_screening boolean, overrides map<string,double>",
    "job_skills": "offer_id long, name string, requirement string, weight double, min_years int",
    "job_languages": "offer_id long, language string, min_level string, is_required boolean",
}
_RELATED: dict = {}


def rows() -> dict:
    return copy.deepcopy(ROWS)


def tables(spark, data: dict | None = None) -> Tables:
    data = data or ROWS
    frames = {n: spark.createDataFrame(data[n], SCHEMAS[n]) for n in SCHEMAS}
    frames["offers"] = frames["offers"].withColumn("weights", WT.from_map(F.col("overrides")))
    if spark.sparkContext.applicationId not in _RELATED:
        from rolewise.session import cut_lineage

        _RELATED[spark.sparkContext.applicationId] = cut_lineage(
            O.build_relatedness(*O.default_tables(spark)))
    return Tables(**frames, relatedness=_RELATED[spark.sparkContext.applicationId])
