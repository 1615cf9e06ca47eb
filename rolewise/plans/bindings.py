"""The hiring tables derived from the supplied star schema.

Every view is a deterministic job over the given tables and grows with them.
Group sizes are reduced before anything is windowed: orders to one row per
(customer, day), purchases to one row per (customer, brand).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolewise import fixed_values as V
from rolewise.functions import weights as WT
from rolewise.operators import intervals, ontology
from rolewise.operators.scoring import Tables
from rolewise.session import cut_lineage

REF_YEAR = 2001
REF_DATE = "2002-01-01"
PERIOD_DAYS = 90
BRAND_ALIASES = {"brand 25": "brand#5", "brand#25": "brand#5", "brand nine": "brand#9"}
LANGUAGE_OF_REGION = ("Français", "English", "Mandarin", "Deutsch", "Arabe")
SPOKEN_IN_REGION = ("Francais", "english", "Mandarin", "DEUTSCH", "Arabe")
PART_TYPES = ("ECONOMY", "PROMO", "STANDARD", "LARGE", "SMALL", "MEDIUM")
STAGES = tuple(V.STAGE_ORDER)


_SCANS: dict[tuple[str, str], DataFrame] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of a supplied table; the footer is read once per application."""
    key = (spark.sparkContext.applicationId, f"{sf_dir.rstrip('/')}/{name}.parquet")
    if key not in _SCANS:
        _SCANS[key] = spark.read.parquet(key[1])
    return _SCANS[key]


def read_texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan for work that is heavy per row.

    A session over small tables in single files may ask for them to be spread
    by `rolewise.spread.partitions`; large tables arrive in enough splits.
    """
    frame = read(spark, sf_dir, name)
    spread = spark.conf.get("rolewise.spread.partitions", None)
    return frame.repartition(int(spread)) if spread else frame


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _mod(column: str, n: int):
    return F.pmod(F.col(column), F.lit(n)).cast("int")


def purchases(spark, sf_dir) -> DataFrame:
    """Order lines with their customer, supplier and date."""
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("candidate_id"),
        F.to_date("o_orderdate").alias("day"),
    )
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", F.col("l_suppkey").alias("offer_id"), "l_quantity"
    )
    return lines.join(orders, "l_orderkey")


def applications(spark, sf_dir) -> DataFrame:
    stage = F.pmod(F.col("candidate_id") * 7 + F.col("offer_id") * 3, F.lit(9))
    return (
        staged(spark, sf_dir, purchases)
        .groupBy("candidate_id", "offer_id")
        .agg(F.min("day").alias("applied_at"))
        .withColumn("application_id", F.concat_ws("-", "candidate_id", "offer_id"))
        .withColumn("stage", _pick(STAGES, stage))
    )


def experiences(spark, sf_dir) -> DataFrame:
    """One dated period per order; some left open, some with inverted dates."""
    start = F.to_date("o_orderdate")
    end = (
        F.when(F.col("o_orderkey") % 97 == 0, F.lit(None).cast("date"))
        .when(F.col("o_orderkey") % 50 == 0, F.date_sub(start, 10))
        .otherwise(F.date_add(start, PERIOD_DAYS))
    )
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("candidate_id"),
        F.col("o_orderkey").alias("experience_id"),
        F.substring("o_orderpriority", 3, 20).alias("title"),
        F.concat(F.lit("Employer "), (F.col("o_orderkey") % 1000).cast("string")).alias("company"),
        F.when(F.col("o_orderkey") % 61 != 0, start).alias("start_date"),
        end.alias("end_date"),
    )


def candidates(spark, sf_dir) -> DataFrame:
    customer = read(spark, sf_dir, "customer")
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    tenure = intervals.merged_tenure(experiences(spark, sf_dir), REF_DATE)
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("candidate_id")).agg(
        F.to_date(F.max("o_orderdate")).alias("last_day"),
        F.to_date(F.min("o_orderdate")).alias("first_day"),
    )
    level = F.lit(0)
    for segment, value in zip(
        ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), V.EDUCATION_LEVELS
    ):
        level = F.when(F.col("c_mktsegment") == segment, F.lit(value)).otherwise(level)
    return (
        customer
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("candidate_id"),
            F.col("c_name").alias("full_name"),
            F.concat_ws(", ", "n_name", "r_name").alias("location"),
            F.col("n_regionkey").alias("region_key"),
            level.alias("highest_education"),
            F.concat(F.lower("c_mktsegment"), F.lit(" specialist")).alias("headline"),
            F.concat(F.lit("c"), F.col("c_custkey").cast("string"),
                     F.lit("@example.org")).alias("email"),
        )
        .join(tenure, "candidate_id", "left")
        .join(orders, "candidate_id", "left")
        .withColumn("total_experience_years", F.coalesce("total_experience_years", F.lit(0.0)))
        .withColumn("created_at", F.coalesce("first_day", F.to_date(F.lit("1995-01-01"))))
        .withColumn(
            "retention_until",
            F.when(F.col("candidate_id") % 10 != 0, F.date_add("last_day", V.RETENTION_DAYS)),
        )
        .drop("first_day", "last_day")
    )


def candidate_skills(spark, sf_dir) -> DataFrame:
    part = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        ontology.canonical(F.col("p_brand"), BRAND_ALIASES).alias("name"),
    )
    return (
        staged(spark, sf_dir, purchases)
        .join(part, "l_partkey")
        .groupBy("candidate_id", "name", F.year("day").alias("year"))
        .agg(F.count("*").alias("uses"))
        .groupBy("candidate_id", "name")
        .agg(F.count("*").cast("double").alias("years"),
             F.max("year").alias("last_used_year"),
             F.sum("uses").alias("uses"))
    )


def candidate_languages(spark, sf_dir) -> DataFrame:
    customer = read(spark, sf_dir, "customer")
    nation = read(spark, sf_dir, "nation")
    base = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").alias("candidate_id"), F.col("n_regionkey").alias("region")
    )
    codes = tuple(V.LANGUAGE_LEVELS)
    spoken = F.array(
        F.struct(_pick(SPOKEN_IN_REGION, F.col("region")).alias("language"),
                 _pick(codes, _mod("candidate_id", 7)).alias("level")),
        F.struct(_pick(SPOKEN_IN_REGION, F.pmod(F.col("region") + 1 + F.col("candidate_id") % 2,
                                                F.lit(5))).alias("language"),
                 _pick(codes, _mod("candidate_id", 3)).alias("level")),
    )
    return base.select("candidate_id", F.explode(spoken).alias("s")).select(
        "candidate_id", "s.language", "s.level"
    )


def certifications(spark, sf_dir) -> DataFrame:
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return (
        staged(spark, sf_dir, purchases)
        .where("l_quantity >= 40")
        .join(part, "l_partkey")
        .groupBy("candidate_id", F.col("p_type").alias("name"))
        .agg(F.year(F.min("day")).alias("obtained_year"))
    )


def education(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("candidate_id"),
        F.concat(F.lit("Degree in "), F.lower("c_mktsegment")).alias("degree"),
        F.concat(F.lit("Institute "), F.col("c_nationkey").cast("string")).alias("institution"),
        (F.lit(1994) + F.col("c_custkey") % 10).cast("int").alias("graduation_year"),
    )


def offers(spark, sf_dir) -> DataFrame:
    supplier = read(spark, sf_dir, "supplier")
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    overrides = F.when(
        F.col("s_suppkey") % 10 == 1,
        F.create_map(F.lit("skills"), F.lit(0.60), F.lit("location"), F.lit(0.05)),
    ).otherwise(F.expr("CAST(map() AS MAP<STRING, DOUBLE>)"))
    asked = F.slice(
        F.array(*[F.lit(t) for t in PART_TYPES]), _mod("s_suppkey", 6) + 1, _mod("s_suppkey", 3)
    )
    return (
        supplier
        .join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("offer_id"),
            F.concat(F.lit("Role "), F.col("s_name")).alias("title"),
            F.concat_ws(" - ", "n_name", "r_name").alias("location"),
            F.col("n_regionkey").alias("region_key"),
            _pick(("onsite", "hybrid", "remote"), _mod("s_suppkey", 3)).alias("remote_policy"),
            _mod("s_suppkey", 6).alias("experience_min_years"),
            _pick(V.EDUCATION_LEVELS, _mod("s_suppkey", 5)).alias("education_level"),
            asked.alias("required_certifications"),
            F.when(F.col("s_acctbal") > 0, "open").otherwise("closed").alias("status"),
            (F.col("s_suppkey") % 4 == 0).alias("blind_screening"),
            WT.from_map(overrides).alias("weights"),
        )
    )


def job_skills(spark, sf_dir) -> DataFrame:
    """Top five brands per supplier by quantity."""
    part = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        ontology.canonical(F.col("p_brand"), BRAND_ALIASES).alias("name"),
    )
    totals = (
        read(spark, sf_dir, "lineitem")
        .select("l_partkey", F.col("l_suppkey").alias("offer_id"), "l_quantity")
        .join(part, "l_partkey")
        .groupBy("offer_id", "name")
        .agg(F.sum("l_quantity").alias("quantity"))
    )
    rank = F.row_number().over(W.partitionBy("offer_id").orderBy(F.desc("quantity"), "name"))
    return (
        totals.withColumn("pos", rank)
        .where("pos <= 5")
        .select(
            "offer_id", "name",
            F.when(F.col("pos") <= 3, "required").otherwise("preferred").alias("requirement"),
            _pick((2.0, 1.5, 1.2, 1.0, 1.0), F.col("pos") - 1).alias("weight"),
            (F.lit(5) - F.col("pos")).cast("int").alias("min_years"),
        )
    )


def job_languages(spark, sf_dir) -> DataFrame:
    """The regional language for most offers, a second optional one for some."""
    supplier, nation = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    base = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("s_suppkey").alias("offer_id"), F.col("n_regionkey").alias("region")
    )
    codes = tuple(V.LANGUAGE_LEVELS)
    first = F.struct(
        _pick(LANGUAGE_OF_REGION, F.col("region")).alias("language"),
        _pick(codes, _mod("offer_id", 6)).alias("min_level"), F.lit(True).alias("is_required"),
    )
    second = F.struct(
        _pick(LANGUAGE_OF_REGION, F.pmod(F.col("region") + 1, F.lit(5))).alias("language"),
        _pick(codes, _mod("offer_id", 4)).alias("min_level"), F.lit(False).alias("is_required"),
    )
    asked = F.when(F.col("offer_id") % 3 == 0, F.array(first, second)).otherwise(F.array(first))
    return (
        base.where("offer_id % 5 <> 0")
        .select("offer_id", F.explode(asked).alias("a"))
        .select("offer_id", "a.language", "a.min_level", "a.is_required")
    )


def brand_ontology(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Brand 2n implies brand n; an odd brand is related to the next odd one."""
    brands = (
        read(spark, sf_dir, "part")
        .select(ontology.canonical(F.col("p_brand"), BRAND_ALIASES).alias("skill"))
        .distinct()
        .withColumn("n", F.regexp_extract("skill", r"(\d+)", 1).cast("int"))
    )
    implies = brands.where("n > 0 AND n % 2 = 0").select(
        "skill", F.concat(F.lit("brand#"), (F.col("n") / 2).cast("int").cast("string")).alias("implied")
    )
    related = brands.where("n % 2 = 1").select(
        F.col("skill").alias("a"),
        F.concat(F.lit("brand#"), (F.col("n") + 2).cast("string")).alias("b"),
        F.lit(0.6).alias("degree"),
    )
    return implies, related


def relatedness(spark, sf_dir) -> DataFrame:
    return ontology.build_relatedness(*brand_ontology(spark, sf_dir))


_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def staged(spark: SparkSession, sf_dir: str, view) -> DataFrame:
    """A derived hiring table, written once per application and then scanned.

    A deployment stores these tables; here they are derived, so the first
    query that needs one writes it to the shared folder.
    """
    key = (spark.sparkContext.applicationId, sf_dir, view.__name__)
    if key not in _STAGED:
        _STAGED[key] = cut_lineage(view(spark, sf_dir), view.__name__)
    return _STAGED[key]


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    make = {
        "applications": applications, "candidates": candidates,
        "candidate_skills": candidate_skills, "candidate_languages": candidate_languages,
        "certifications": certifications, "offers": offers, "job_skills": job_skills,
        "job_languages": job_languages, "relatedness": relatedness,
    }
    return Tables(**{name: staged(spark, sf_dir, view) for name, view in make.items()})


def audited(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables with graduation year and institution beside each candidate."""
    found = tables(spark, sf_dir)
    schooling = education(spark, sf_dir).select("candidate_id", "graduation_year", "institution")
    return replace(found, candidates=found.candidates.join(schooling, "candidate_id", "left"))


# --- Event tables -------------------------------------------------------------
def _event_key():
    return F.get_json_object("props", "$.k").cast("bigint")


def decisions(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("actor"), _event_key().alias("object_id"),
        F.when(F.col("event_type") == "error", "rejected")
        .when(F.col("event_type") == "signup", "withdrawn")
        .otherwise(F.col("event_type")).alias("stage"),
        F.col("ts").alias("created_at"),
    )


def score_history(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("score_id"), _event_key().alias("application_id"),
        (F.col("value") / 491).alias("overall"),
        F.when(F.col("event_type") == "purchase", F.lit(0.9)).alias("overridden_score"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("1."), (F.col("user_id") % 3).cast("string"), F.lit(".0"))
        .alias("engine_version"),
        (F.col("user_id") % 2 == 0).alias("semantic_used"),
    )


def invocations(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("purpose-"), (_event_key() % 7).cast("string")).alias("purpose"),
        F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        (_event_key() * 10).alias("prompt_tokens"),
        F.floor("value").alias("completion_tokens"),
        F.col("ts").alias("created_at"),
    )


# --- Evaluation tables ----------------------------------------------------------
def judgments(spark, sf_dir) -> DataFrame:
    """Graded items per case with a predicted score on a 1e-4 grid."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return (
        read(spark, sf_dir, "labels").join(documents, "doc_id")
        .select(
            F.col("source").alias("case_id"), F.col("doc_id").alias("item_id"),
            (F.floor(10000 * F.col("n_chars") / (F.col("n_chars") + 1500)) / 10000).alias("score"),
            (2 * F.col("quality") + (1 - F.col("toxic"))).alias("relevance"),
        )
    )


def linkage_records(spark, sf_dir) -> DataFrame:
    """Documents as records: keys found in the whole text, career = source."""
    text = F.col("text")
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("record_id"),
        F.regexp_extract(text, V.EMAIL_PATTERN, 0).alias("email"),
        F.regexp_extract(text, r"\+\d[\d ().-]{7,15}\d", 0).alias("phone"),
        F.sha2(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 256).alias("name_key"),
        F.col("source").alias("company"),
        F.col("doc_id").alias("created_seq"),
    )

