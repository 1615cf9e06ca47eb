"""Entity resolution without pairs, and the merge of the groups found.

Two records match when they share an e-mail, a phone number, or a name and an
employer. Every such rule is equality of a key, so a block of n records is a
star around its smallest id: n - 1 links instead of n(n-1)/2 pairs, for a
block of any size, with the same connected components. The confidence of the
best pair follows from blocks of combined keys in the same way.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolewise import fixed_values as V
from rolewise.session import cut_lineage

SIGNALS = ("email", "phone", "name", "career")


def _rules(weights: dict[str, float], threshold: float) -> list[tuple[str, ...]]:
    """Signal sets heavy enough to match, that share at least one blocking key."""
    return [
        chosen
        for size in range(1, len(SIGNALS) + 1)
        for chosen in combinations(SIGNALS, size)
        if set(chosen) & {"email", "phone", "name"}
        and sum(weights[s] for s in chosen) >= threshold - 1e-12
    ]


def _key(signal: str) -> Column:
    column = F.col(signal)
    return F.when(F.trim(F.coalesce(column, F.lit(""))) != "", column)


def blocks(records: DataFrame, weights: dict[str, float] = V.LINK_WEIGHTS,
           threshold: float = V.LINK_THRESHOLD) -> DataFrame:
    """(record_id, rule, key) for each combination of signals a record carries.

    `records` has (record_id, email, phone, name, careers): the first three are
    keys already normalised, `careers` the employers as an array.
    """
    rules = []
    for chosen in _rules(weights, threshold):
        confidence = min(1.0, sum(weights[s] for s in chosen))
        parts = [_key(s) for s in chosen if s != "career"]
        base = F.array(*parts)
        complete = F.forall(base, lambda k: k.isNotNull())
        head = F.concat_ws("\u0001", *parts)
        if "career" in chosen:
            keys = F.transform(F.col("careers"), lambda c: F.concat_ws("\u0001", head, c))
        else:
            keys = F.array(head)
        rules.append(F.struct(
            F.lit("+".join(chosen)).alias("rule"), F.lit(confidence).alias("confidence"),
            F.when(complete, keys).otherwise(F.array().cast("array<string>")).alias("keys"),
        ))
    exploded = records.select("record_id", F.explode(F.array(*rules)).alias("r"))
    return exploded.select(
        "record_id", "r.rule", "r.confidence", F.explode("r.keys").alias("key")
    ).withColumn("key", F.sha2("key", 256))


def stars(block_rows: DataFrame) -> DataFrame:
    """Links from every record to the smallest id of its blocks of two or more."""
    hubs = block_rows.groupBy("rule", "key").agg(
        F.min("record_id").alias("hub_id"), F.max("record_id").alias("last")
    ).where("hub_id <> last").drop("last")
    return block_rows.join(hubs, ["rule", "key"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): alternating large-star and small-star rounds.

    Each half round is one minimum per node and one join, checkpointed; rounds
    stop when the links no longer change.
    """
    links = cut_lineage(edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut_lineage(large)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        links = cut_lineage(small)
        now = links.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before = now
    members = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def resolve_entities(records: DataFrame, weights: dict[str, float] = V.LINK_WEIGHTS,
                     threshold: float = V.LINK_THRESHOLD) -> DataFrame:
    """(record_id, group_id, confidence, reasons) for every matched record."""
    linked = cut_lineage(stars(blocks(records, weights, threshold)))
    members = connected_components(
        linked.select(F.col("record_id").alias("u"), F.col("hub_id").alias("v")))
    evidence = linked.join(
        members.withColumnRenamed("node", "record_id"), "record_id"
    ).groupBy("component").agg(
        F.max("confidence").alias("confidence"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(
            F.split("rule", r"\+"))))), ",").alias("reasons"),
    )
    return members.join(evidence, "component").select(
        F.col("node").alias("record_id"), F.col("component").alias("group_id"),
        "confidence", "reasons")


def group_statistics(resolved: DataFrame, certain: float = V.LINK_CERTAIN) -> DataFrame:
    groups = resolved.groupBy("group_id").agg(
        F.count("*").alias("size"), F.max("confidence").alias("confidence"))
    return groups.agg(
        F.count("*").alias("groups"), F.coalesce(F.sum("size"), F.lit(0)).alias("records"),
        F.count_if(F.col("confidence") >= certain).alias("certain"))


# --- Merge ---------------------------------------------------------------------------
def survivors(groups: DataFrame, records: DataFrame) -> DataFrame:
    """(record_id, primary_id, seq): the oldest record of a group survives.

    `records` has (record_id, created_at). `seq` orders the merge: the
    survivor first, then the others by age.
    """
    aged = groups.select("record_id", "group_id").join(records, "record_id")
    oldest = aged.groupBy("group_id").agg(
        F.min_by("record_id", F.struct("created_at", "record_id")).alias("primary_id"))
    age = F.struct(
        F.col("record_id") != F.col("primary_id"), F.col("created_at"), F.col("record_id"))
    return aged.join(oldest, "group_id").select("record_id", "primary_id", age.alias("seq"))


def merge_skills(skills: DataFrame, moved: DataFrame) -> DataFrame:
    """Longest practice and latest use per skill of the survivor."""
    return _to_primary(skills, moved).groupBy("primary_id", "name").agg(
        F.max("years").alias("years"), F.max("last_used_year").alias("last_used_year"))


def merge_languages(languages: DataFrame, moved: DataFrame) -> DataFrame:
    """First-seen level per language, the survivor's first."""
    key = F.lower(F.trim("language"))
    return _to_primary(languages, moved).groupBy("primary_id", key.alias("language_key")).agg(
        F.min_by(F.struct("language", "level"), F.struct("seq", "language", "level")).alias("kept")
    ).select("primary_id", "kept.language", "kept.level")


def merge_applications(applications: DataFrame, moved: DataFrame) -> DataFrame:
    """Furthest stage per offer; the earlier record wins a tie."""
    order = F.lit(-1)
    for stage, rank in V.STAGE_ORDER.items():
        order = F.when(F.col("stage") == stage, F.lit(rank)).otherwise(order)
    return _to_primary(applications, moved).withColumn("far", -order).groupBy(
        "primary_id", "offer_id"
    ).agg(F.min_by(F.struct("application_id", "stage"), F.struct("far", "seq")).alias("kept")).select(
        "primary_id", "offer_id", "kept.application_id", "kept.stage")


def merge_fields(candidates: DataFrame, moved: DataFrame, first: tuple[str, ...],
                 largest: tuple[str, ...]) -> DataFrame:
    """First non-empty value of text fields, largest value of the others."""
    rows = _to_primary(candidates, moved)
    picks = [
        F.min_by(c, F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.col("seq"))).alias(c)
        for c in first
    ]
    return rows.groupBy("primary_id").agg(*picks, *[F.max(c).alias(c) for c in largest])


def reparent(children: DataFrame, moved: DataFrame) -> DataFrame:
    """Child rows under the survivor; rows of unmerged records stay."""
    target = moved.select(F.col("record_id").alias("candidate_id"), "primary_id")
    return children.join(target, "candidate_id", "left").withColumn(
        "candidate_id", F.coalesce("primary_id", "candidate_id")).drop("primary_id")


def _to_primary(children: DataFrame, moved: DataFrame) -> DataFrame:
    target = moved.select(F.col("record_id").alias("candidate_id"), "primary_id", "seq")
    return children.join(target, "candidate_id")
