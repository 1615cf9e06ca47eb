"""What steps leave behind, and how wide the rows are that scoring shuffles."""

import time

from pyspark.sql import functions as F

from rolewise.operators import scenarios as SN
from rolewise.operators import scoring as SC
from rolewise.session import CLEANUP_KEY, cut_lineage
from tests import hiring as H


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = blocks.getAllFiles()
    names = [files.apply(k).getName() for k in range(files.size())]
    return {n for n in names if n.startswith("shuffle_")}


def test_a_written_step_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    keyed = spark.range(5000).withColumn("k", F.col("id") % 97)
    step = cut_lineage(keyed.groupBy("k").agg(F.sum("id").alias("s")).join(keyed, "k"), "left")
    assert step.count() == 5000
    kept = spark.conf.get(CLEANUP_KEY, None)
    assert kept in (None, "false")
    # The step is read once more above, by a plan with a shuffle of its own for the count.
    for _ in range(100):
        left = {n for n in shuffle_files(spark) - before if n.endswith(".data")}
        if len(left) <= 1:
            break
        time.sleep(0.1)
    assert len(left) <= 1


def test_scores_shuffle_no_rows_of_skills(spark):
    rows = SC.criteria(H.tables(spark), ref_year=H.REF_YEAR).select("application_id", "skills", "admissibility")
    node = rows._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":  # with the profiles, the topmost one
        node = node.children().apply(0)
    columns = node.left().output()
    names = {columns.apply(k).name() for k in range(columns.size())}
    assert "job_names" in names and "job_skills" not in names


def test_ranks_under_scenarios_are_settled_before_they_are_joined(spark):
    rows = SC.criteria(H.tables(spark), ref_year=H.REF_YEAR)
    rescored = cut_lineage(SN.rescore(rows, {"x": {"skills": 1.0}, "y": {"location": 1.0}}, lambda c: c))
    found = SN.rerank_scenarios(rescored, "x")
    plan = found.select("application_id", "scenario", "rank_after")._jdf.queryExecution().optimizedPlan().toString()
    assert "scenario" in plan and not any("scenario" in line for line in plan.split("\n") if "Window [" in line)
    assert sorted((r["scenario"], r["offer_id"], r["rank_after"]) for r in found.collect()) == [
        (s, o, k) for s in ("x", "y") for o, n in ((10, 3), (20, 2)) for k in range(1, n + 1)]
