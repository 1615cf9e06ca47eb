"""Registered queries against their SQL twins on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"
SLOW = {"bias_mitigation", "greedy_path", "single_lever_gains"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["offer_id", "candidate_id", "overall", "rank", "gaps"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW))
def test_query_equals_sql(spark, con, name):
    line = compare(spark, con, name, FOLDER)
    assert line.startswith(("ok", "rows")), line


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
