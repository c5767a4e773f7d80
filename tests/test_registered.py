"""Every registered query against its SQL, on the tables of ``TEXTWEAVE_SF_DIR``."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as registered
from compare import connect, difference

SF = os.environ.get("TEXTWEAVE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


def check_plan(df):
    """No product of two tables and no row-at-a-time Python anywhere in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in plan


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


# The queries of the optional subpackage have tests of their own in tests/llm.
OWN = set(getattr(getattr(registered, "corpus", None), "QUERIES", ()))


@pytest.mark.parametrize("name", sorted(set(registered.oracle_sql()) - OWN))
def test_equals_sql(spark, duck, name):
    df = registered.queries()[name](spark, SF)
    assert difference(df, duck, registered.oracle_sql()[name]) is None
    check_plan(df)


@pytest.mark.parametrize("name", sorted(set(registered.queries()) - set(registered.oracle_sql()) - OWN))
def test_gives_rows(spark, name):
    df = registered.queries()[name](spark, SF)
    # Every column of every row is computed: a count alone would prune them.
    df.write.format("noop").mode("overwrite").save()
    rows = df.limit(50).collect()
    assert rows and not all(value is None for row in rows for value in row)
    check_plan(df)


def test_entry(spark):
    assert registered.entry(spark).columns == ["Bigram", "Count", "tScore", "chiScore"]


def test_all_sql_belongs_to_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())
