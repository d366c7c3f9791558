"""Every registered query runs on the smallest tables, with unique column names."""

import os

import pytest

import __spark_entry__ as entry

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, SMALL)
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
