"""The entry point: names match, and the flagship query runs."""

import os

import pytest

import __spark_entry__ as entry


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "abc_class" in df.columns
