"""Every registered query agrees with its SQL on the smallest sample."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import check, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no sample tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_agrees_with_sql(spark, con, name):
    ok, text = check(spark, con, FOLDER, name)
    assert ok, text


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["dimension", "key", "n"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
