"""Every registered query against its SQL counterpart."""

import pytest

import __spark_entry__ as entry
from compare import differences, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, connection, name):
    assert differences(spark, connection, entry.queries()[name], entry.oracle_sql()[name], SF_DIR) == ""


def test_every_query_is_callable():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["lang", "rank", "term", "score"]
