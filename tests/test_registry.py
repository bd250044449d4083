import pytest

import __spark_entry__
from rosterflow import registry
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_against_sql(spark, sf, db, name):
    assert differences(registry.QUERIES[name](spark, sf), db, registry.ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).first().person_count > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
