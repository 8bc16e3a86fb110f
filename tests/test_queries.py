import pytest

import __spark_entry__ as entry
from millrace.plans import registry
from tests import oracle
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    oracle.compare(spark, con, entry.queries()[name], registry.oracle_sql()[name], SMALL)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_types_as_sql(spark, con, name):
    left, right = oracle.types(spark, con, entry.queries()[name], registry.oracle_sql()[name], SMALL)
    assert left == right


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
