"""Every query of the core against its SQL, and without SQL at least a run."""

import os

import pytest
from helpers import DATA, against_sql

from loomspark.plans.core import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        against_sql(spark, QUERIES[name], SQL[name])
    else:
        assert QUERIES[name](spark, DATA).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
