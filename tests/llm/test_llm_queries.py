"""Every query of the subpackage against its SQL, and without SQL its shape."""

import os

import pytest
from helpers import DATA, against_sql

from loomspark.llm.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        against_sql(spark, QUERIES[name], SQL[name])
    else:
        assert QUERIES[name](spark, DATA).count() > 0


def test_columns(spark):
    expected = {
        "p1_found": ["origin", "item_id"], "p2_found": ["codebase_id", "token"], "p3_found": ["first_id", "fact_id"], "p4_found": ["token", "mark"],
        "p6_found": ["query_id", "point_id"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "kind", "start_pos"],
    }
    for name, columns in expected.items():
        assert QUERIES[name](spark, DATA).columns == columns


def test_found_is_once_per_case(spark):
    for name in ("p9_found", "p10_found", "p1_found", "p3_found"):
        df = QUERIES[name](spark, DATA)
        assert df.count() == df.distinct().count()
