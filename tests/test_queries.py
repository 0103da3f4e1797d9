"""Each registered query gives the rows of its SQL."""

import pytest
from oracle import DATA, connect, differences

from tidewright import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


def test_each_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    rows, ours, theirs = differences(QUERIES[name](spark, DATA), connect(), SQL[name])
    assert (ours, theirs) == ([], [])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(plans.queries()) <= set(e.queries())
