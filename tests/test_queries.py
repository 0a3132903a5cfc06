"""Each registered snapshot query against its SQL."""

import pytest

from snapsync import queries as Q
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, same_rows, name):
    same_rows(Q.QUERIES[name](spark, SF), Q.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_query_gives_rows(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0
