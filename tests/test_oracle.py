"""Every registered query against its SQL on the smallest tables."""

import pytest

from gridprobe.catalog import QUERIES
from oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_sql(spark, con, sf, name):
    assert compare(spark, con, QUERIES[name], sf) is None
