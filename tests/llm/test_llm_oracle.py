"""Queries against their SQL, over whole tables."""

import pytest
from compare import connect, difference

from riskweave.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert difference(spark, con, QUERIES[name], ORACLES[name], sf_dir) is None
