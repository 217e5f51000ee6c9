"""Every query with check SQL, compared exactly with DuckDB."""

import pytest
from oracle import connect, differences

from zephyria.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == []


def test_every_check_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
