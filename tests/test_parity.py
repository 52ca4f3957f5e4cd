from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from parity.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="supplied tables are missing")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, connection, name):
    rows, problem = difference(queries()[name](spark, FOLDER), connection, oracle_sql()[name])
    assert problem is None


def test_entry(spark):
    assert entry(spark).count() % 96 == 0
