"""Every registered query against its SQL, on the smallest data folder."""

from __future__ import annotations

from pathlib import Path

import pytest
from compare import connect, difference

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, connection, name):
    found = queries()[name](spark, SF_DIR).toPandas()
    oracle = oracle_sql().get(name)
    if oracle is not None:
        assert difference(found, connection.sql(oracle).df()) is None


def test_entry(spark):
    assert entry(spark).count() == 397 + 59 + entry(spark).where("split = 'test'").count()
