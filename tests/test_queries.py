"""Every registered query against its SQL on the smallest tables (``tests/compare.py`` does sf0.01)."""

import pytest
from compare import connect, difference

from shotweave.workloads import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
# Queries whose thresholds leave no row of the smallest tables.
MAY_BE_EMPTY = {"bipartite_core"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER), con, SQL[name]) in ((None, "empty") if name in MAY_BE_EMPTY else (None,))


def test_entry(spark):
    import __spark_entry__ as driver

    rows = driver.entry(spark)
    assert rows.columns == ["query_id", "task", "shot", "instruction", "input", "output"]
    assert rows.count() > 0
