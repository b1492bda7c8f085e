"""Every registered query runs on the smallest data and equals its SQL."""

from __future__ import annotations

import pytest
from helpers import connect, spark_rows, sql_rows

import __spark_entry__ as entry
from tidemark.plans import catalog

QUERIES, SQL = catalog.load().QUERIES, catalog.load().SQL


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, con, name):
    got = spark_rows(QUERIES[name](spark, folder))
    if name in SQL:
        assert got == sql_rows(con, SQL[name])
    else:
        assert got[1]
