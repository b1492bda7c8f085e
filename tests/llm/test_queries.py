"""Every corpus query runs over its whole tables and equals its SQL where it has one."""

from __future__ import annotations

import pytest
from helpers import connect, spark_rows, sql_rows

import corpus_pipeline
from tidemark.llm import catalog


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, folder, con, name):
    got = spark_rows(catalog.QUERIES[name](spark, folder))
    if name in catalog.SQL:
        assert got == sql_rows(con, catalog.SQL[name])
    else:
        assert got[1]


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "sharding"]
