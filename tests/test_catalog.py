"""Every query of the catalog against its SQL on whole tables; the corpus operators, of which some have no
SQL, are tested in ``tests/llm``."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from shelfmark.catalog.registry import ORACLES, QUERIES
from tests.compare import DATA, connect, differences

SF_DIR = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert entry.queries().items() >= QUERIES.items() and entry.oracle_sql().items() >= ORACLES.items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) == []


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 50
