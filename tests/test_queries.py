"""Registered queries against their DuckDB statements, and the contract's functions."""

from __future__ import annotations

import os

import oracle
import pytest

from frameloom.plans.more_queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_registry_is_whole():
    assert len(QUERIES) > 100 and set(ORACLE_SQL) == set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_duckdb(spark, con, name):
    assert oracle.differences(QUERIES[name](spark, SF), con, ORACLE_SQL[name]) == ""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
