"""Queries against their SQL, and that every numbered query is registered."""

import pytest
from compare import check, duck

from __spark_entry__ import oracle_sql, queries
from hindcast.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_all_are_registered():
    own = [n for n in queries() if n.startswith("op") and n.split("_")[0][2:].isdigit()]
    assert sorted(int(n.split("_")[0][2:]) for n in own) == list(range(1, 14))
    assert "pipeline" in queries() and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    ok, msg = check(spark, con, SF, QUERIES[name], ORACLES[name])
    assert ok, msg
