"""Every query with a SQL twin gives the same rows on the smallest tables; the others run."""

import pytest
from compare import check, duck
from conftest import SF

from __spark_entry__ import entry, oracle_sql, queries

SLOW = {"sweep", "sweep_longshot", "sweep_history", "compare_history", "sweep_params", "walk_forward_fit", "permutation_importance"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 4 and "recovery_high" in df.columns


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    ok, msg = check(spark, con, SF, queries()[name], oracle_sql()[name])
    assert ok, msg


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - SLOW))
def test_runs(spark, name):
    assert queries()[name](spark, SF).count() > 0
