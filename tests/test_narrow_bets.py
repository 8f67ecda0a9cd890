"""The bets of a report are looked up without the windows of the entries in the same task."""

from test_large_races import entry_tables

from hindcast.plans.catalog import QUERIES


def test_the_entries_of_ev_bet_grid_are_written_once(spark, tmp_path):
    path = entry_tables(spark, tmp_path, [4, 7, 1, 2, 9])
    plan = QUERIES["ev_bet_grid"](spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan
