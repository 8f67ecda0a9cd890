"""Queries that write the entries first write the columns that they read, not all of them."""

import pytest
from conftest import SF

from hindcast.plans.catalog import base, explore, history
from hindcast.plans.catalog.base import QUERIES


@pytest.mark.parametrize("name", ["training_features", "cut_features", "serve_latest_state", "serve_assemble", "feature_columns",
                                  "replace_children_buckets"])
def test_few_columns_are_written(spark, monkeypatch, name):
    def written(df):
        seen.append(set(df.columns))
        raise StopIteration

    seen = []
    for module in (base, explore, history):
        monkeypatch.setattr(module, "stored", written)
    with pytest.raises(StopIteration):
        QUERIES[name](spark, SF)
    assert {"race_id", "horse_number", "date"} <= seen[0]
    assert not seen[0] & {"tenths", "win_prob"}
