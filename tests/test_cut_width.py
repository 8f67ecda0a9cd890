"""The features of all cuts are wide rows: they go neither to their races nor to disk with the entries' own facts."""

from hindcast.operators import cuts as K
from hindcast.operators.splits import cut_dates
from hindcast.plans.catalog import history as C


def test_wide_rows_do_not_go_to_their_races(e, monkeypatch):
    seen = []
    monkeypatch.setattr(K, "pace", lambda df, plain=K.pace: seen.append(set(df.columns)) or plain(df))
    K.cut_features(e, K.history_cuts(cut_dates(e)[0], (2, None)))
    assert len(seen) == 2 and not any("best_finish_last5__2" in s or "odds" in s for s in seen)


def test_the_query_writes_every_feature_and_no_facts(spark, monkeypatch):
    from __spark_entry__ import queries
    from conftest import SF
    seen = []
    monkeypatch.setattr(C, "stored", lambda df: seen.append(set(df.columns)) or df)
    queries()["cut_features"](spark, SF)
    cols = seen[-1]
    assert {"race_id", "horse_number", "date", "race_leader_count__2", "corner_style_race_rank__all", "owner_prior_mounts__8"} <= cols
    assert not cols & {"odds", "sex", "tenths"}
