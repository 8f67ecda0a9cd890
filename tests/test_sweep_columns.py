"""A sweep of histories writes the features that its models read, not all that a cut has."""

from hindcast.operators import learn as L


def test_sweep_writes_what_it_reads(e, monkeypatch):
    seen = []

    def written(df):
        seen.append(set(df.columns))
        raise StopIteration

    monkeypatch.setattr(L, "stored", written)
    try:
        L.sweep_history_at_once(e, ["venue", "odds", "avg_finish_last3"], (2, None))
    except StopIteration:
        pass
    assert {"avg_finish_last3__2", "avg_finish_last3__all", "venue", "odds", "horse_id", "date"} <= seen[0]
    assert not any(c.startswith(("avg_last3f", "best_finish", "trainer_")) for c in seen[0])
