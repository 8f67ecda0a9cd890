"""The registered sweep fits every half-life with the operator's own settings."""

from hindcast import schema as S
from hindcast.operators import learn as L
from hindcast.plans.catalog.base import QUERIES
from conftest import SF


def test_sweep_is_whole(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "train", lambda df, features, half_life, params: seen.append((half_life, L._settings(params)[0])))
    monkeypatch.setattr(L, "calibrate", lambda models, held_out: models)
    monkeypatch.setattr(L, "predict", lambda models, df: df)
    monkeypatch.setattr(L, "evaluate", lambda test, p: spark.createDataFrame([(0.5,)], "win_logloss double"))
    names = [r.half_life_days for r in QUERIES["sweep"](spark, SF).collect()]
    assert names == ["365", "1095", "1825", "3650", "none"] and [h for h, _ in seen] == S.HALF_LIVES
    assert all((s["maxIter"], s["maxDepth"]) == (L.DEFAULTS["maxIter"], L.DEFAULTS["maxDepth"]) for _, s in seen)
