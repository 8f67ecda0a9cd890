"""Features under history cuts against recomputing them, and keyed permutations."""

import math

import pytest
from pyspark.sql import functions as F

from hindcast.operators import cuts as K
from hindcast.operators import history as H
from hindcast.operators import learn as L
from hindcast.operators import permute as P
from hindcast.operators.splits import cut_dates, split_by_date, truncate_history


def test_cuts_equal_recomputing(e):
    """Every feature of every cut, against the features of the rows that the cut leaves."""
    cuts = K.history_cuts(cut_dates(e)[0], (2, 4, None))
    wide = K.cut_features(e, cuts).cache()
    for k, years in (("2", 2), ("4", 4), ("all", None)):
        want = H.training_features(truncate_history(e, years))
        got = K.of_cut(wide, k, cuts[k])
        cols = [c for c in want.columns if c not in e.columns or c in ("race_id", "horse_number")]
        assert set(cols) <= set(got.columns) and set(got.columns) == set(want.columns)
        near = lambda v: round(v, 9) if isinstance(v, float) else v
        a, b = ({(r.race_id, r.horse_number): tuple(near(r[c]) for c in cols) for r in f.select(*cols).collect()} for f in (got, want))
        assert a == b and len(a) > 1000
    assert wide.filter(~F.col("avg_finish_last3__2").eqNullSafe(F.col("avg_finish_last3__all"))).count() > 0


def test_cuts_of_split_keys(e, hot):
    cuts = K.history_cuts(cut_dates(e)[0], (2, None))
    got = K.of_cut(K.cut_features(e, cuts), "2", cuts["2"])
    want = H.training_features(truncate_history(e, 2))
    cols = ["race_id", "horse_number", "jockey_change", "avg_finish_last5", "trainer_win_rate_last30", "bracket_distance_avg_finish"]
    key = lambda f: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in f.select(*cols).fillna(-1).collect())
    assert key(got) == key(want)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 50, 997, 1024])
def test_bijections(spark, n):
    rows = spark.range(n).select(F.col("id").alias("i"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("r"))
    got = rows.select("r", "i", P.permuted(F.col("i"), n, 3, F.col("r")).alias("to")).collect()
    by = {r: [x.to for x in got if x.r == r] for r in range(3)}
    assert all(sorted(v) == list(range(n)) for v in by.values())
    if n > 40:
        assert len({tuple(v) for v in by.values()}) == 3
        fixed = sum(x.i == x.to for x in got)
        assert fixed < 15  # three in the mean


def test_walks_end():
    assert P._walks(16) == 0 and all(P._grid(n)[0] * P._grid(n)[1] >= n and P._grid(n)[0] * P._grid(n)[1] - n < P._grid(n)[0] for n in range(1, 3000))


def test_repeats_keep_the_values(spark):
    df = spark.range(300).select((F.col("id") + 1).alias("i"), (F.col("id") % 17).alias("x"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("y"))
    out = P.shuffled_repeats(df, "i", 300, "y", 4, 9)
    want = sorted((r.y is None, r.y or 0) for r in df.collect())
    for k in range(4):
        rows = out.filter(F.col("repeat") == k).collect()
        assert sorted((r.y is None, r.y or 0) for r in rows) == want and sorted(r.i for r in rows) == list(range(1, 301))


def test_importance_in_one_pass(e):
    """A feature that decides is significant; each repeat's loss is that of predicting with the dealt column."""
    train, _, test = split_by_date(e)
    models = L.train(train, ["odds", "distance"], None, {"maxIter": 3, "maxDepth": 3})
    got = {(r.feature, r.model): r for r in L.permutation_importance(models, test, ["odds", "distance"], n_repeats=6, seed=1).collect()}
    assert len(got) == 4 and all(r.repeats == 6 for r in got.values())
    assert got["odds", "place"].significant and got["odds", "place"].mean_increase > 3 * abs(got["distance", "place"].mean_increase)
    rows = L.dense_index(test.withColumn("__all", F.lit(0)), ["__all"], ["race_id", "horse_number"], "__i")
    one = P.shuffled_repeats(rows, "__i", rows.count(), "odds", 1, 1000)
    loss = L.evaluate(one, L.predict(models, one)).first()
    for r in L.permutation_importance(models, test, ["odds"], n_repeats=1, seed=1).collect():
        assert math.isclose(r.mean_increase, loss[r.metric] - r.baseline, abs_tol=1e-9) and r.ci_lower == r.ci_upper
    with pytest.raises(ValueError, match="weather"):
        L.permutation_importance(models, test, ["weather"])
