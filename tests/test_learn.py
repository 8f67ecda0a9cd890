import pytest
from pyspark.sql import functions as F

from hindcast.operators import learn as L
from hindcast.operators.splits import split_by_date

FEATURES = ["venue", "distance", "odds", "popularity"]
SMALL = {"maxIter": 2, "maxDepth": 2}


@pytest.fixture(scope="module")
def fitted(e):
    train, val, test = split_by_date(e)
    raw = L.train(train, FEATURES, 1095.0, SMALL)
    return raw, L.calibrate(raw, val), test


def test_probabilities(fitted):
    raw, cal, test = fitted
    for m in (raw, cal):
        p = L.predict(m, test)
        assert p.count() == test.count()
        sums = p.groupBy("race_id").agg(F.sum("win_prob").alias("s"), F.min("predicted_rank").alias("r"))
        assert sums.filter("s IS NOT NULL AND (abs(s - 1) > 1e-9 OR r <> 1)").count() == 0


def test_versions(spark, fitted, tmp_path):
    raw, cal, test = fitted
    base = str(tmp_path / "models")
    L.save_models(cal, base, "20240101_000000")
    L.save_models(raw, base, "20240102_000000")
    back = L.load_latest(spark, base)  # the newest calibrated version is preferred
    assert back.win_cal is not None
    a = {(r.race_id, r.horse_number): r.place_prob for r in L.predict(cal, test).collect()}
    b = {(r.race_id, r.horse_number): r.place_prob for r in L.predict(back, test).collect()}
    assert a == b
    with pytest.raises(FileNotFoundError):
        L.load_latest(spark, str(tmp_path / "none"))


def test_isotonic_is_monotone_and_clipped(spark):
    df = spark.createDataFrame([(0.1, 0.0), (0.2, 0.0), (0.4, 1.0), (0.5, 0.0), (0.6, 1.0), (0.9, 1.0)], "s double, y double")
    cal = L.fit_calibrator(df, "s", "y")
    got = [r.s for r in cal.apply(spark.createDataFrame([(0.0,), (0.15,), (0.45,), (0.7,), (1.0,)], "s double"), "s").collect()]
    assert got == sorted(got) and got[0] == 0.0 and got[2] == 0.5 and got[-1] == 1.0
    with pytest.raises(ValueError):
        L.fit_calibrator(df, "s", "y", "other")


def test_shuffle_is_a_permutation(e):
    a = sorted(r.odds for r in e.select("odds").collect())
    moved = L.shuffled(e.select("race_id", "horse_number", "odds"), "odds", 3)
    b = sorted(r.odds for r in moved.collect())
    assert a == b and moved.join(e.select("race_id", "horse_number", F.col("odds").alias("o")), ["race_id", "horse_number"]).filter("odds <> o").count() > 3000


def test_importance(spark, fitted):
    r = L.importance_rank(fitted[0].win, spark, "win").collect()
    assert len(r) == len(FEATURES) and min(x["rank"] for x in r) == 1


def test_any_number_of_categories(spark):
    """Ten thousand values: the frequent ones are kept, the others, nulls and new values share a slot."""
    df = spark.range(20_000).select(F.concat(F.lit("v"), (F.col("id") % 10_000).cast("string")).alias("dam"), (F.col("id") % 7).cast("double").alias("x"),
                                    (F.col("id") % 3 == 0).cast("int").alias("is_win"))
    model = L.fit_win(df, ["dam", "x"], None, {"maxIter": 2, "maxDepth": 2})
    other = spark.createDataFrame([(None, 1.0, 0), ("new", 1.0, 1)], df.schema)
    assert L.raw_score(model, other, "p").filter("p BETWEEN 0 AND 1").count() == 2
    assert L.frequent_values(df.limit(0), ["dam"], 5) == [[]]
    with pytest.raises(ValueError, match="nope"):
        L.fit_win(df, ["nope"])
