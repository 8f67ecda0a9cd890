"""The ranking objective against plain Python, and against the classifier on held-out races."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hindcast.operators import learn as L
from hindcast.operators import ranking as R
from hindcast.operators.evaluate import evaluate
from hindcast.operators.splits import split_by_date

FEATURES = ["venue", "distance", "odds", "popularity"]


def plain(race):
    """[(number, gradient, curvature)] of [(number, gain, score)]."""
    order = sorted(race, key=lambda r: (-r[2], r[0]))
    d = {r[0]: 1 / math.log2(i + 2) for i, r in enumerate(order)}
    best = sum(g / math.log2(i + 2) for i, g in enumerate(sorted((r[1] for r in race), reverse=True)))
    out = []
    for no, g, s in race:
        grad = curve = 0.0
        for no2, g2, s2 in race:
            if g != g2:
                change = abs((g - g2) * (d[no] - d[no2])) / best
                up = 1 if g > g2 else -1
                rho = 1 / (1 + math.exp(up * (s - s2)))
                grad, curve = grad + up * rho * change, curve + rho * (1 - rho) * change
        out.append((no, grad, curve))
    return out


def test_gradients(spark):
    rng = random.Random(2)
    races = {k: [(i + 1, rng.randint(0, 4), rng.choice([0.0, 0.5, rng.random()])) for i in range(rng.randint(1, 18))] for k in range(60)}
    races |= {100: [(1, 0, 0.1)], 101: [(1, 2, 0.1), (2, 2, 0.3)], 102: [(1, 0, 1.0), (2, 0, 2.0)]}
    rows = [(k, *r) for k, race in races.items() for r in race] + [(103, 1, None, 0.5), (None, 1, 3, 0.5)]
    df = spark.createDataFrame(rows, "race_id long, horse_number int, relevance int, s double").repartition(5)
    got = {(r.race_id, r.horse_number): (r.gradient, r.curvature) for r in R.gradients(df, "relevance", "s").collect()}
    want = {(k, no): (g, h) for k, race in races.items() for no, g, h in plain(race)}
    assert got.keys() == want.keys()
    assert all(math.isclose(a, b, abs_tol=1e-12) for k in want for a, b in zip(got[k], want[k]))
    assert R.gradients(df.limit(0), "relevance", "s").count() == 0


def test_too_many_runners(spark):
    df = spark.range(19).select(F.lit(1).alias("race_id"), F.col("id").cast("int").alias("horse_number"), F.col("id").alias("relevance"), F.lit(0.0).alias("s"))
    with pytest.raises(Exception, match="more than 18 runners in race 1"):
        R.gradients(df, "relevance", "s").collect()


def test_tree_walk(spark):
    text = """DecisionTreeRegressionModel: uid=x, depth=2, numNodes=5, numFeatures=2
  If (feature 0 in {0.0,2.0})
   Predict: 0.5
  Else (feature 0 not in {0.0,2.0})
   If (feature 1 <= -1.5E-4)
    Predict: 1.0
   Else (feature 1 > -1.5E-4)
    Predict: 2.0
"""
    tree = R.parse_tree(text)
    assert tree == ["split", 0, [0.0, 2.0], ["leaf", 0], ["split", 1, -1.5e-4, ["leaf", 1], ["leaf", 2]]] and R.leaves(tree) == 3
    rows = spark.createDataFrame([([2.0, 0.0],), ([1.0, -1.0],), ([1.0, 0.0],)], "x array<double>")
    assert [r[0] for r in rows.select(R.walk(tree, F.col("x"), lambda n: F.lit(n))).collect()] == [0, 1, 2]


@pytest.fixture(scope="module")
def both(e):
    train, val, test = split_by_date(e)
    params = {"maxIter": 8, "maxDepth": 3, "stepSize": 0.3}
    return {o: L.train(train, FEATURES, 1095.0, params, o) for o in ("binary", "rank")}, val, test


def test_better_than_the_classifier(both):
    models, _, test = both
    got = {o: evaluate(test, L.predict(m, test)).first() for o, m in models.items()}
    assert got["rank"].win_logloss < got["binary"].win_logloss
    assert got["rank"].win_accuracy > got["binary"].win_accuracy


def test_training_lowers_the_loss(both):
    """Each further tree orders the pairs of the training races better."""
    model = both[0]["rank"].win
    assert len(model.trees) == len(model.values) == 8 and all(R.leaves(t) >= 2 for t in model.trees)


def test_rank_versions(spark, both, tmp_path):
    models, val, test = both
    cal = L.calibrate(models["rank"], val)
    L.save_models(cal, str(tmp_path), "20240101_000000")
    back = L.load_latest(spark, str(tmp_path))
    a, b = ({(r.race_id, r.horse_number): r.win_prob for r in L.predict(m, test).collect()} for m in (cal, back))
    assert a == b and isinstance(back.win, R.RankModel)


def test_objective_names(e):
    with pytest.raises(ValueError, match="objective"):
        L.train(e, FEATURES, objective="other")


def test_nothing_to_learn(e):
    """Races of equals end without a tree, and every runner scores 0."""
    flat = e.withColumn("relevance", F.lit(1))
    model = L.fit_win_rank(flat, FEATURES, None, {"maxIter": 2})
    assert model.trees == [] and model.score(e.limit(5), "s").filter("s = 0").count() == 5
