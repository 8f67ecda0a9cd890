from itertools import permutations
from math import log

import pytest
from conftest import rows
from pyspark.sql import functions as F

from hindcast import schema as S
from hindcast.operators import bets as B
from hindcast.operators import combos as G
from hindcast.operators import evaluate as E
from hindcast.operators import race as R
from hindcast.operators import resample as RS

ENTRIES = [  # race, no, win, placed, odds, popularity, grade
    ("a", 1, 0, 1, 2.0, 1.0, "GI"), ("a", 2, 1, 1, 6.0, 3.0, "GI"), ("a", 3, 0, 1, None, None, "GI"),
    ("b", 1, 1, 1, 1.5, 1.0, None),
    ("c", 7, 0, 1, 30.0, 8.0, "x"), ("c", 3, 1, 1, 20.0, 7.0, "x"), ("c", 5, 0, 1, 9.0, 4.0, "x"), ("c", 4, 0, 0, 3.0, 1.0, "x"),
]
PREDS = [("a", 1, 0.4, 0.9), ("a", 2, 0.4, 0.8), ("a", 3, 0.2, 0.7), ("b", 1, 1.0, 1.0),
         ("c", 7, 0.3, 0.5), ("c", 3, 0.5, 0.9), ("c", 5, 0.1, 0.5), ("c", 4, 0.1, 0.4)]
PAYOFFS = [("a", "馬連", "2-1", "1,310"), ("a", "ワイド", "1-2", "200"), ("c", "馬連", "7-3", "x"), ("c", "三連複", "7-3-4", "5,000"),
           ("c", "複勝", "3", "400"), ("b", "複勝", "1", "110"), ("a", "複勝", "1", "150")]


@pytest.fixture(scope="module")
def frames(spark):
    e = spark.createDataFrame(ENTRIES, "race_id string, horse_number int, is_win int, is_placed int, odds double, popularity double, grade string")
    p = spark.createDataFrame(PREDS, "race_id string, horse_number int, win_prob double, place_prob double")
    y = spark.createDataFrame(PAYOFFS, "race_id string, bet_type string, combination string, payout string")
    return e, p, y


def test_evaluate(frames):
    e, p, _ = frames
    r = E.evaluate(e, p).first()
    assert r.win_accuracy == pytest.approx(2 / 3)  # a: tie goes to entry 1, a miss
    assert r.recovery_rate == pytest.approx((1.5 + 20.0) / 3)
    want = 0.0
    for (_, _, y, *_), (_, _, q, _) in zip(ENTRIES, PREDS):
        q = min(max(q, 1e-15), 1 - 1e-15)
        want -= log(q) if y else log(1 - q)
    assert r.win_logloss == pytest.approx(want / 8)


def test_tiers_are_complete(frames):
    e, p, _ = frames
    got = {r.tier: r for r in E.by_tier(e, p, "popularity").collect()}
    assert list(S.POP_TIERS) == sorted(got, key=lambda t: got[t].tier_no)
    assert (got["1番人気"].picks, got["1番人気"].hit_rate, got["7番人気以下"].recovery) == (2, 0.5, 20.0)
    assert got["4-6番人気"].picks == 0 and got["4-6番人気"].hit_rate is None
    grades = {r.tier: r.picks for r in E.by_tier(e, p, "grade").collect()}
    assert grades == {"GI": 1, "GII": 0, "GIII": 0, "L": 0, "平場": 2}


def test_ev_grid(frames):
    e, p, _ = frames
    got = {(r.threshold, r.tier): r for r in E.ev_grid(e, p, [1.0, 1.5, 50.0]).collect()}
    assert len(got) == 15
    r = got[(1.5, S.ALL_TIER)]  # strictly above: b has EV exactly 1.5
    assert (r.picks, r.hits, r.coverage) == (3, 2, pytest.approx(2 / 3)) and r.recovery == pytest.approx(26.0 / 3)
    assert got[(50.0, S.ALL_TIER)].picks == 0 and got[(50.0, S.ALL_TIER)].recovery is None


def test_bets(frames):
    e, p, y = frames
    got = {r.bet: r for r in E.multi_bet(e, p, y).collect()}
    assert (got["複勝"].picks, got["複勝"].hits, got["複勝"].recovery) == (3, 3, pytest.approx(660 / 300))
    assert (got["馬連"].picks, got["馬連"].hits) == (2, 1)  # single-runner race bought nothing, unparsable payout lost
    assert got["三連複"].picks == 2 and got["三連複"].recovery == pytest.approx(5000 / 200)
    rec = rows(B.bet_records(e, p, y, S.QUINELLA, [1.0, 2.0]).filter("tier = '全体'"), "threshold", "race_id", "is_hit", "payout_odds")
    assert rec == [(1.0, "c", 0.0, 0.0), (2.0, "c", 0.0, 0.0)]  # a: EV 0.8 of its best runner closes the gate


def test_ev_bet_grid(frames):
    e, p, y = frames
    got = {(r.threshold, r.tier, r.bet): r for r in E.ev_bet_grid(e, p, y, [1.0]).collect()}
    assert len(got) == 5 * 4
    assert (got[(1.0, "全体", "単勝")].picks, got[(1.0, "全体", "単勝")].hits) == (2, 2)
    assert got[(1.0, "全体", "三連複")].recovery == 50.0 and got[(1.0, "1番人気", "馬連")].picks == 0


def test_softmax_and_normalise(spark):
    df = spark.createDataFrame([("r", 1, 1000.0), ("r", 2, 1001.0), ("s", 1, 0.0)], "race_id string, horse_number int, score double")
    got = rows(R.softmax(df), "race_id", "horse_number", "win_prob")
    assert got[2] == ("s", 1, 1.0) and got[0][2] + got[1][2] == pytest.approx(1.0) and got[1][2] == pytest.approx(0.731058579)
    zero = spark.createDataFrame([("r", 1, 0.0), ("r", 2, 0.0)], "race_id string, horse_number int, p double")
    assert all(r.p is None for r in R.normalise(zero, "p").collect())


def orders(ps):
    for perm in permutations(range(len(ps))):
        prob, left = 1.0, 1.0
        for i in perm:
            if left <= 1e-12:
                prob = 0.0
                break
            prob, left = prob * ps[i] / left, left - ps[i]
        yield perm, prob


@pytest.mark.parametrize("ps", [[0.4, 0.3, 0.2, 0.1], [0.5, 0.5], [0.7, 0.2, 0.1], [0.3, 0.25, 0.2, 0.15, 0.07, 0.03], [1.0], [0.98, 0.01, 0.007, 0.003]])
def test_combination_probabilities_by_brute_force(spark, ps):
    df = spark.createDataFrame([("r", i + 1, float(p)) for i, p in enumerate(ps)], "race_id string, horse_number int, win_prob double")
    n, place, quin, wide, trio = len(ps), {}, {}, {}, {}
    for perm, q in orders(ps):
        for k in perm[:3]:
            place[k + 1] = place.get(k + 1, 0) + q
        if n > 1:
            a = tuple(sorted(x + 1 for x in perm[:2]))
            quin[a] = quin.get(a, 0) + q
        top = sorted(x + 1 for x in perm[:3])
        for i in range(len(top)):
            for j in range(i + 1, len(top)):
                wide[top[i], top[j]] = wide.get((top[i], top[j]), 0) + q
        if n > 2:
            trio[tuple(top)] = trio.get(tuple(top), 0) + q
    assert {r.horse_number: r.place_prob for r in G.pl_place(df).collect()} == pytest.approx(place, abs=1e-9)
    assert {(r.i, r.j): r.prob for r in G.pl_quinella(df).collect()} == pytest.approx(quin, abs=1e-9)
    assert {(r.i, r.j): r.prob for r in G.pl_wide(df).collect()} == pytest.approx(wide, abs=1e-9)
    assert {(r.i, r.j, r.k): r.prob for r in G.pl_trio(df).collect()} == pytest.approx(trio, abs=1e-9)


def test_probability_sums(e):
    from hindcast.plans.entries import predictions
    p = predictions(e, "b")
    n = p.groupBy("race_id").agg(F.count("*").alias("n"))
    place = G.pl_place(p).groupBy("race_id").agg(F.sum("place_prob").alias("s")).join(n, "race_id")
    assert place.filter("abs(s - least(3, n)) > 1e-6").count() == 0
    quin = G.pl_quinella(p).groupBy("race_id").agg(F.sum("prob").alias("s"))
    assert quin.filter("abs(s - 1) > 1e-9").count() == 0


def test_combinations_of_odd_races(spark):
    schema = "race_id string, horse_number int, win_prob double, place_prob double"
    many = spark.createDataFrame([("big", i, 0.1, 0.1) for i in range(19)], schema)
    for table in (G.pl_place, G.pl_wide, G.recommend):
        with pytest.raises(Exception, match="more than 18 runners in race big"):
            table(many).collect()
    odd = spark.createDataFrame([("a", 1, None, None), ("a", 2, 0.0, None), (None, 1, .5, .5), ("b", None, .5, .5), ("c", 3, 0.4, None)], schema)
    assert rows(G.pl_place(odd), "race_id", "horse_number", "place_prob") == [("c", 3, 1.0)]
    assert G.pl_quinella(odd).count() == G.pl_trio(odd).count() == G.pl_place(odd.limit(0)).count() == 0
    assert [(r.race_id, r.recommended_win, r.recommended_place, r.recommended_trio) for r in G.recommend(odd).collect()] == [("c", True, False, False)]
    field = spark.createDataFrame([("r", i, 1 / 18, 1 / 6) for i in range(1, 19)], schema)
    assert G.pl_trio(field).agg(F.count("*"), F.round(F.sum("prob"), 9)).first() == (816, 1.0)
    best = {r.horse_number for r in G.recommend(field).collect() if r.recommended_trio}
    assert best == {1, 2, 3}  # all equal: the lower numbers


def test_recommendations(spark):
    df = spark.createDataFrame([("r", 1, .5, .9, 2.0), ("r", 2, .3, .7, 6.0), ("r", 3, .15, .6, 3.0), ("r", 4, .05, .2, 40.0)],
                               "race_id string, horse_number int, win_prob double, place_prob double, odds double")
    got = {r.horse_number: r for r in G.recommend(df).collect()}
    assert [n for n, r in got.items() if r.recommended_win] == [2]
    assert sorted(n for n, r in got.items() if r.recommended_place) == [1, 2, 3]
    assert sorted(n for n, r in got.items() if r.recommended_quinella) == [1, 2]
    assert sorted(n for n, r in got.items() if r.recommended_trio) == [1, 2, 3]
    assert not got[4].recommended_trio and G.strategy_picks(df).count() == 0
    tier2 = df.withColumn("odds", F.when(F.col("horse_number") == 1, 4.0).otherwise(F.col("odds")))
    assert rows(G.strategy_picks(tier2), "strategy", "horse_number", "ev") == [("堅実", 1, 2.0), ("堅実", 2, 2.0)]


def test_longshot_race_is_left_to_the_longshot_strategy(spark):
    rows_ = [("r", i, (0.3 if i == 8 else 0.1), 0.3, float(i)) for i in range(1, 9)]
    df = spark.createDataFrame(rows_, "race_id string, horse_number int, win_prob double, place_prob double, odds double")
    got = G.recommend(df).collect()
    assert not any(r.recommended_win or r.recommended_trio for r in got) and any(r.recommended_place for r in got)
    assert rows(G.strategy_picks(df), "strategy", "horse_number") == [("大穴", 8)]


def test_poisson_counts(spark):
    df = spark.range(4000).withColumn("u", F.col("id").cast("string"))
    r = RS.replicates(df, ["u"], 20, 1)
    total = r.groupBy("b").agg(F.sum("w").alias("s")).collect()
    assert len(total) == 20 and all(abs(t.s / 4000 - 1) < 0.08 for t in total)
    var = r.agg((F.sum(F.col("w") * F.col("w")) / F.lit(80000)).alias("m2")).first().m2
    assert abs(var - 2) < 0.1  # E[w^2] of Poisson(1)
    a = {x.u: x.w for x in r.filter("b = 0").collect()}
    b = {x.u: x.w for x in r.filter("b = 1").collect()}
    cov = sum(a.get(str(i), 0) * b.get(str(i), 0) for i in range(4000)) / 4000
    assert abs(cov - 1) < 0.1


@pytest.mark.parametrize("method", ["poisson", "draws"])
def test_bootstrap_interval(spark, method):
    df = spark.range(400).select(F.col("id").alias("race_id"), (F.col("id") % 4 == 0).cast("int").alias("is_hit"), F.lit(4.4).alias("payout_odds"))
    r = RS.bootstrap_ci(df, ["race_id"], n_boot=400, method=method).first()
    assert r.n_bets == 400 and r.point_estimate == pytest.approx(1.1)
    se = 4.4 * (0.25 * 0.75 / 400) ** 0.5
    assert r.ci_lower == pytest.approx(1.1 - 1.96 * se, abs=0.35 * se) and r.ci_upper == pytest.approx(1.1 + 1.96 * se, abs=0.35 * se)
    assert not r.above_100 and not r.above_110


def test_empty_cells_have_no_interval(frames):
    e, p, _ = frames
    got = {(r.threshold, r.tier): r for r in RS.ev_grid_ci(e, p, [50.0], n_boot=10).collect()}
    r = got[(50.0, S.ALL_TIER)]
    assert r.n_bets == 0 and r.point_estimate is None and r.ci_lower is None and r.above_100 is False


def test_paired_bootstrap_of_equal_models(frames):
    e, p, _ = frames
    got = RS.paired_bootstrap(e, p, p, n_boot=20).collect()
    assert len(got) == 4 and all(r.diff_b_minus_a == 0 and not r.significant for r in got)


def test_calibration_bias_flags(spark):
    curve = spark.createDataFrame([("win", 1, .1, .1, .1, 90), ("win", 2, .5, .5, .2, 10)], "model string, bin int, bin_center double, mean_pred double, actual_rate double, count long")
    r = E.calibration_bias(curve).first()
    assert r.signed_bias == pytest.approx(0.03) and r.needs_calibration and r.direction == "over"


def test_calibration_curve_counts_everything(frames):
    e, p, _ = frames
    got = E.calibration_curve(e, p, 5)
    assert {r.model: r.n for r in got.groupBy("model").agg(F.sum("count").alias("n")).collect()} == {"win": 8, "place": 8}
    first = got.filter("model = 'win' AND bin = 1").first()
    assert first["count"] == 3 and first.bin_center == pytest.approx(0.19)


def test_replicate_sums_are_the_counts_times_the_values(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("u"), (F.col("id") % 3).alias("c"), (F.col("id") % 5).cast("double").alias("x"))
    got = RS.replicate_sums(df, ["u"], {"s": F.col("x"), "n": F.lit(1)}, 30, 5, ["c"])
    want = RS.replicates(df, ["u"], 30, 5).groupBy("c", "b").agg(F.sum(F.col("w") * F.col("x")).alias("s"), F.sum("w").cast("double").alias("n"))
    assert rows(got, "c", "b", "s", "n") == rows(want, "c", "b", "s", "n")


def test_draws_of_any_partitioning(spark, monkeypatch):
    """The interval depends on the bets alone: not on their partitions, and not on how wide the tree of draws is in cells of few returns."""
    df = spark.range(60).select(F.col("id").alias("race_id"), (F.col("id") % 2).alias("tier"), (F.col("id") % 3 == 0).cast("int").alias("is_hit"),
                                (F.col("id") * 0.25).alias("payout_odds"))
    a = rows(RS.bootstrap_ci(df, ["race_id"], ["tier"], n_boot=50, method="draws"))
    assert a == rows(RS.bootstrap_ci(df.repartition(13, "race_id"), ["race_id"], ["tier"], n_boot=50, method="draws")) and len(a) == 2
    monkeypatch.setattr(RS, "DRAW_WIDTH", 60)
    assert a == rows(RS.bootstrap_ci(df.coalesce(1), ["race_id"], ["tier"], n_boot=50, method="draws"))
