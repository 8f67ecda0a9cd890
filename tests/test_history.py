from datetime import date, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from hindcast.operators import history as H
from hindcast.operators import race as R
from hindcast.operators import serving as V
from hindcast.operators import splits as D

DAY = date(2024, 1, 1)
SCHEMA = ("race_id string, date date, horse_number int, horse_id string, jockey_id string, trainer_id string, owner string, sire string, "
          "venue string, course_type string, distance int, bracket_number int, finishing_position int, last_3f double, first_corner_pos int, "
          "finish_time_sec double, class_level double, horse_weight double, weight_carried double, is_win int, is_placed int")


def history(spark, days=(0, 1, 2, 3, 4)):
    """Five races of two horses; horse 0 always wins."""
    out = []
    for i, d in enumerate(days):
        for h in (0, 1):
            out.append((f"R{i}", DAY + timedelta(d), h + 1, f"H{h}", f"J{h}", f"T{h}", f"O{h}", "S", "東京", "芝" if i % 2 == 0 else "ダート", 1600 + 200 * i,
                        h + 1, h + 1, 34.0 + h, h + 1, 93.0 + h, float(i), 480.0, 57.0 - h, int(h == 0), 1))
    return spark.createDataFrame(out, SCHEMA)


def by_race(df, horse="H0"):
    return {r.race_id: r for r in df.filter(F.col("horse_id") == horse).collect()}


def test_first_race_has_no_history(spark):
    f = by_race(H.training_features(history(spark)))
    first, last = f["R0"], f["R4"]
    assert first.avg_finish_last3 is None and first.days_since_last_race is None and first.jockey_win_rate_venue_cond is None
    assert first.trainer_prior_win_rate is None and first.trainer_prior_mounts == 0.0
    assert (last.avg_finish_last3, last.owner_prior_win_rate, last.owner_prior_mounts) == (1.0, 1.0, 4.0)
    assert (last.distance_change, last.course_type_change, last.jockey_change, last.class_change, last.days_since_last_race) == (200.0, 1.0, 0.0, 1.0, 1.0)


def test_same_day_rows_do_not_see_each_other(spark):
    f = by_race(H.training_features(history(spark, (0, 1, 2, 3, 3))))
    assert f["R3"].jockey_prior_mounts == f["R4"].jockey_prior_mounts == 3.0
    assert f["R4"].trainer_win_rate_last30 == 1.0  # row-exclusive statistics may use an earlier race of the day


def test_shrinkage_starts_at_the_global_rate(spark):
    f = by_race(H.training_features(history(spark)))
    assert f["R0"].sire_place_rate_cond == pytest.approx(1.0) and f["R0"].sire_progeny_mounts_cond == 0.0
    assert f["R0"].sire_avg_speed_index_cond == 0.0
    asof = by_race(H.training_features(history(spark), prior="asof"))
    assert asof["R0"].sire_place_rate_cond == 0.0


def test_zscore_without_spread_is_null(spark):
    df = history(spark)
    r = H.race_measures(df).first()
    assert r.horse_weight_relative is None and r.weight_carried_relative is not None
    assert H.race_measures(df.filter("horse_id = 'H0'")).first().race_time_zscore is None


def test_rank_policies(spark):
    df = spark.createDataFrame([("r", 1, 34.0), ("r", 2, None), ("r", 3, 34.0), ("r", 4, None), ("r", 5, 35.0)], "race_id string, horse_number int, x double")
    got = {r.horse_number: (r.k, r.b) for r in df.select("horse_number", R.rank_keep("x").alias("k"), R.rank_bottom("x").alias("b")).collect()}
    assert got == {1: (1, 1), 3: (1, 1), 5: (3, 3), 2: (None, 4), 4: (None, 4)}


def test_null_keys_form_no_group(spark):
    df = history(spark).withColumn("horse_id", F.when(F.col("horse_number") == 1, F.col("horse_id")))
    f = H.training_features(df).filter("horse_id IS NULL").collect()
    assert len(f) == 5 and all(r.avg_finish_last5 is None and r.days_since_last_race is None for r in f)


def test_future_rows_change_nothing(e):
    cut = "1998-01-01"
    cols = ["race_id", "horse_number", "avg_finish_last5", "avg_corner_last3_cond", "jockey_win_rate_venue_cond", "trainer_win_rate_last30",
            "owner_prior_win_rate", "sire_place_rate_cond", "sire_avg_speed_index_cond", "bracket_distance_avg_finish", "corner_style_race_rank"]
    full = H.training_features(e, prior="asof").filter(F.col("date") < cut)
    part = H.training_features(e.filter(F.col("date") < cut), prior="asof")
    assert rows(full, *cols) == rows(part, *cols)


def test_serving_equals_training(spark, e):
    """The races of the last day, presented as upcoming, get the features they had in training."""
    last = e.agg(F.max("date")).first()[0]
    gone = {c: F.lit(None).cast(dict(e.dtypes)[c]) for c in ("finishing_position", "is_win", "is_placed", "finish_time_sec", "last_3f", "first_corner_pos")}
    hist, up = e.filter(F.col("date") < F.lit(last)), e.filter(F.col("date") == F.lit(last)).withColumns(gone).drop("odds", "tenths")
    names = [n for n in [*H.LAGS, *H.recent_exprs(), *H.recent_exprs(cond=True)]]
    names += ["trainer_prior_win_rate", "owner_prior_win_rate", "jockey_prior_win_rate", "sire_place_rate_cond", "sire_progeny_mounts_cond",
              "sire_avg_speed_index_cond", "corner_style_race_rank", "race_leader_count"]
    trained = H.training_features(e, prior="asof").filter(F.col("date") == F.lit(last))
    served = V.serve_assemble(hist, up)
    # a horse entered twice on that day sees its other entry in training, never in serving
    once = e.filter(F.col("date") == F.lit(last)).groupBy("horse_id").count().filter("count = 1").select("horse_id")
    per_race = {"corner_style_race_rank", "race_leader_count"}
    keep = [n for n in names if n not in per_race]
    assert rows(trained.join(once, "horse_id"), "race_id", "horse_number", *keep) == rows(served.join(once, "horse_id"), "race_id", "horse_number", *keep)


def test_decay(spark):
    df = spark.createDataFrame([(DAY,), (DAY - timedelta(365),), (DAY - timedelta(730),)], "date date")
    assert [r[0] for r in df.select(H.decay_weight("date", F.lit(DAY), 365.0)).collect()] == [1.0, 0.5, 0.25]


def test_feature_list():
    cols = H.feature_columns()
    assert "dam" not in cols and len(cols) == len(set(cols)) and "avg_speed_index_last3" in cols and "avg_speed_index_last3_cond" not in cols
    assert "grade" not in H.feature_columns(drop=["grade"]) and H.feature_columns(extra=["z"])[-1] == "z"


def days(spark, n):
    return spark.createDataFrame([(DAY + timedelta(i), i) for i in range(n)], "date date, x int")


def test_split_shares(spark):
    train, val, test = D.split_by_date(days(spark, 20))
    assert (train.count(), val.count(), test.count()) == (14, 2, 4)
    assert train.agg(F.max("date")).first()[0] < val.agg(F.min("date")).first()[0]


def test_walk_forward(spark):
    folds = D.walk_forward(days(spark, 30), 5)
    assert len(folds) == 5
    sizes = []
    for _, tr, te in folds:
        assert tr.agg(F.max("date")).first()[0] < te.agg(F.min("date")).first()[0]
        sizes.append(tr.count())
    assert sizes == sorted(sizes) and sizes[0] == 5
    with pytest.raises(ValueError):
        D.walk_forward(days(spark, 3), 5)
    long = D.walk_forward_rows(days(spark, 30), 5).groupBy("fold", "role").count().collect()
    assert {(r.fold, r.role): r["count"] for r in long}[(5, "train")] == 25


def test_totals_of_many_keys(spark):
    """Each kind equals the single-key totals; null parts of a key give none; repeated entries stay."""
    from datetime import date

    from hindcast.operators import serving as V
    schema = "race_id string, horse_number int, date date, trainer_id string, sire string, course_type string, is_win int, is_placed int"
    day = lambda n: date(2020, 1, n)
    hist = spark.createDataFrame([(f"h{i}", i % 5, day(1 + i % 9), f"t{i % 3}" if i % 7 else None, f"s{i % 2}", "turf" if i % 4 else None,
                                   i % 2, None if i % 6 == 0 else 1 - i % 2) for i in range(60)], schema)
    up = spark.createDataFrame([("u", 1, day(4), "t1", "s0", "turf", 0, 0), ("u", 2, day(4), "new", "s1", "turf", 0, 0), ("u", 3, day(4), None, "s0", None, 0, 0),
                                ("u", 4, None, "t1", "s0", "turf", 0, 0), ("v", 1, day(8), "t1", "s0", "turf", 0, 0), ("v", 1, day(8), "t1", "s0", "turf", 0, 0)], schema)
    kinds = {"a": (("trainer_id",), "is_win"), "b": (("sire", "course_type"), "is_placed")}
    got = V.totals_before([(hist, kinds)], up)
    assert got.count() == 6 and got.columns == [*up.columns, "__a", "__b"]
    past = [r for r in hist.collect()]
    for r in got.collect():
        for tot, keys, flag in ((r["__a"], ["trainer_id"], "is_win"), (r["__b"], ["sire", "course_type"], "is_placed")):
            if r.date is None or any(r[k] is None for k in keys):
                assert tot is None
                continue
            seen = [h[flag] for h in past if h.date < r.date and all(h[k] == r[k] for k in keys) and h[flag] is not None]
            assert (tot.n, tot.s) == (len(seen), sum(seen))
    assert V.totals_before([(hist.limit(0), kinds)], up).filter("__a.n > 0").count() == 0
    assert V.totals_before([(hist, kinds)], up.limit(0)).count() == 0
