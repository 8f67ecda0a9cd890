"""Splitting oversized keys must not change any result."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from hindcast.operators import history as H
from hindcast.operators import keyed as K


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows, another third has no key; several rows share a day."""
    n = 3000
    df = spark.range(n).select(
        F.col("id").alias("race_id"), F.lit(1).alias("horse_number"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id") % 40).cast("long").alias("horse_id"),
        F.expr("date_add(date'2020-01-01', cast(id % 97 as int))").alias("date"),
        (F.col("id") * 37 % 11).cast("double").alias("x"), (F.col("id") % 2).alias("c"))
    return df.cache()


def _plain(df, cols):
    w = Window.partitionBy("horse_id").orderBy(*H.ORDER)
    return df.withColumns({n: F.when(F.col("horse_id").isNotNull(), fn(w)) for n, fn in cols.items()})


LOOK = {"lag": lambda w: F.lag("x").over(w), "m5": H.mean_last("x", 5), "m30": H.mean_last("x", 30)}


def test_hot_keys_are_found(spark, skewed, hot):
    found = K.hot_keys(skewed, {"h": ["horse_id"], "none": ["race_id"]})
    seven = spark.range(1).select(F.xxhash64(F.lit(7).cast("long"))).first()[0]
    assert seven in found["h"] and found["none"] == []


def test_look_back_split_equals_plain(skewed, hot):
    tagged = K.Keyed.of(skewed, ["horse_id"], H.ORDER)
    assert tagged.split and tagged.df.filter("horse_id = 7").select(K.LANE).distinct().count() > 3
    got = tagged.look_back(LOOK, 30).result()
    assert rows(got, "race_id", *LOOK) == rows(_plain(skewed, LOOK), "race_id", *LOOK)


def test_look_back_within_split_equals_plain(skewed, hot):
    got = K.Keyed.of(skewed, ["horse_id"], H.ORDER).look_back({"m5": LOOK["m5"]}, 5, within=["c"]).result()
    w = Window.partitionBy("horse_id", "c").orderBy(*H.ORDER)
    want = skewed.withColumn("m5", F.when(F.col("horse_id").isNotNull(), LOOK["m5"](w)))
    assert rows(got, "race_id", "m5") == rows(want, "race_id", "m5")


def test_running_split_equals_plain(skewed, hot):
    got = K.Keyed.of(skewed, ["horse_id"], H.ORDER).running({"s": F.col("x"), "n": F.lit(1).cast("long")}).result()
    run = lambda c: (lambda w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    want = _plain(skewed, {"s": run(F.col("x")), "n": run(F.lit(1))})
    assert rows(got, "race_id", "s", "n") == rows(want, "race_id", "s", "n")


def test_dense_index_split(skewed, hot):
    got = K.dense_index(skewed.withColumn("k", F.lit(0)), ["k"], ["race_id"]).select("race_id", "idx").collect()
    assert all(r.idx == r.race_id + 1 for r in got)


def test_all_history_features_same_when_split(e, hot, spark):
    split = rows(H.training_features(e).select("race_id", "horse_number", "avg_finish_last5", "avg_corner_last3_cond", "trainer_win_rate_last30",
                                               "jockey_win_rate_venue_cond", "bracket_distance_avg_finish"))
    spark.conf.set(K.HOT_ROWS_CONF, "100000000")
    plain = rows(H.training_features(e).select("race_id", "horse_number", "avg_finish_last5", "avg_corner_last3_cond", "trainer_win_rate_last30",
                                               "jockey_win_rate_venue_cond", "bracket_distance_avg_finish"))
    assert split == plain


@pytest.mark.parametrize("settle", [5, 40, 200_000])
def test_exact_quantiles(spark, settle):
    x = np.concatenate([np.random.default_rng(3).normal(size=4000), np.zeros(2000), [5.0]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = [0.0, 1 / 3, 0.5, 2 / 3, 0.999, 1.0]
    got = K.exact_quantiles(df, "x", probs, settle)
    assert np.allclose(got, np.quantile(x, probs), atol=1e-12)


def test_quantiles_of_nothing(spark):
    assert K.exact_quantiles(spark.createDataFrame([], "x double"), "x", [0.5]) is None
