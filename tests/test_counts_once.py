"""The counts of a unit are made once, whatever the number of cells that it is in."""

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from hindcast import schema as S
from hindcast.operators import bets as B
from hindcast.operators import resample as R


def test_rows_of_one_unit_share_their_counts(spark):
    df = spark.range(4000).select((F.col("id") % 900).alias("u"), (F.col("id") % 5).alias("c"), (F.col("id") % 7).cast("double").alias("x"))
    values = {"s": F.col("x"), "n": F.lit(1)}
    once, each = (rows(R.replicate_sums(df, ["u"], values, 70, 3, ["c"], repeated=k)) for k in (True, False))
    assert once == each and len(once) == 350


def test_counts_go_on(spark):
    """A range of replicates is the same, whether or not it follows the one before."""
    h = np.random.default_rng(2).integers(0, 1 << 28, (50, 4))
    one, other = R.UnitCounts(), R.UnitCounts()
    one.of(h, 0, R.BLOCK_BOOTS)
    a, b = (c.of(h, R.BLOCK_BOOTS, R.BLOCK_BOOTS + 9).copy() for c in (one, other))
    assert (a == b).all() and one.next == R.BLOCK_BOOTS + 9 and a.shape == (50, 9)


def test_a_race_is_one_row_of_its_interval(spark):
    """Thresholds are conditional sums, and the intervals are those of the records of every threshold and tier."""
    n = 60
    e = spark.createDataFrame([(k, i, int(i == k % 4), 1.5 + (k * 7 + i * 3) % 11, float(1 + (k + i) % 9)) for k in range(n) for i in range(4)],
                              "race_id long, horse_number int, is_win int, odds double, popularity double")
    p = e.select("race_id", "horse_number", (0.1 + F.col("horse_number") * 0.11).alias("win_prob"), F.lit(0.5).alias("place_prob"))
    y = spark.createDataFrame([(k, S.QUINELLA, "3-2", str(100 + k)) for k in range(0, n, 2)], "race_id long, bet_type string, combination string, payout string")
    got = R.combo_ci(e, p, y, S.QUINELLA, n_boot=200)
    want = R.pooled_ci(B.bet_records(e, p, y, S.QUINELLA), n_boot=200)
    assert rows(got, *sorted(got.columns)) == rows(want, *sorted(got.columns)) and got.filter("n_bets > 0").count() > 5
    assert "threshold" not in got._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[-1].split("Join")[0]
