"""Replicate counts, their spread over lanes, and exact draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.operators import resample as R


def test_counts_are_those_of_whole_numbers():
    """The cached double arithmetic against integers, over several blocks of replicates."""
    h = np.random.default_rng(0).integers(0, 1 << 28, (R.BLOCK_UNITS, 4))
    h[0], h[1] = R.PRIME - 1, 0
    n = 3 * R.BLOCK_BOOTS + 17
    t = [range(1, n + 1)]
    want = np.array([[sum(((((int(a[3]) * b + int(a[2])) * b + int(a[1])) * b + int(a[0])) % R.PRIME) >= c for c in R.POISSON_CUTS) for b in t[0]] for a in h[:5]])
    counts = R.UnitCounts()
    got = np.concatenate([counts.of(h[:5].astype(float), b, min(n, b + R.BLOCK_BOOTS)).copy() for b in range(0, n, R.BLOCK_BOOTS)], axis=1)
    assert (got == want).all()


def test_rows_do_not_grow_with_partitions(spark):
    """What the lanes hand on depends on cells and replicates alone."""
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("c"), (F.col("id") % 7).cast("double").alias("x"))
    found = {}
    for n in (8, 211):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            out = R.replicate_sums(df, ["id"], {"s": F.col("x"), "n": F.lit(1)}, 50, 1, ["c"])
            plan = out._jdf.queryExecution().toString()
            found[n] = sorted((r.c, r.b, round(r.s, 6), r.n) for r in out.collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert f", {R.LANES})" in plan
    assert found[8] == found[211] and len(found[8]) == 150


@pytest.mark.parametrize("width", [1024, 3])
def test_draws(spark, monkeypatch, width):
    """Exactly n draws in every replicate, spread as draws with replacement are, whatever the partitions and the tree."""
    monkeypatch.setattr(R, "DRAW_WIDTH", width)
    rng = np.random.default_rng(4)
    x = np.where(rng.random(3000) < 0.9, 0.0, np.round(rng.random(3000) * 40, 1))
    rows = [("a", float(v)) for v in x] + [("b", 2.5)] * 40 + [("c", 1.0), (None, 3.0), (None, 0.0)]
    df = spark.createDataFrame(rows, "tier string, __x double")
    got = {}
    for parts in (1, 9):
        got[parts] = {(r.tier, r.b): (r.s, r.n) for r in R.drawn_sums(df.repartition(parts), ["tier"], 1201, 7).collect()}
    assert got[1] == got[9] and len(got[1]) == 4 * 1201
    size = {"a": 3000, "b": 40, "c": 1, None: 2}
    assert all(n == size[t] for (t, _), (_, n) in got[1].items())
    assert all(s == 100.0 for (t, _), (s, _) in got[1].items() if t == "b")
    means = np.array([s / n for (t, _), (s, n) in got[1].items() if t == "a"])
    se = x.std() / np.sqrt(3000)
    assert abs(means.mean() - x.mean()) < 4 * se / np.sqrt(1201) and abs(means.std() / se - 1) < 0.1
    other = {(r.tier, r.b): r.s for r in R.drawn_sums(df, ["tier"], 20, 8).collect()}
    assert any(other[k] != got[1][k][0] for k in other if k[0] == "a")


def test_draws_interval(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0), 3.6) for i in range(400)], "race_id long, is_hit int, payout_odds double")
    r = R.bootstrap_ci(df, ["race_id"], n_boot=2000, method="draws").first()
    assert r.n_bets == 400 and abs(r.point_estimate - 0.9) < 1e-9 and 0.70 < r.ci_lower < 0.80 and 1.0 < r.ci_upper < 1.1
    assert R.bootstrap_ci(df.limit(0), ["race_id"], n_boot=5, method="draws").first().n_bets == 0
