"""Exactly n draws by index, against whole numbers one by one."""

from hashlib import md5

import pytest
from conftest import rows

from hindcast.operators import resample as R


def drawn(cell, returns, n_boot, seed):
    """Sum of each replicate; ``returns`` come in the order of their units."""
    n, sums = len(returns), [0.0] * n_boot
    for i in range(1, n + 1):
        digest = md5("|".join([str(seed), *([cell] if cell is not None else []), str(i)]).encode()).hexdigest()
        h0, h1, h2, h3 = (int(digest[k:k + 7], 16) for k in (0, 7, 14, 21))
        for b in range(n_boot):
            u = (((h3 * (b + 1) + h2) * (b + 1) + h1) * (b + 1) + h0) % R.PRIME
            sums[b] += returns[u * n // R.PRIME]
    return sums


@pytest.mark.parametrize("span, block, least", [(1 << 22, 1 << 15, 4096), (8, 3, 2), (1, 1, 1)])
def test_draws_by_index(spark, monkeypatch, span, block, least):
    """Whatever the ranges, the lanes and the partitions; a cell may be null, and a cell may have one bet."""
    for name, value in (("INDEX_RANGE", span), ("INDEX_BLOCK", block), ("LANE_DRAWS", least)):
        monkeypatch.setattr(R, name, value)
    bets = {"a": [float(k * k % 17) for k in range(23)], "b": [2.5], None: [1.0, 0.0, 7.0]}
    df = spark.createDataFrame([(k, c, x) for c, xs in bets.items() for k, x in enumerate(xs)], "race_id long, tier string, __x double").repartition(5)
    got = {(r.tier, r.b): (r.s, r.n) for r in R.indexed_sums(df, ["race_id"], ["tier"], 70, 42).collect()}
    assert got == {(c, b): (s, len(xs)) for c, xs in bets.items() for b, s in enumerate(drawn(c, xs, 70, 42))}


def test_interval_is_that_of_the_indexed_draws(spark):
    import numpy as np
    returns = [float(k % 7) for k in range(40)]
    df = spark.createDataFrame([(k, "x", 1, v) for k, v in enumerate(returns)], "race_id long, tier string, is_hit int, payout_odds double")
    got = rows(R.bootstrap_ci(df, ["race_id"], ["tier"], n_boot=200, method="draws").select("ci_lower", "ci_upper"))
    want = np.quantile(np.array(drawn("x", returns, 200, 42)) / 40, [0.025, 0.975])
    assert got == [tuple(round(float(v), 9) for v in want)]
