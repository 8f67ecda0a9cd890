"""The pairwise gradients of a batch of races at once: no lambda for each pair, whatever is null, and a bounded number of pairs at a time."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_ranking import plain

from hindcast.operators import ranking as R


def batch(races):
    runners = [r for race in races for r in race]
    no, g, s = zip(*runners, strict=True)
    return R._batch_gradients(pa.array(no, pa.int32()), np.array(g, float), pa.array([1.0] * len(no)), pa.array(s, pa.float64()),
                              np.array([len(r) for r in races], np.int64))


@pytest.mark.parametrize("pairs", [1, 50, 1 << 18])
def test_pairs_come_in_parts(monkeypatch, pairs):
    monkeypatch.setattr(R, "PAIRS", pairs)
    rng = random.Random(9)
    races = [[(i + 1, rng.randint(0, 4), rng.choice([0.0, 0.5, rng.random()])) for i in range(n)] for n in (1, 7, 30, 2, 18)]
    races = [race if len({r[1] for r in race}) > 1 else [(no, no, s) for no, _, s in race] for race in races]
    l, h, null = batch(races)
    want = [x for race in races for x in plain(race)]
    assert not null.any() and np.allclose(l, [x[1] for x in want], atol=1e-12) and np.allclose(h, [x[2] for x in want], atol=1e-12)


def test_nulls(spark):
    """A score that is not known makes the gradients of all runners of another gain unknown; a weight its own ones; equal gains teach nothing."""
    rows = [(1, 1, 2, 0.3), (1, 2, 1, None), (1, 3, 1, 0.1), (2, 1, 1, None), (2, 2, 1, 0.2), (3, 1, 0, None), (4, None, 1, 0.2), (4, 2, 3, 0.2)]
    df = spark.createDataFrame(rows, "race_id long, horse_number int, relevance int, s double")
    got = {(r.race_id, r.horse_number): (r.gradient, r.curvature) for r in R.gradients(df, "relevance", "s").collect()}
    assert got.pop((1, 1)) == got.pop((1, 2)) == (None, None) and got.pop((1, 3)) != (None, None)
    assert got == {(2, 1): (0, 0), (2, 2): (0, 0), (3, 1): (0, 0), (4, None): (0, 0), (4, 2): (0, 0)}


def test_no_lambda_for_each_pair(spark, capsys):
    df = spark.createDataFrame([(1, 1, 1, 0.5)], "race_id long, horse_number int, relevance int, s double")
    R.gradients(df, "relevance", "s").explain()
    plan = capsys.readouterr().out
    assert "lambdafunction" not in plan and "MapInArrow" in plan
