import random

import pytest

from hindcast.operators import learn as L
from hindcast.operators.isotonic import isotonic_blocks, step_points

ROW = "s double, y double, w double"


def brute(rows):
    """Pooled neighbours, one after the other, on exact sums of small whole numbers."""
    points = {}
    for s, y, w in rows:
        if s is not None and y is not None and w and w > 0 and s == s and y == y:
            n, a, b = points.get(s, (0, 0.0, 0.0))
            points[s] = (n + 1, a + w, b + w * y)
    out = []
    for s, (n, a, b) in sorted(points.items()):
        out.append([s, s, n, a, b])
        while len(out) > 1 and out[-2][4] * out[-1][3] >= out[-1][4] * out[-2][3]:
            lo, _, m, c, d = out[-2]
            out[-2:] = [[lo, out[-1][1], m + out[-1][2], c + out[-1][3], d + out[-1][4]]]
    return [tuple(x) for x in out]


def shapes():
    rng = random.Random(5)
    noisy = [(float(rng.randrange(400)), float(rng.random() < 0.5), float(rng.randrange(1, 4))) for _ in range(2000)]
    return {
        "noisy": [(s, float(rng.random() < s / 400), w) for s, _, w in noisy],
        "falling": [(float(i), float(500 - i), 1.0) for i in range(500)],
        "rising": [(float(i), float(i), 1.0) for i in range(500)],
        "valleys": [(float(i), float((i % 50) * (1 if i < 250 else -1)), 1.0) for i in range(500)],
        "flat": [(float(i % 7), 1.0, 2.0) for i in range(100)],
        "odd values": [(None, 1.0, 1.0), (1.0, None, 1.0), (float("nan"), 1.0, 1.0), (2.0, 1.0, 0.0), (2.0, 1.0, None), (-0.0, 0.0, 1.0), (0.0, 1.0, 1.0), (3.0, 0.0, 1.0)],
        "none": [],
    }


@pytest.mark.parametrize("shape", shapes())
@pytest.mark.parametrize("range_rows", [40, 200_000])
def test_blocks(spark, shape, range_rows):
    rows = shapes()[shape]
    got = isotonic_blocks(spark.createDataFrame(rows, ROW), "s", "y", "w", range_rows).orderBy("lo").collect()
    assert [(r.lo, r.hi, r.n, r.weight, r.total) for r in got] == brute(rows)
    assert all(a["mean"] < b["mean"] for a, b in zip(got, got[1:], strict=False))


def test_calibrator_holds_steps_only(spark):
    rows = shapes()["noisy"]
    df = spark.createDataFrame([(s, y) for s, y, _ in rows], "s double, y double")
    blocks = isotonic_blocks(df, "s", "y").orderBy("lo").collect()
    cal = L.fit_calibrator(df, "s", "y")
    assert len(cal.model.boundaries) <= step_points(isotonic_blocks(df, "s", "y")).count()
    want = {s: b["mean"] for b in blocks for s in {x[0] for x in rows} if b.lo <= s <= b.hi}
    asked = spark.createDataFrame([(s, s) for s in want], "s double, at double")
    assert all(abs(want[r["at"]] - r.s) < 1e-9 for r in cal.apply(asked, "s").collect())
