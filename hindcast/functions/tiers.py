"""Bands, buckets and tiers as ``when`` chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hindcast import schema as S
from hindcast.functions.clean import _c


def bucket(c: Column | str, edges: Sequence[float], labels: Sequence, null_label=None, right: bool = True) -> Column:
    """``labels[i]`` for the first edge that holds the value; the last label is open.

    ``right=True`` keeps an edge in the lower bucket. Null falls to ``null_label``.
    """
    x = _c(c)
    out = F.when(x.isNull(), F.lit(null_label))
    for edge, label in zip(edges, labels):
        out = out.when((x <= edge) if right else (x < edge), F.lit(label))
    return out.otherwise(F.lit(labels[len(edges)]))


def band(c: Column | str, edges: Sequence[float] = (1400, 1800, 2200), bounds: tuple[float, float] | None = (0, 10000)) -> Column:
    """Distance band number; values outside ``bounds`` (left open, right closed) are null."""
    x = _c(c)
    value = bucket(x, edges, list(range(len(edges) + 1)))
    if bounds is None:
        return value
    return F.when((x > bounds[0]) & (x <= bounds[1]), value)


def pop_tier(c: Column | str, null_label: str | None = S.POP_TIERS[3]) -> Column:
    """1 / 2-3 / 4-6 / 7 and more; a missing rank counts as the last tier unless told otherwise."""
    x = _c(c)
    t = S.POP_TIERS
    return (F.when(x.isNull(), F.lit(null_label)).when(x == 1, t[0]).when(x <= 3, t[1]).when(x <= 6, t[2])
            .otherwise(t[3]))


def odds_tier(c: Column | str) -> Column:
    return bucket(c, (2.0, 5.0, 10.0), S.ODDS_TIERS, null_label=S.ODDS_TIERS[3], right=False)


def grade_tier(c: Column | str) -> Column:
    return F.when(_c(c).isin(S.GRADE_TIERS[:4]), _c(c)).otherwise(S.GRADE_TIERS[4])


def distance_bucket(c: Column | str) -> Column:
    return bucket(c, (1400, 1800, 2400), S.DISTANCE_BUCKETS, null_label=S.DISTANCE_BUCKETS[3])


def head_count_bucket(c: Column | str) -> Column:
    return bucket(c, (9, 15), S.HEAD_COUNT_BUCKETS, null_label=S.HEAD_COUNT_BUCKETS[2])


def weight_diff_bucket(c: Column | str) -> Column:
    x = _c(c)
    low, mid, high = S.WEIGHT_DIFF_BUCKETS
    return F.when(x <= -6, low).when(x >= 6, high).when(x.isNotNull(), mid)


def rest_days_bucket(c: Column | str) -> Column:
    return bucket(c, (13, 34, 63, 119), S.REST_DAYS_BUCKETS)


def rate_tier(rate: Column | str, n: Column | str, min_n: int, lo: float, hi: float,
              labels: Sequence[str] = tuple(S.RATE_TIERS)) -> Column:
    """Low / mid / high by fixed cuts; null until ``min_n`` earlier rows exist."""
    r = _c(rate)
    return F.when(_c(n) >= min_n, F.when(r <= lo, labels[0]).when(r >= hi, labels[2]).when(r.isNotNull(), labels[1]))
