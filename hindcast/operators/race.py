"""Operators within one race.

A race is bounded by its field (the ranking labels stop at 18 runners), so these are plain windows on the race key.
Operators on the same race key share one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast import schema as S
from hindcast.functions.clean import _c
from hindcast.operators.keyed import exact_quantiles
from hindcast.session import stored

RACE, ENTRY = "race_id", "horse_number"


def over_race(by: str | Sequence[str] = RACE):
    return Window.partitionBy(*([by] if isinstance(by, str) else by))


def zscore(col: Column | str, by: str = RACE, invert: bool = False) -> Column:
    """Standard score in the race; null for a field without spread. ``invert``: smaller is better."""
    x, w = _c(col), over_race(by)
    centred = F.avg(x).over(w) - x if invert else x - F.avg(x).over(w)
    sd = F.stddev_samp(x).over(w)
    return F.when(sd > 0, centred / sd)


def rank_keep(col: Column | str, by: str = RACE, descending: bool = False) -> Column:
    """Smallest rank for ties; null stays null."""
    x = _c(col)
    order = x.desc_nulls_last() if descending else x.asc_nulls_last()
    return F.when(x.isNotNull(), F.rank().over(over_race(by).orderBy(order)))


def rank_bottom(col: Column | str, by: str = RACE) -> Column:
    """Smallest rank for ties; nulls share the last place."""
    return F.rank().over(over_race(by).orderBy(_c(col).asc_nulls_last()))


def count_if(cond: Column, by: str = RACE) -> Column:
    return F.sum(F.when(cond, 1.0).otherwise(0.0)).over(over_race(by))


def pace(df: DataFrame, corner: str = "avg_corner_last3") -> DataFrame:
    """Rank by running style and the number of front runners of the race."""
    return df.withColumns({
        "corner_style_race_rank": rank_bottom(corner),
        "race_leader_count": count_if(F.col(corner) <= S.LEADER_CORNER),
    })


def predicted_rank(df: DataFrame, col: str = "win_prob") -> DataFrame:
    return df.withColumn("predicted_rank", F.rank().over(over_race().orderBy(F.col(col).desc_nulls_last())))


def normalise(df: DataFrame, col: str = "win_prob", out: str | None = None, by: str | Sequence[str] = RACE) -> DataFrame:
    return df.withColumn(out or col, F.col(col) / F.nullif(F.sum(col).over(over_race(by)), F.lit(0.0)))


def softmax(df: DataFrame, col: str = "score", out: str = "win_prob", by: str | Sequence[str] = RACE) -> DataFrame:
    """Softmax of the scores per race, shifted by the race maximum."""
    shifted = df.withColumn("__e", F.exp(F.col(col) - F.max(col).over(over_race(by))))
    return normalise(shifted, "__e", out, by).drop("__e")


def relevance_label(df: DataFrame, pos: str = "finishing_position") -> DataFrame:
    return df.withColumns({
        "relevance": (F.max(pos).over(over_race()) - F.col(pos)).cast("int"),
        "group_size": F.count(F.col(ENTRY)).over(over_race()),
    })


def _pick_order(col: str):
    return over_race().orderBy(F.col(col).desc_nulls_last(), F.col(ENTRY).asc())


def best_rows(df: DataFrame, n: int, col: str = "win_prob") -> DataFrame:
    """At most n rows per race in ``pick`` order; ties go to the lower entry number."""
    return (df.filter(F.col(col).isNotNull()).withColumn("pick", F.row_number().over(_pick_order(col)))
            .filter(F.col("pick") <= n))


def top1(df: DataFrame, col: str = "win_prob") -> DataFrame:
    """The row with the highest value per race."""
    return best_rows(df, 1, col).drop("pick")


def topn(df: DataFrame, n: int, col: str = "win_prob") -> DataFrame:
    """The n best rows per race with their place ``pick``; races with fewer runners are left out."""
    return (best_rows(df, n, col).withColumn("__n", F.count(F.lit(1)).over(over_race()))
            .filter(F.col("__n") >= n).drop("__n"))


def dispersion(df: DataFrame, col: str = "odds") -> DataFrame:
    """Spread of the log odds, one row per race (partial aggregation, no window)."""
    return df.filter(F.col(col) > 0).groupBy(RACE).agg(F.stddev_samp(F.ln(col)).alias("dispersion"))


def dispersion_tier(df: DataFrame, col: str = "odds", labels: Sequence[str] = tuple(S.DISPERSION_TIERS)) -> DataFrame:
    """Equal-count tiers of the spread of log odds, one row per race."""
    d = stored(dispersion(df, col))  # one narrow row per race, read by every quantile pass
    q = len(labels)
    cuts = exact_quantiles(d, "dispersion", [i / q for i in range(1, q)])
    tier = F.when(F.col("dispersion").isNull(), F.lit(None).cast("string"))
    for cut, label in zip(cuts or [], labels):
        tier = tier.when(F.col("dispersion") <= cut, label)
    return d.withColumn("tier", tier.otherwise(labels[-1]))
