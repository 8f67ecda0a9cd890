"""Exploratory counts, null rates and recovery pivots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast import schema as S
from hindcast.functions import tiers
from hindcast.functions.clean import grade_or_name, payout_value, to_number
from hindcast.operators.bets import fill_grid
from hindcast.operators.history import DATE, HORSE, ORDER, asof_rate, lag_days
from hindcast.operators.keyed import Keyed, exact_quantiles
from hindcast.operators.race import ENTRY, RACE, dispersion_tier


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def yearly_counts(races: DataFrame, date: str = DATE) -> DataFrame:
    year = F.substring(F.col(date).cast("string"), 1, 4).alias("year")
    return races.filter(F.col(date).isNotNull()).groupBy(year).agg(F.count(F.lit(1)).alias("n_races"))


def null_rates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Percent of nulls per column in one pass."""
    cols = list(cols or df.columns)
    rates = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in cols])
    return rates.unpivot([], cols, "column", "null_rate")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def clipped_hist(df: DataFrame, col: str, upper: float = 50, bins: int = 50) -> DataFrame:
    """Histogram of the clipped values over their observed range; the top value belongs to the last bin."""
    x = F.least(F.col(col), F.lit(float(upper)))
    clipped = df.select(x.alias("x")).filter(F.col("x").isNotNull())
    span = clipped.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    rows = clipped.withColumn("s", span)
    width = (F.col("s.hi") - F.col("s.lo")) / bins
    no = F.least(F.floor((F.col("x") - F.col("s.lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    return rows.groupBy(F.coalesce(no, F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def base_frame(entries: DataFrame, payoffs: DataFrame) -> DataFrame:
    """Entries with their win and place payouts; a missing payout is 0.

    One aggregation turns the payoff rows of single runners into one row per entry, so the entries are joined once.
    """
    single = payoffs.filter(F.col("bet_type").isin(S.WIN, S.PLACE)).select(
        RACE, F.col("combination").try_cast("int").alias(ENTRY), "bet_type", payout_value("payout").alias("v"))
    per = single.filter(F.col(ENTRY).isNotNull()).groupBy(RACE, ENTRY).agg(
        F.max(F.when(F.col("bet_type") == S.WIN, F.col("v"))).alias("win_payout"),
        F.max(F.when(F.col("bet_type") == S.PLACE, F.col("v"))).alias("place_payout"))
    ranked = entries.withColumn("popularity", to_number("popularity").cast("int")).filter(F.col("popularity").isNotNull())
    out = ranked.join(per, [RACE, ENTRY], "left").fillna(0.0, subset=["win_payout", "place_payout"])
    return out.withColumn("popularity_tier", tiers.pop_tier("popularity"))


def valid_categories(base: DataFrame, courses: Sequence[str] = tuple(S.COURSES),
                     tracks: Sequence[str] = tuple(S.TRACK_CONDITIONS)) -> DataFrame:
    return base.filter(F.col("course_type").isin(list(courses)) & F.col("track_condition").isin(list(tracks)))


def percent(payout: Column, n: Column) -> Column:
    """Payout per stake of 100 in percent to one place, halves up: counted in cents, so that no sum decides a half."""
    cents = F.sum(F.round(payout * 100).cast("long"))
    return F.call_function("div", 20 * cents + 100 * n, F.nullif(200 * n, F.lit(0))) / 10


def recovery_by(entries: DataFrame, payoffs: DataFrame, by: str = "popularity", bet: str = S.WIN,
                min_n: int = S.MIN_CELL) -> DataFrame:
    base = base_frame(entries, payoffs)
    pay = "win_payout" if bet == S.WIN else "place_payout"
    n = F.count(F.lit(1))
    out = base.groupBy(by).agg(n.alias("n"), F.sum(pay).alias("total_payout"), percent(F.col(pay), n).alias("recovery_rate"))
    return out.filter(F.col("n") >= min_n)


def recovery_pivot(df: DataFrame, axis: str, order: Sequence, payout: str, tier: str = "popularity_tier",
                   names: Sequence[str] | None = None) -> DataFrame:
    """Tier x axis table of recovery (percent) and count, columns in the given order, all four tiers present.

    The pivot is a set of conditional sums in one aggregation over the tier.
    """
    aggs = []
    for value, name in zip(order, names or [str(v) for v in order]):
        here = F.col(axis) == F.lit(value)
        n = F.count_if(here)
        aggs += [percent(F.when(here, F.col(payout)), n).alias(f"recovery_{name}"), n.alias(f"n_{name}")]
    cells = df.groupBy(F.col(tier).alias("tier")).agg(*aggs)
    counts = [f"n_{name}" for name in (names or [str(v) for v in order])]
    return fill_grid(cells, ["tier"], counts, tier=S.POP_TIERS)


AXES: dict[str, tuple] = {
    "course": (lambda: F.col("course_type"), S.COURSES),
    "track": (lambda: F.col("track_condition"), S.TRACK_CONDITIONS),
    "distance": (lambda: tiers.distance_bucket("distance"), S.DISTANCE_BUCKETS),
    "head_count": (lambda: tiers.head_count_bucket("head_count"), S.HEAD_COUNT_BUCKETS),
    "grade": (lambda: tiers.grade_tier(grade_or_name(F.lit(None).cast("string"), "race_name", anchored=True)),
              list(reversed(S.GRADE_TIERS))),
    "bracket": (lambda: F.col("bracket_number").cast("int"), list(range(1, 9))),
    "weight_diff": (lambda: tiers.weight_diff_bucket("horse_weight_diff"), S.WEIGHT_DIFF_BUCKETS),
}


def axis_report(base: DataFrame, axis: str, payout: str = "win_payout", names: Sequence[str] | None = None,
                order: Sequence | None = None) -> DataFrame:
    """Tier x axis table of one of the fixed axes; ``order`` replaces its values, ``names`` its column names."""
    make, values = AXES[axis]
    return recovery_pivot(base.withColumn("__axis", make()), "__axis", order or values, payout, names=names)


def dispersion_report(base: DataFrame, track: str = "良", min_n: int = S.MIN_CELL) -> DataFrame:
    """Good track only: distance band x odds dispersion x tier, win and place recovery of cells with enough rows."""
    good = base.filter((F.col("track_condition") == track) & (F.col("odds") > 0))
    d = dispersion_tier(good.select(RACE, "odds")).select(RACE, F.col("tier").alias("dispersion"))
    rows = good.join(d, RACE).withColumn("distance_band", tiers.distance_bucket("distance"))
    n = F.count(F.lit(1))
    cells = rows.filter(F.col("dispersion").isNotNull()).groupBy("distance_band", "dispersion", "popularity_tier").agg(
        n.alias("n"), percent(F.col("win_payout"), n).alias("win_recovery"), percent(F.col("place_payout"), n).alias("place_recovery"))
    return cells.filter(F.col("n") >= min_n)


def entity_tier_whole(entries: DataFrame, key: str, min_n: int = S.MIN_MOUNTS, labels: Sequence[str] = tuple(S.RATE_TIERS)) -> DataFrame:
    """Equal-count tiers of the whole-period win rate over entities with enough rows."""
    stats = entries.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(key).agg(
        F.count(F.lit(1)).alias("mounts"), F.sum("is_win").alias("wins"))
    stats = stats.filter(F.col("mounts") >= min_n).withColumn("win_rate", F.col("wins") / F.col("mounts"))
    q = len(labels)
    cuts = exact_quantiles(stats, "win_rate", [i / q for i in range(1, q)])
    tier = F.when(F.lit(False), F.lit(None).cast("string"))
    for cut, label in zip(cuts or [], labels):
        tier = tier.when(F.col("win_rate") <= cut, label)
    return stats.withColumn("tier", tier.otherwise(labels[-1]))


def entity_tier_prior(entries: DataFrame, key: str, min_n: int, lo: float, hi: float) -> DataFrame:
    """Entries with ``tier_prior`` from the entity's win rate before the day."""
    rated = asof_rate(entries, key)
    return rated.withColumn("tier_prior", tiers.rate_tier("prior_win_rate", "prior_mounts", min_n, lo, hi))


def rest_days(entries: DataFrame) -> DataFrame:
    out = Keyed.of(entries, [HORSE], ORDER).look_back({"rest_days": lag_days()}, 1).result()
    return out.withColumn("rest_bucket", tiers.rest_days_bucket("rest_days"))


def rest_days_report(base: DataFrame, payout: str = "win_payout", names: Sequence[str] | None = None) -> DataFrame:
    return recovery_pivot(rest_days(base), "rest_bucket", S.REST_DAYS_BUCKETS, payout, names=names)
