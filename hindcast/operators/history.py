"""Point-in-time features, training view: no row ever sees itself or anything later.

Row order inside a key is ``date, race_id, horse_id, horse_number``; it is total, so results do not depend on the
physical order of the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast import schema as S
from hindcast.functions.clean import _c
from hindcast.functions.tiers import band
from hindcast.operators.keyed import Keyed, hot_keys
from hindcast.operators.race import ENTRY, RACE, pace, rank_keep, zscore

DATE, HORSE = "date", "horse_id"
ORDER = [DATE, RACE, HORSE, ENTRY]
COND = ["course_type", "distance"]
# measure -> feature stem
MEASURES = {
    "finishing_position": "avg_finish",
    "last_3f": "avg_last3f",
    "first_corner_pos": "avg_corner",
    "last_3f_rank": "avg_last3f_rank",
    "race_time_zscore": "avg_speed_index",
}


def race_measures(df: DataFrame) -> DataFrame:
    """Race-relative measures that the histories average: one window stage on the race key."""
    return df.withColumns({
        "horse_weight_relative": zscore("horse_weight"),
        "weight_carried_relative": zscore("weight_carried"),
        "last_3f_rank": rank_keep("last_3f"),
        "race_time_zscore": zscore("finish_time_sec", invert=True),
    })


# ---- previous row -------------------------------------------------------------------------------------------------

def lag_days(date: str = DATE):
    return lambda w: F.datediff(F.col(date), F.lag(date).over(w)).cast("double")


def lag_diff(col: str):
    return lambda w: (F.col(col) - F.lag(col).over(w)).cast("double")


def lag_changed(col: str):
    def expr(w):
        prev = F.lag(col).over(w)
        return F.when(prev.isNotNull(), (~F.col(col).eqNullSafe(prev)).cast("double"))
    return expr


LAGS = {
    "days_since_last_race": lag_days(),
    "distance_change": lag_diff("distance"),
    "class_change": lag_diff("class_level"),
    "course_type_change": lag_changed("course_type"),
    "jockey_change": lag_changed("jockey_id"),
}


def lag_features(df: DataFrame, entity: str = HORSE) -> DataFrame:
    return Keyed.of(df, [entity], ORDER).look_back(LAGS, 1).result()


# ---- last n rows --------------------------------------------------------------------------------------------------

def mean_last(col: str, n: int):
    return lambda w: F.avg(col).over(w.rowsBetween(-n, -1))


def min_last(col: str, n: int):
    return lambda w: F.min(col).over(w.rowsBetween(-n, -1))


def recent_exprs(sizes: Sequence[int] = (3, 5), cond: bool = False) -> dict:
    """Means of the measures and the best position over the last 3 and 5 rows; no speed index per condition."""
    out = {}
    tail = "_cond" if cond else ""
    for n in sizes:
        for col, stem in MEASURES.items():
            if cond and stem == "avg_speed_index":
                continue
            out[f"{stem}_last{n}{tail}"] = mean_last(col, n)
        out[f"best_finish_last{n}{tail}"] = min_last("finishing_position", n)
    return out


def rolling(df: DataFrame, keys: Sequence[str], cols: Sequence[str], n: int,
            fns: Sequence[str] = ("avg",)) -> DataFrame:
    """``<fn>_<col>_last<n>`` over the n rows before, for any keys and columns."""
    kinds = {"avg": mean_last, "min": min_last}
    exprs = {f"{fn}_{c}_last{n}": kinds[fn](c, n) for c in cols for fn in fns}
    return Keyed.of(df, keys, ORDER).look_back(exprs, n).result()


# ---- running rates, current row excluded --------------------------------------------------------------------------

def cum_rate(df: DataFrame, keys: Sequence[str], flag: str, out: str, hot=None) -> DataFrame:
    """Mean of ``flag`` over all earlier rows of the key; null on the first."""
    flagged = F.when(F.col(flag).isNotNull(), 1).otherwise(0).cast("long")
    keyed = Keyed.of(df, keys, ORDER, hot).running({"__n": flagged, out: F.col(flag).cast("double")})
    return keyed.result().withColumn(out, F.col(out) / F.nullif(F.col("__n"), F.lit(0))).drop("__n")


def bracket_cum_mean(df: DataFrame, hot=None, out: str = "bracket_distance_avg_finish") -> DataFrame:
    """Mean position by bracket and distance band over earlier rows. Few, huge keys: lanes split each of them."""
    banded = df.withColumn("__band", band("distance"))
    return cum_rate(banded, ["bracket_number", "__band"], "finishing_position", out, hot).drop("__band")


def last_rate(df: DataFrame, key: str, flag: str, n: int, out: str, hot=None) -> DataFrame:
    return Keyed.of(df, [key], ORDER, hot).look_back({out: mean_last(flag, n)}, n).result()


# ---- as-of statistics, the whole day excluded ---------------------------------------------------------------------

def daily_prior(df: DataFrame, keys: Sequence[str], sums: dict[str, Column], date: str = DATE) -> DataFrame:
    """Totals before each day of a key: one row per key and day.

    Rows are combined per (key, day) before the shuffle, so the window sees at most one row per calendar day of a
    key, however many rows the key holds.
    """
    daily = df.dropna(subset=[*keys, date]).groupBy(*keys, date).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    return daily.select(*keys, date, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sums])


def rate_sums(n: str, s: str, flag: str) -> dict[str, Column]:
    x = F.col(flag).cast("double")
    return {n: F.when(x.isNotNull(), 1).otherwise(0).cast("long"), s: F.coalesce(x, F.lit(0.0))}


def asof_rate(df: DataFrame, keys: str | Sequence[str], flag: str = "is_win", date: str = DATE,
              prefix: str = "prior") -> DataFrame:
    """Lifetime rate and row count before the day: ``<prefix>_win_rate``, ``<prefix>_mounts``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    n, s = f"{prefix}_mounts", "__s"
    prior = daily_prior(df, keys, rate_sums(n, s, flag), date)
    prior = prior.select(*keys, date, F.col(n).cast("double").alias(n),
                         (F.col(s) / F.nullif(F.col(n), F.lit(0))).alias(f"{prefix}_win_rate"))
    return df.join(prior, [*keys, date], "left")


def asof_shrunk_rate(df: DataFrame, keys: Sequence[str], flag: str = "is_placed", k: float = S.K_PLACE,
                     prior: str = "global", date: str = DATE, out: str = "sire_place_rate_cond",
                     out_n: str = "sire_progeny_mounts_cond") -> DataFrame:
    """Rate before the day, pulled toward a base rate by ``k`` pseudo rows.

    ``prior='global'`` uses the rate of the whole frame, ``prior='asof'`` the rate of all earlier days.
    """
    stats = daily_prior(df, keys, rate_sums(out_n, "__s", flag), date)
    if prior == "global":
        base = df.agg(F.avg(flag).alias("m")).scalar()
        stats = stats.withColumn("__m", base)
    else:
        days = df.dropna(subset=[date]).groupBy(date).agg(F.count(flag).alias("n"), F.sum(flag).alias("s"))
        w = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)  # one row per calendar day
        days = days.select(date, F.coalesce(F.sum("s").over(w) / F.sum("n").over(w), F.lit(0.0)).alias("__m"))
        stats = stats.join(days, date)
    rate = (F.col("__s") + k * F.col("__m")) / (F.col(out_n) + k)
    stats = stats.select(*keys, date, rate.alias(out), F.col(out_n).cast("double").alias(out_n))
    return df.join(stats, [*keys, date], "left")


def asof_shrunk_mean(df: DataFrame, keys: Sequence[str], col: str = "race_time_zscore", k: float = S.K_SPEED,
                     date: str = DATE, out: str = "sire_avg_speed_index_cond") -> DataFrame:
    """Mean of the non-null values before the day, pulled toward 0 by ``k`` pseudo rows."""
    x = F.col(col).cast("double")
    stats = daily_prior(df, keys, {"__n": F.when(x.isNotNull(), 1).otherwise(0), "__s": F.coalesce(x, F.lit(0.0))},
                        date)
    stats = stats.select(*keys, date, (F.col("__s") / (F.col("__n") + k)).alias(out))
    return df.join(stats, [*keys, date], "left")


# ---- weights, feature list ----------------------------------------------------------------------------------------

def decay_weight(date: Column | str, ref: Column | str, half_life: float) -> Column:
    """1 at the reference day, halved every ``half_life`` days before it."""
    return F.pow(F.lit(0.5), F.datediff(_c(ref), _c(date)) / F.lit(float(half_life)))


def feature_columns(extra: Sequence[str] = (), drop: Sequence[str] = ()) -> list[str]:
    """Model inputs. The regional run drops class_level, class_change and grade."""
    race = ["venue", "course_type", "distance", "direction", "weather", "track_condition", "grade", "head_count",
            "is_handicap", "class_level"]
    entry = [ENTRY, "bracket_number", "sex", "age", "weight_carried", "weight_carried_relative", "horse_weight",
             "horse_weight_diff", "horse_weight_relative"]
    recent = [*recent_exprs(), *recent_exprs(cond=True)]
    pacing = ["corner_style_race_rank", "race_leader_count"]
    blood = ["sire", "broodmare_sire", "sire_place_rate_cond", "sire_progeny_mounts_cond",
             "sire_avg_speed_index_cond"]
    people = ["jockey_win_rate_venue_cond", "jockey_prior_win_rate", "jockey_prior_mounts",
              "trainer_win_rate_last30", "trainer_prior_win_rate", "trainer_prior_mounts", "owner_prior_win_rate",
              "owner_prior_mounts", "jockey_id", "trainer_id", "bracket_distance_avg_finish"]
    every = [*race, *entry, *LAGS, *recent, *pacing, *blood, *people, *extra]
    return [c for c in every if c not in set(drop)]


# ---- all of it ----------------------------------------------------------------------------------------------------

def training_features(df: DataFrame, prior: str = "global") -> DataFrame:
    """Every feature above for cleaned entries.

    The wide rows move four times: for the race measures, the horse windows, the pace of the race and one join on the
    entry key. Every other history runs on narrow projections. Give a stored (or checkpointed) frame when the cleaning is
    costly, because each history reads its own few columns of it.
    """
    key = [RACE, ENTRY]
    base = race_measures(df)
    facts = df.select(*key, DATE, HORSE, "jockey_id", "trainer_id", "owner", "sire", "venue", "course_type",
                      "distance", "bracket_number", "finishing_position", "is_win", "is_placed")
    banded = facts.withColumn("__band", band("distance"))
    venue_key = ["jockey_id", "venue", "course_type"]
    hot = hot_keys(banded, {"horse": [HORSE], "venue": venue_key, "trainer": ["trainer_id"],
                            "bracket": ["bracket_number", "__band"]})
    keyed = Keyed.of(base, [HORSE], ORDER, hot["horse"]).look_back({**LAGS, **recent_exprs()}, 5)
    wide = pace(keyed.look_back(recent_exprs(cond=True), 5, within=COND).result())

    sire = ["sire", "course_type"]
    narrow = [
        cum_rate(facts, venue_key, "is_win", "jockey_win_rate_venue_cond", hot["venue"]),
        last_rate(facts, "trainer_id", "is_win", 30, "trainer_win_rate_last30", hot["trainer"]),
        bracket_cum_mean(facts, hot["bracket"]),
        asof_rate(facts, "trainer_id", prefix="trainer_prior"),
        asof_rate(facts, "jockey_id", prefix="jockey_prior"),
        asof_rate(facts, "owner", prefix="owner_prior"),
        asof_shrunk_rate(facts, sire, prior=prior),
        asof_shrunk_mean(base.select(*key, DATE, *sire, "race_time_zscore"), sire),
    ]
    known = set(facts.columns) | {"race_time_zscore"}
    parts = [part.select(*key, *[c for c in part.columns if c not in known]) for part in narrow]
    return wide.join(side_by_side(parts, key).hint("merge"), key, "left")


def side_by_side(parts: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Feature frames that all hold one row per entry, side by side. The narrow frames meet each other first, so the
    wide rows take part in a single join; all of these joins share one partitioning and sort order. Frames of the
    entry grain grow with the data, so they are merged and never broadcast, whatever their estimated size."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p.hint("merge"), list(key))
    return out
