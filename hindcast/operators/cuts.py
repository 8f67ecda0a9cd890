"""Point-in-time features under several history cuts at once.

A cut says that rows before its day do not exist. Rows of a key are ordered by day, so what a window sees after a cut is what it
sees of the rows that the cut leaves: every feature of a cut is the same window over values masked by the cut's day. All cuts
share the windows, and so the shuffles and sorts, of one run; a cut only adds columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date as Date
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast import schema as S
from hindcast.functions.tiers import band
from hindcast.operators.history import COND, DATE, HORSE, MEASURES, ORDER, daily_prior, race_measures, rate_sums, side_by_side
from hindcast.operators.keyed import Keyed, hot_keys
from hindcast.operators.race import ENTRY, RACE, pace

KEY = [RACE, ENTRY]


def history_cuts(anchor: Date, years: Sequence[int | None] = tuple(S.HISTORY_YEARS)) -> dict[str, Date | None]:
    """First day of each history length before ``anchor``; ``all`` has none."""
    return {"all" if y is None else str(y): None if y is None else anchor - timedelta(days=365 * y) for y in years}


def _kept(first: Date | None, value: Column) -> Column:
    return value if first is None else F.when(F.col(DATE) >= F.lit(first), value)


def _name(feature: str, cut: str) -> str:
    return f"{feature}__{cut}"


def _lags(cuts: Mapping[str, Date | None]) -> dict:
    """Differences to the row before, if the cut leaves it."""
    now = {"days_since_last_race": DATE, "distance_change": "distance", "class_change": "class_level", "course_type_change": "course_type",
           "jockey_change": "jockey_id"}

    def expr(feature: str, col: str, first: Date | None):
        def over(w):
            before = F.lag(_kept(first, F.struct(F.col(col).alias("v")))).over(w)["v"]
            if feature == "days_since_last_race":
                return F.datediff(F.col(col), before).cast("double")
            if feature in ("course_type_change", "jockey_change"):
                return F.when(before.isNotNull(), (~F.col(col).eqNullSafe(before)).cast("double"))
            return (F.col(col) - before).cast("double")
        return over

    return {_name(f, k): expr(f, c, first) for f, c in now.items() for k, first in cuts.items()}


def _last(col: str, n: int, first: Date | None, fn=F.avg):
    return lambda w: fn(_kept(first, F.col(col))).over(w.rowsBetween(-n, -1))


def _recent(cuts: Mapping[str, Date | None], cond: bool) -> dict:
    """Means of the measures and the best position over the last 3 and 5 rows that the cut leaves."""
    out, tail = {}, "_cond" if cond else ""
    for k, first in cuts.items():
        for n in (3, 5):
            for col, stem in MEASURES.items():
                if not (cond and stem == "avg_speed_index"):
                    out[_name(f"{stem}_last{n}{tail}", k)] = _last(col, n, first)
            out[_name(f"best_finish_last{n}{tail}", k)] = _last("finishing_position", n, first, F.min)
    return out


def _paces(df: DataFrame, cuts: Mapping[str, Date | None], hot) -> DataFrame:
    """The pace of a race follows from its runners' recent corners. These are taken from a few columns once more, so that the wide
    rows need not go to their races."""
    corners = {_name("avg_corner_last3", k): _last("first_corner_pos", 3, first) for k, first in cuts.items()}
    rows = Keyed.of(df.select(*KEY, DATE, HORSE, "first_corner_pos"), [HORSE], ORDER, hot).look_back(corners, 3).result().select(*KEY, *corners)
    names = ("corner_style_race_rank", "race_leader_count")
    for k in cuts:
        ranked = pace(rows.withColumnRenamed(_name("avg_corner_last3", k), "avg_corner_last3"))
        rows = ranked.withColumnsRenamed({c: _name(c, k) for c in names}).drop("avg_corner_last3")
    return rows


def _running_rate(df: DataFrame, keys: Sequence[str], col: str, out: str, cuts: Mapping[str, Date | None], hot) -> DataFrame:
    sums = {}
    for k, first in cuts.items():
        x = _kept(first, F.col(col).cast("double"))
        sums |= {f"__n_{k}": F.when(x.isNotNull(), 1).otherwise(0).cast("long"), f"__s_{k}": x}
    rows = Keyed.of(df, keys, ORDER, hot).running(sums).result()
    return rows.select(*KEY, *[(F.col(f"__s_{k}") / F.nullif(F.col(f"__n_{k}"), F.lit(0))).alias(_name(out, k)) for k in cuts])


def _daily(df: DataFrame, keys: Sequence[str], col: str, cuts: Mapping[str, Date | None]) -> DataFrame:
    """Totals ``n_<cut>`` and ``s_<cut>`` before each day of a key, joined to the entries."""
    sums: dict[str, Column] = {}
    for k, first in cuts.items():
        masked = rate_sums(f"n_{k}", f"s_{k}", col)
        sums |= {n: F.coalesce(_kept(first, e), F.lit(0)) for n, e in masked.items()}
    return df.select(*KEY, DATE, *keys).join(daily_prior(df, keys, sums), [*keys, DATE], "left")


def cut_features(df: DataFrame, cuts: Mapping[str, Date | None]) -> DataFrame:
    """Cleaned entries with every feature of :func:`history.training_features` for every cut, as ``<feature>__<cut>``.

    A row's columns of a cut count for rows from the cut's day on; they equal those of the features computed from these
    rows alone (base rates over the whole frame that the cut leaves).
    """
    base = race_measures(df)
    facts = df.select(*KEY, DATE, HORSE, "jockey_id", "trainer_id", "owner", "sire", "venue", "course_type", "distance", "bracket_number",
                      "finishing_position", "is_win", "is_placed").withColumn("__band", band("distance"))
    venue = ["jockey_id", "venue", "course_type"]
    brackets = ["bracket_number", "__band"]
    hot = hot_keys(facts, {"horse": [HORSE], "venue": venue, "trainer": ["trainer_id"], "bracket": brackets})
    keyed = Keyed.of(base, [HORSE], ORDER, hot["horse"]).look_back(_lags(cuts) | _recent(cuts, False), 5)
    wide = keyed.look_back(_recent(cuts, True), 5, within=COND).result()
    trainer = Keyed.of(facts, ["trainer_id"], ORDER, hot["trainer"]).look_back(
        {_name("trainer_win_rate_last30", k): _last("is_win", 30, first) for k, first in cuts.items()}, 30).result()
    parts = [_paces(df, cuts, hot["horse"]),
             _running_rate(facts, venue, "is_win", "jockey_win_rate_venue_cond", cuts, hot["venue"]),
             trainer.select(*KEY, *[_name("trainer_win_rate_last30", k) for k in cuts]),
             _running_rate(facts, brackets, "finishing_position", "bracket_distance_avg_finish", cuts, hot["bracket"])]
    for key, prefix in (("trainer_id", "trainer_prior"), ("jockey_id", "jockey_prior"), ("owner", "owner_prior")):
        rows = _daily(facts, [key], "is_win", cuts)
        cols = []
        for k in cuts:
            n = F.col(f"n_{k}")
            cols += [n.cast("double").alias(_name(f"{prefix}_mounts", k)), (F.col(f"s_{k}") / F.nullif(n, F.lit(0))).alias(_name(f"{prefix}_win_rate", k))]
        parts.append(rows.select(*KEY, *cols))
    rates = facts.agg(*[F.avg(_kept(first, F.col("is_placed"))).alias(k) for k, first in cuts.items()]).first()
    sire = _daily(facts, ["sire", "course_type"], "is_placed", cuts)
    cols = []
    for k in cuts:
        n = F.col(f"n_{k}")
        rate = (F.col(f"s_{k}") + S.K_PLACE * F.lit(rates[k])) / (n + S.K_PLACE)
        cols += [rate.alias(_name("sire_place_rate_cond", k)), n.cast("double").alias(_name("sire_progeny_mounts_cond", k))]
    parts.append(sire.select(*KEY, *cols))
    speed = _daily(base.select(*KEY, DATE, "sire", "course_type", "race_time_zscore"), ["sire", "course_type"], "race_time_zscore", cuts)
    parts.append(speed.select(*KEY, *[(F.col(f"s_{k}") / (F.col(f"n_{k}") + S.K_SPEED)).alias(_name("sire_avg_speed_index_cond", k)) for k in cuts]))
    return wide.join(side_by_side(parts, KEY).hint("merge"), KEY, "left")


def of_cut(wide: DataFrame, cut: str, first: Date | None) -> DataFrame:
    """The rows that a cut leaves, with its features under their plain names."""
    own = {c: c[:-len(cut) - 2] for c in wide.columns if c.endswith(f"__{cut}")}
    plain = [c for c in wide.columns if "__" not in c]
    rows = wide if first is None else wide.filter(F.col(DATE) >= F.lit(first))
    return rows.select(*[c for c in plain if c not in own.values()], *[F.col(f"`{c}`").alias(n) for c, n in own.items()])
