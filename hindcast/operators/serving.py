"""Point-in-time features, serving view: the state of every entity strictly before the day of an upcoming entry.

All functions take many upcoming races at once. Nothing later than the upcoming day, and nothing of that day, is
read, so the same call backfills past races without leaking.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date as Date

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from hindcast import schema as S
from hindcast.functions.clean import prev_deltas
from hindcast.functions.tiers import band
from hindcast.operators.history import COND, DATE, HORSE, MEASURES, ORDER, daily_prior, race_measures, rate_sums
from hindcast.operators.keyed import Keyed
from hindcast.operators.race import ENTRY, RACE, pace, zscore

KEY = [RACE, ENTRY]


def targets_of(upcoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    return upcoming.dropna(subset=[*keys, DATE]).select(*keys, F.col(DATE).alias("as_of")).distinct()


def asof_state(keyed: Keyed, targets: DataFrame, states: Mapping[str, Callable[[WindowSpec], Column]], rows: int,
               within: Sequence[str] = ()) -> DataFrame:
    """State of a key after its last row before each target day.

    ``states`` are window columns that include the current row. They are kept once per key and day, so finding the
    newest day before a target is a window over calendar days, and targets never multiply the history.
    """
    keys = [*keyed.keys, *within]
    done = keyed.look_back(states, rows, within).result().dropna(subset=[*keys, DATE])
    daily = done.groupBy(*keys, DATE).agg(F.max_by(F.struct(*states), F.struct(RACE, ENTRY)).alias("__s"))
    days = daily.withColumn("__kind", F.lit(1)).unionByName(
        targets.select(*keys, F.col("as_of").alias(DATE), F.lit(0).alias("__kind")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(DATE, "__kind").rowsBetween(Window.unboundedPreceding, -1)
    found = days.withColumn("__s", F.last("__s", ignorenulls=True).over(w)).filter("__kind = 0")
    return found.select(*keys, F.col(DATE).alias("as_of"), "__s.*")


def _through(fn: str, col: str, n: int):
    agg = {"avg": F.avg, "min": F.min}[fn]
    return lambda w: agg(col).over(w.rowsBetween(1 - n, 0))


def _recent_states(cond: bool) -> dict:
    tail = "_cond" if cond else ""
    out = {}
    for n in (3, 5):
        for col, stem in MEASURES.items():
            if not (cond and stem == "avg_speed_index"):
                out[f"{stem}_last{n}{tail}"] = _through("avg", col, n)
        out[f"best_finish_last{n}{tail}"] = _through("min", "finishing_position", n)
    return out


def needed_history(history: DataFrame, upcoming: DataFrame) -> DataFrame:
    """Race measures of the upcoming horses' history: only the races those horses ran in are ranked."""
    horses = upcoming.select(HORSE).dropna().distinct()
    races = history.join(horses, HORSE, "left_semi").select(RACE).distinct()
    return race_measures(history.join(races, RACE, "left_semi")).join(horses, HORSE, "left_semi")


PREVIOUS = {"prev_distance": "distance", "prev_course_type": "course_type", "prev_jockey_id": "jockey_id",
            "prev_class_level": "class_level", "prev_race_date": DATE}


def serve_latest_state(history: DataFrame, upcoming: DataFrame) -> DataFrame:
    """Per upcoming entry: last 3/5 statistics, the same under its course and distance, and the previous run."""
    cols = [RACE, ENTRY, HORSE, DATE, *[c for c in PREVIOUS.values() if c != DATE], *MEASURES]
    h = needed_history(history, upcoming).select(*cols)
    keyed = Keyed.of(h, [HORSE], ORDER)
    now = {name: (lambda c: lambda w: F.last(c).over(w.rowsBetween(0, 0)))(c) for name, c in PREVIOUS.items()}
    state = asof_state(keyed, targets_of(upcoming, [HORSE]), {**_recent_states(False), **now}, 5)
    ck = [HORSE, *COND]
    cond = asof_state(keyed, targets_of(upcoming, ck), _recent_states(True), 5, within=COND)
    up = upcoming.withColumn("as_of", F.col(DATE))
    return up.join(state, [HORSE, "as_of"], "left").join(cond, [*ck, "as_of"], "left").drop("as_of")


def sums_before(history: DataFrame, targets: DataFrame, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Totals of the key's history before each target day.

    The targets join the daily totals as empty days; one window then answers every target without a range join.
    """
    names = list(sums)
    facts = history.dropna(subset=[*keys, DATE]).select(*keys, DATE, *[e.alias(n) for n, e in sums.items()])
    empty = targets.select(*keys, F.col("as_of").alias(DATE), *[F.lit(0).cast("double").alias(n) for n in names])
    casted = facts.select(*keys, DATE, *[F.col(n).cast("double").alias(n) for n in names])
    prior = daily_prior(casted.unionByName(empty), keys, {n: F.col(n) for n in names})
    return targets.join(prior.withColumnRenamed(DATE, "as_of"), [*keys, "as_of"])


def rate_before(history: DataFrame, targets: DataFrame, keys: str | Sequence[str], flag: str = "is_win",
                prefix: str = "prior") -> DataFrame:
    """Lifetime rate and count of trainer, jockey, owner or any key before each target day."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    t = sums_before(history, targets, keys, rate_sums("__n", "__s", flag))
    return t.select(*keys, "as_of", (F.col("__s") / F.nullif(F.col("__n"), F.lit(0.0))).alias(f"{prefix}_win_rate"),
                    F.col("__n").alias(f"{prefix}_mounts"))


def venue_rate(history: DataFrame, upcoming: DataFrame, cutoff: Date | None = None) -> DataFrame:
    """Jockey win rate at the venue and course, as of each upcoming day, or once for a cutoff day."""
    keys = ["jockey_id", "venue", "course_type"]
    if cutoff is not None:
        past = history.filter(F.col(DATE) < F.lit(cutoff)).join(upcoming.select(*keys).dropna().distinct(), keys, "left_semi")
        return past.groupBy(*keys).agg(F.avg("is_win").alias("jockey_win_rate_venue_cond"))
    t = sums_before(history, targets_of(upcoming, keys), keys, rate_sums("__n", "__s", "is_win"))
    rate = (F.col("__s") / F.nullif(F.col("__n"), F.lit(0.0))).alias("jockey_win_rate_venue_cond")
    return t.select(*keys, "as_of", rate)


def last_k_rate(history: DataFrame, targets: DataFrame, key: str = "trainer_id", k: int = 30, flag: str = "is_win",
                out: str = "trainer_win_rate_last30") -> DataFrame:
    """Rate over the newest k rows of the key before each target day."""
    h = history.select(RACE, ENTRY, HORSE, DATE, key, flag)
    h = h.join(targets.select(key).distinct(), key, "left_semi")
    return asof_state(Keyed.of(h, [key], ORDER), targets, {out: _through("avg", flag, k)}, k)


def global_rate_before(history: DataFrame, days: DataFrame, flag: str = "is_placed", out: str = "global_place_rate") -> DataFrame:
    """Rate over everything before each day of ``days(as_of)``; 0 when there is nothing before."""
    one = days.select(F.lit(0).alias("__k"), "as_of").distinct()
    t = sums_before(history.withColumn("__k", F.lit(0)), one, ["__k"], rate_sums("__n", "__s", flag))
    return t.select("as_of", F.coalesce(F.col("__s") / F.nullif(F.col("__n"), F.lit(0.0)), F.lit(0.0)).alias(out))


def shrunk_rate_before(history: DataFrame, targets: DataFrame, keys: Sequence[str], flag: str = "is_placed",
                       k: float = S.K_PLACE) -> DataFrame:
    keys = list(keys)
    base = global_rate_before(history, targets.select("as_of"), flag, "__m")
    t = sums_before(history, targets, keys, rate_sums("__n", "__s", flag)).join(base, "as_of")
    return t.select(*keys, "as_of", ((F.col("__s") + k * F.col("__m")) / (F.col("__n") + k)).alias("sire_place_rate_cond"),
                    F.col("__n").alias("sire_progeny_mounts_cond"))


def shrunk_mean_before(history: DataFrame, targets: DataFrame, keys: Sequence[str], col: str = "race_time_zscore",
                       k: float = S.K_SPEED) -> DataFrame:
    keys = list(keys)
    t = sums_before(history, targets, keys, rate_sums("__n", "__s", col))
    return t.select(*keys, "as_of", (F.col("__s") / (F.col("__n") + k)).alias("sire_avg_speed_index_cond"))


def bracket_mean(history: DataFrame, targets: DataFrame) -> DataFrame:
    """Mean position by bracket and distance band before each target day; targets carry ``bracket_number, band``."""
    h = history.withColumn("band", band("distance", bounds=None))
    t = sums_before(h, targets, ["bracket_number", "band"], rate_sums("__n", "__s", "finishing_position"))
    return t.select("bracket_number", "band", "as_of",
                    (F.col("__s") / F.nullif(F.col("__n"), F.lit(0.0))).alias("bracket_distance_avg_finish"))


#: Totals that the serving features need: name -> (keys, summed column).
TOTALS = {
    "venue": (("jockey_id", "venue", "course_type"), "is_win"),
    "trainer": (("trainer_id",), "is_win"),
    "jockey": (("jockey_id",), "is_win"),
    "owner": (("owner",), "is_win"),
    "progeny": (("sire", "course_type"), "is_placed"),
    "bracket": (("bracket_number", "band"), "finishing_position"),
}
SPEED = {"speed": (("sire", "course_type"), "race_time_zscore")}


def _by_kind(df: DataFrame, kinds: Mapping[str, tuple[Sequence[str], str]], summed: bool, *keep: Column) -> DataFrame:
    """A row for each row of ``df`` and kind whose keys it has: ``kind``, ``key``, the day, ``n`` and ``s`` (0 if not
    ``summed``) and ``keep``."""
    items = []
    for kind, (keys, col) in kinds.items():
        known = F.col(DATE).isNotNull()
        for k in keys:
            known = known & F.col(k).isNotNull()
        sums = rate_sums("n", "s", col) if summed else {"n": F.lit(0), "s": F.lit(0)}
        items.append(F.when(known, F.struct(F.lit(kind).alias("kind"), F.array(*[F.col(k).cast("string") for k in keys]).alias("key"),
                                            *[e.cast("double").alias(n) for n, e in sums.items()])))
    return df.select(DATE, *keep, F.explode(F.array_compact(F.array(*items))).alias("x")).select("x.*", DATE, *[F.col(c) for c in df.select(*keep).columns])


def totals_before(facts: Sequence[tuple[DataFrame, Mapping[str, tuple[Sequence[str], str]]]], upcoming: DataFrame) -> DataFrame:
    """``upcoming`` with a column ``__<kind>`` for each kind of ``facts``: (n, s) of the entry's key before its day, null
    where a part of the key or the day is.

    Each frame of ``facts`` is read once for all its kinds; rows are combined per (kind, key, day) before the one shuffle,
    the days asked for join as empty ones, and one window over calendar days answers all kinds. Entries that agree in
    every key share their totals, so repeated entries stay as they are.
    """
    kinds = {kind: spec for _, some in facts for kind, spec in some.items()}
    ident = list(dict.fromkeys([*KEY, DATE, *[k for keys, _ in kinds.values() for k in keys]]))
    up = upcoming.withColumn("__id", F.struct(*ident))
    asked = _by_kind(up.select(*ident, "__id").distinct(), kinds, False, F.col("__id"))
    rows = asked.drop("__id")
    for df, some in facts:
        rows = rows.unionByName(_by_kind(df, some, True))
    prior = daily_prior(rows, ["kind", "key"], {"n": F.col("n"), "s": F.col("s")})
    found = asked.select("__id", "kind", "key", DATE).join(prior, ["kind", "key", DATE])
    one = found.groupBy("__id").agg(*[F.max(F.when(F.col("kind") == kind, F.struct("n", "s"))).alias(f"__{kind}") for kind in kinds])
    return up.join(one, "__id", "left").drop("__id")


def serve_assemble(history: DataFrame, upcoming: DataFrame, odds: DataFrame | None = None) -> DataFrame:
    """All serving features of the upcoming entries; the sire columns fall back to base rate, 0 and 0."""
    up = upcoming.withColumn("band", band("distance", bounds=None))
    speed = history.join(up.select("sire").dropna().distinct(), "sire", "left_semi").select(RACE).distinct()
    timed = history.join(speed, RACE, "left_semi").select(
        DATE, "sire", "course_type", zscore("finish_time_sec", invert=True).alias("race_time_zscore"))
    wide = totals_before([(history.withColumn("band", band("distance", bounds=None)), TOTALS), (timed, SPEED)], up)
    n, total = (lambda kind: F.col(f"__{kind}.n")), (lambda kind: F.col(f"__{kind}.s"))
    rate = lambda kind: total(kind) / F.nullif(n(kind), F.lit(0.0))
    out = {"jockey_win_rate_venue_cond": rate("venue"), "bracket_distance_avg_finish": rate("bracket")}
    for kind in ("trainer", "jockey", "owner"):  # no history: no row, as a grouped query would give
        out |= {f"{kind}_prior_win_rate": rate(kind), f"{kind}_prior_mounts": F.when(n(kind) > 0, n(kind))}
    out |= {
        "sire_place_rate_cond": F.coalesce((total("progeny") + S.K_PLACE * F.col("__base")) / (n("progeny") + S.K_PLACE), "__base"),
        "sire_progeny_mounts_cond": F.coalesce(n("progeny"), F.lit(0.0)),
        "sire_avg_speed_index_cond": F.coalesce(total("speed") / (n("speed") + S.K_SPEED), F.lit(0.0)),
    }
    base = global_rate_before(history, up.select(F.col(DATE).alias("as_of")), out="__base")
    wide = wide.join(base.withColumnRenamed("as_of", DATE), DATE, "left").withColumns(out)
    wide = serve_latest_state(history, wide.drop("band", "__base", *[f"__{kind}" for kind in (*TOTALS, *SPEED)])).withColumn("as_of", F.col(DATE))
    last = last_k_rate(history, targets_of(up, ["trainer_id"]))
    wide = wide.join(last, ["trainer_id", "as_of"], "left")
    if odds is not None:
        wide = wide.join(odds.select(*KEY, "win_odds"), KEY, "left")
    wide = wide.drop("as_of").withColumn("class_change", F.col("class_level") - F.col("prev_class_level"))
    return pace(prev_deltas(wide.drop("prev_class_level")))
