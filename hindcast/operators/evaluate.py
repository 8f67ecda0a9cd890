"""Backtest metrics. Races are reduced to sufficient statistics first, so later stages see one row per race."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast import schema as S
from hindcast.functions.tiers import grade_tier, odds_tier, pop_tier
from hindcast.operators.bets import fill_grid, merged, payoff_map, pick_races, with_payout
from hindcast.operators.race import ENTRY, RACE
from hindcast.operators.splits import filter_longshot

EPS = 1e-15  # one clip for every log-loss
BIAS_PLACES = 9  # a bias that is zero up to the error of its sum has no direction of its own
METRICS = ["win_accuracy", "recovery_rate", "win_logloss", "place_logloss", "win_brier", "place_brier"]


def nll(y: str, p: str) -> Column:
    """Log-loss of one row; null where the label or the probability is."""
    q = F.least(F.greatest(F.col(p), F.lit(EPS)), F.lit(1 - EPS))
    return F.when(F.col(p).isNotNull() & F.col(y).isNotNull(), -F.when(F.col(y) == 1, F.ln(q)).otherwise(F.ln(1 - q)))


def brier(y: str, p: str) -> Column:
    return (F.col(p) - F.col(y)) * (F.col(p) - F.col(y))


def stat_exprs(win: str = "win_prob", place: str = "place_prob", tail: str = "") -> list[Column]:
    """Aggregates of one race for one model: loss sums, the rows behind each, and the best runner with a probability."""
    return [
        F.sum(nll("is_win", win)).alias(f"nll_win{tail}"), F.sum(nll("is_placed", place)).alias(f"nll_place{tail}"),
        F.sum(brier("is_win", win)).alias(f"se_win{tail}"), F.sum(brier("is_placed", place)).alias(f"se_place{tail}"),
        F.count(nll("is_win", win)).alias(f"n_win{tail}"), F.count(nll("is_placed", place)).alias(f"n_place{tail}"),
        F.max_by(F.struct("is_win", "odds"), F.when(F.col(win).isNotNull(), F.struct(F.col(win), -F.col(ENTRY)))).alias(f"best{tail}"),
    ]


def flat_stats(stats: DataFrame, tails: Sequence[str] = ("",)) -> DataFrame:
    """Hit and return of the best runner as columns; a missing price returns 0."""
    cols = [RACE]
    for t in tails:
        win = F.col(f"best{t}.is_win")
        cols += [f"{c}{t}" for c in ("nll_win", "nll_place", "se_win", "se_place", "n_win", "n_place")]
        back = F.when(win == 1, F.coalesce(f"best{t}.odds", F.lit(0.0))).otherwise(0.0)
        cols += [win.alias(f"hit{t}"), F.when(win.isNotNull(), back).alias(f"ret{t}")]
    return stats.select(*cols)


def race_stats(entries: DataFrame, preds: DataFrame) -> DataFrame:
    """Sufficient statistics of every race for one model."""
    m = entries.select(RACE, ENTRY, "is_win", "is_placed", "odds").join(
        preds.select(RACE, ENTRY, "win_prob", "place_prob"), [RACE, ENTRY])
    return flat_stats(m.groupBy(RACE).agg(*stat_exprs()))


def metrics_of(stats: DataFrame) -> DataFrame:
    wins, places = F.nullif(F.sum("n_win"), F.lit(0)), F.nullif(F.sum("n_place"), F.lit(0))
    return stats.agg(
        F.avg("hit").alias("win_accuracy"), (F.sum("ret") / F.nullif(F.count("hit"), F.lit(0))).alias("recovery_rate"),
        (F.sum("nll_win") / wins).alias("win_logloss"), (F.sum("nll_place") / places).alias("place_logloss"),
        (F.sum("se_win") / wins).alias("win_brier"), (F.sum("se_place") / places).alias("place_brier"))


def evaluate(entries: DataFrame, preds: DataFrame) -> DataFrame:
    """One row with the six metrics."""
    return metrics_of(race_stats(entries, preds))


TIERS = {
    "popularity": (lambda: pop_tier("popularity"), S.POP_TIERS),
    "odds": (lambda: odds_tier("odds"), S.ODDS_TIERS),
    "grade": (lambda: grade_tier("grade"), S.GRADE_TIERS),
}


def by_tier(entries: DataFrame, preds: DataFrame, tier: str) -> DataFrame:
    """Best runner of each race by popularity, odds or grade tier; every tier is present."""
    make, labels = TIERS[tier]
    col = {"popularity": "popularity", "odds": "odds", "grade": "grade"}[tier]
    need = list(dict.fromkeys([RACE, ENTRY, "is_win", "odds", col]))
    m = entries.select(*need).join(preds.select(RACE, ENTRY, "win_prob"), [RACE, ENTRY]).withColumn("tier", make())
    best = F.max_by(F.struct("tier", "is_win", "odds"), F.struct(F.col("win_prob"), -F.col(ENTRY)))
    cells = m.groupBy(RACE).agg(best.alias("b")).select("b.*").groupBy("tier").agg(
        F.count(F.lit(1)).alias("picks"), F.avg("is_win").alias("hit_rate"),
        (F.coalesce(F.sum(F.col("is_win") * F.col("odds")), F.lit(0.0)) / F.count(F.lit(1))).alias("recovery"))
    return fill_grid(cells, ["tier"], ["picks"], tier=labels)


def ev_grid(entries: DataFrame, preds: DataFrame, thresholds: Sequence[float] = tuple(S.EV_THRESHOLDS),
            prob: str = "win_prob") -> DataFrame:
    """All entries whose expected value is above a threshold, by threshold and popularity tier.

    The thresholds are columns, not rows: entries are never multiplied, and the races behind a cell are counted from
    per-race sums instead of a distinct count.
    """
    p = preds.select(RACE, ENTRY, F.col(prob).alias("win_prob"))
    m = merged(entries.select(RACE, ENTRY, "is_win", "odds", "popularity"), p)
    idx = range(len(thresholds))
    sums = []
    for i in idx:
        hit = F.col("ev") > thresholds[i]
        sums += [F.count_if(hit).alias(f"n{i}"), F.sum(F.when(hit, F.col("is_win")).otherwise(0)).alias(f"w{i}"),
                 F.sum(F.when(hit, F.coalesce(F.col("is_win") * F.col("odds"), F.lit(0.0))).otherwise(0.0)).alias(f"r{i}")]
    by_race_tier = m.groupBy(RACE, "tier").agg(*sums)
    names = [f"{a}{i}" for i in idx for a in "nwr"]
    by_race = by_race_tier.groupBy(RACE).agg(*[F.sum(c).alias(c) for c in names]).withColumn("tier", F.lit(S.ALL_TIER))
    total = [F.sum(c).alias(c) for c in names] + [F.count_if(F.col(f"n{i}") > 0).alias(f"c{i}") for i in idx]
    rows = by_race_tier.unionByName(by_race).groupBy("tier").agg(
        *total, F.count_if(F.col("tier") == S.ALL_TIER).alias("races"))
    rows = rows.withColumn("races", F.max("races").over(Window.partitionBy()))  # five rows
    cells = rows.select("tier", "races", F.explode(F.array(*[
        F.struct(F.lit(float(thresholds[i])).alias("threshold"), F.col(f"n{i}").alias("picks"),
                 F.col(f"w{i}").alias("hits"), F.col(f"r{i}").alias("ret"), F.col(f"c{i}").alias("races_hit"))
        for i in idx])).alias("c")).select("tier", "races", "c.*").filter("picks > 0")
    cells = cells.select("threshold", "tier", "picks", "hits", (F.col("hits") / F.col("picks")).alias("hit_rate"),
                         (F.col("ret") / F.col("picks")).alias("recovery"),
                         (F.col("races_hit") / F.col("races")).alias("coverage"))
    return fill_grid(cells, ["threshold", "tier"], ["picks", "hits", "coverage"],
                     threshold=[float(t) for t in thresholds], tier=[S.ALL_TIER, *S.POP_TIERS])


def prob_compare(df: DataFrame, a: str, b: str) -> DataFrame:
    d = F.abs(F.col(b) - F.col(a))
    ok = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return ok.agg(F.avg(d).alias("mean_abs_diff"), F.max(d).alias("max_abs_diff"), F.corr(a, b).alias("correlation"),
                  F.avg(a).alias("mean_win_prob"))


def _curve(m: DataFrame, p: str, y: str, bins: int, model: str) -> DataFrame:
    span = m.agg(F.struct(F.min(p).alias("lo"), F.max(p).alias("hi"))).scalar()
    x = m.select(F.col(p).alias("p"), F.col(y).alias("y"), span.alias("s")).filter(F.col("p").isNotNull())
    width = (F.col("s.hi") - F.col("s.lo")) / bins
    no = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((F.col("p") - F.col("s.lo")) / F.nullif(width, F.lit(0.0)))))
    x = x.withColumns({"bin": F.coalesce(no, F.lit(1)).cast("int"), "lo": F.col("s.lo"), "width": width})
    return x.groupBy("bin").agg(
        F.max(F.col("lo") + (F.col("bin") - 0.5) * F.col("width")).alias("bin_center"), F.avg("p").alias("mean_pred"),
        F.avg("y").alias("actual_rate"), F.count("y").alias("count"),
    ).select(F.lit(model).alias("model"), "*")


def calibration_curve(entries: DataFrame, preds: DataFrame, bins: int = 10) -> DataFrame:
    """Right-closed bins of equal width over the observed range, for the win and the place probability."""
    m = entries.select(RACE, ENTRY, "is_win", "is_placed").join(
        preds.select(RACE, ENTRY, "win_prob", "place_prob"), [RACE, ENTRY])
    return _curve(m, "win_prob", "is_win", bins, "win").unionByName(_curve(m, "place_prob", "is_placed", bins, "place"))


def calibration_bias(curve: DataFrame) -> DataFrame:
    diff = F.col("mean_pred") - F.col("actual_rate")
    w = F.sum("count")
    out = curve.dropna(subset=["mean_pred", "actual_rate"]).groupBy("model").agg(
        (F.sum(diff * F.col("count")) / w).alias("signed_bias"),
        (F.sum(F.abs(diff) * F.col("count")) / w).alias("mean_calib_error"))
    need = (F.abs("signed_bias") > S.BIAS_LIMIT) | (F.col("mean_calib_error") > S.ERROR_LIMIT)
    return out.withColumn("needs_calibration", need).withColumn(
        "direction", F.when(need, F.when(F.round("signed_bias", BIAS_PLACES) > 0, "over").otherwise("under")))


def _summary(bets: DataFrame, bet: str, pay: Column, ok: Column | None = None) -> DataFrame:
    rows = bets if ok is None else bets.filter(ok)
    n = F.count(F.lit(1))
    return rows.agg(n.alias("picks"), F.count(pay).alias("hits"), (F.count(pay) / F.nullif(n, F.lit(0))).alias("hit_rate"),
                    (F.coalesce(F.sum(pay), F.lit(0.0)) / F.nullif(n * 100, F.lit(0))).alias("recovery")
                    ).select(F.lit(bet).alias("bet"), "*")


def multi_bet(entries: DataFrame, preds: DataFrame, payoffs: DataFrame) -> DataFrame:
    """Place (best place probability), quinella (best two) and trio (best three): one bet per race each."""
    m = entries.select(RACE, ENTRY).join(preds.select(RACE, ENTRY, "win_prob", "place_prob"), [RACE, ENTRY])
    races = pick_races(m, (2, 3))
    best_place = m.groupBy(RACE).agg(
        F.max_by(ENTRY, F.struct(F.col("place_prob"), -F.col(ENTRY))).cast("string").alias("combo1"))
    pays = payoff_map(payoffs)
    place = with_payout(best_place, pays, S.PLACE, "combo1")
    quin = with_payout(races.filter("combo2 IS NOT NULL").select(RACE, "combo2"), pays, S.QUINELLA, "combo2")
    trio = with_payout(races.filter("combo3 IS NOT NULL").select(RACE, "combo3"), pays, S.TRIO, "combo3")
    parts = [_summary(place, S.PLACE, F.col("pay")), _summary(quin, S.QUINELLA, F.col("pay")),
             _summary(trio, S.TRIO, F.col("pay"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


BETS = [S.WIN, S.PLACE, S.QUINELLA, S.TRIO]


def ev_bet_grid(entries: DataFrame, preds: DataFrame, payoffs: DataFrame,
                thresholds: Sequence[float] = tuple(S.EV_THRESHOLDS)) -> DataFrame:
    """Threshold x tier x bet type, gated on the best runner of the race only.

    Each race contributes its four bets once; the threshold cells come from conditional sums.
    """
    m = merged(entries.select(RACE, ENTRY, "is_win", "odds", "popularity"),
               preds.select(RACE, ENTRY, "win_prob", "place_prob"))
    races = pick_races(m, (2, 3))
    top = F.col("top")
    win = F.struct(F.lit(S.WIN).alias("bet"), F.lit(None).cast("string").alias("combo"))
    bets = [win, F.struct(F.lit(S.PLACE).alias("bet"), top[ENTRY].cast("string").alias("combo")),
            F.when(F.col("combo2").isNotNull(), F.struct(F.lit(S.QUINELLA).alias("bet"), F.col("combo2").alias("combo"))),
            F.when(F.col("combo3").isNotNull(), F.struct(F.lit(S.TRIO).alias("bet"), F.col("combo3").alias("combo")))]
    rows = races.select(RACE, top["ev"].alias("ev"), top["tier"].alias("tier0"), top["is_win"].alias("is_win"),
                        top["odds"].alias("odds"), F.explode(F.array(*bets)).alias("b")).filter("b IS NOT NULL")
    asked = payoffs.filter(F.col("bet_type").isin(*BETS[1:]))  # before they are added up: a win bet has no combination to look up
    rows = with_payout(rows.select(RACE, "ev", "tier0", "is_win", "odds", "b.bet", "b.combo"), payoff_map(asked),
                       F.col("bet"), "combo")
    own = F.col("bet") == S.WIN
    hit = F.when(own, F.col("is_win")).otherwise(F.col("pay").isNotNull().cast("int"))
    ret = F.when(own, F.coalesce(F.col("is_win") * F.col("odds"), F.lit(0.0))).otherwise(
        F.coalesce(F.col("pay") / 100, F.lit(0.0)))
    sums = []
    for i, t in enumerate(thresholds):
        ok = F.col("ev") > t
        sums += [F.count_if(ok).alias(f"n{i}"), F.sum(F.when(ok, hit).otherwise(0)).alias(f"w{i}"),
                 F.sum(F.when(ok, ret).otherwise(0.0)).alias(f"r{i}")]
    per_tier = rows.groupBy("tier0", "bet").agg(*sums)
    cells = per_tier.select(F.explode(F.array(F.lit(S.ALL_TIER), F.col("tier0"))).alias("tier"), "bet", F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("n"), F.col(f"w{i}").alias("w"),
                 F.col(f"r{i}").alias("r")) for i, t in enumerate(thresholds)])).alias("c"))
    cells = cells.groupBy("c.threshold", "tier", "bet").agg(
        F.sum("c.n").alias("picks"), F.sum("c.w").alias("hits"), F.sum("c.r").alias("ret")).filter("picks > 0")
    cells = cells.select("threshold", "tier", "bet", "picks", "hits", (F.col("hits") / F.col("picks")).alias("hit_rate"),
                         (F.col("ret") / F.col("picks")).alias("recovery"))
    return fill_grid(cells, ["threshold", "tier", "bet"], ["picks", "hits"], threshold=[float(t) for t in thresholds],
                     tier=[S.ALL_TIER, *S.POP_TIERS], bet=BETS)


def fold_summary(rows: DataFrame, metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """Fold rows with a trailing row ``mean``."""
    have = [m for m in metrics if m in rows.columns]
    head = rows.withColumn("fold", F.col("fold").cast("string"))
    tail = rows.agg(*[F.avg(m).alias(m) for m in have]).withColumn("fold", F.lit("mean"))
    return head.unionByName(tail, allowMissingColumns=True)


def fold_pivot(rows: DataFrame, index: Sequence[str], value: str, folds: Sequence) -> DataFrame:
    """Value per index row and fold; the folds are given, so no extra pass looks for them."""
    return rows.groupBy(*index).pivot("fold", list(folds)).agg(F.avg(F.col(value).cast("double")))


def longshot_metrics(entries: DataFrame, preds: DataFrame) -> DataFrame:
    m = filter_longshot(entries.select(RACE, ENTRY, "is_win", "popularity")).join(
        preds.select(RACE, ENTRY, "win_prob"), [RACE, ENTRY]).dropna(subset=["win_prob", "is_win"])
    return m.agg(F.count(F.lit(1)).alias("n"), F.avg(nll("is_win", "win_prob")).alias("win_logloss"),
                 F.avg(brier("is_win", "win_prob")).alias("win_brier"))


def compare(before: DataFrame, after: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Side by side table with the change of every column."""
    a = before.select(*on, *[F.col(c).alias(f"{c}_before") for c in cols])
    b = after.select(*on, *[F.col(c).alias(f"{c}_after") for c in cols])
    out = a.join(b, list(on), "full")
    return out.withColumns({f"{c}_change": F.col(f"{c}_after") - F.col(f"{c}_before") for c in cols})


def metric_rows(one: DataFrame) -> DataFrame:
    """The one-row result of :func:`evaluate` as (metric, value) rows."""
    return one.unpivot([], METRICS, "metric", "value")
