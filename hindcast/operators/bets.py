"""Picks turned into bets, and payoff lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast import schema as S
from hindcast.functions.clean import combo_norm, payout_value
from hindcast.functions.tiers import pop_tier
from hindcast.operators.race import ENTRY, RACE, best_rows

BET_SIZE = {S.QUINELLA: 2, S.WIDE: 2, S.TRIO: 3}


def grid(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """All label combinations of a report as a literal table, with the position of each label as ``<axis>_no``."""
    out = spark.range(1).select()
    for name, labels in axes.items():
        pairs = [F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(labels)]
        out = out.withColumn("__x", F.explode(F.array(*pairs))).select(
            *out.columns, F.col("__x.v").alias(name), F.col("__x.i").alias(f"{name}_no"))
    return out


def fill_grid(cells: DataFrame, keys: Sequence[str], counts: Sequence[str], **axes: Sequence) -> DataFrame:
    """Every cell of the report: missing ones get count 0 and null rates."""
    full = grid(cells.sparkSession, **axes)
    return F.broadcast(full).join(cells, list(keys), "left").fillna(0, subset=list(counts))


def merged(entries: DataFrame, preds: DataFrame, prob: str = "win_prob") -> DataFrame:
    """Entries with their predictions, expected value and popularity tier."""
    have = set(entries.columns)
    p = preds.select(*[c for c in preds.columns if c in (RACE, ENTRY) or c not in have])
    m = entries.join(p, [RACE, ENTRY]).withColumn("ev", F.col(prob) * F.col("odds"))
    return m.withColumn("tier", pop_tier("popularity")) if "popularity" in have else m


def payoff_map(payoffs: DataFrame) -> DataFrame:
    """One payout per (race, bet type, normalised combination); among duplicates the largest payout counts."""
    return (
        payoffs.select(RACE, "bet_type", combo_norm("combination").alias("combo"), payout_value("payout").alias("pay"))
        .groupBy(RACE, "bet_type", "combo").agg(F.max("pay").alias("pay"))
    )


def pick_races(m: DataFrame, sizes: Sequence[int] = (2, 3), prob: str = "win_prob") -> DataFrame:
    """One row per race: the best runner as ``top``, and the sorted combinations of the best 2 / 3 runners.

    Only the best rows of a race survive the ranking (Spark drops the others before the shuffle), so at most three
    rows per race are collected. Races with fewer runners have null combos.
    """
    ranked = best_rows(m, max(sizes), prob)
    keep = [c for c in m.columns if c != RACE]
    races = ranked.groupBy(RACE).agg(
        F.collect_list(F.struct("pick", ENTRY)).alias("ranked"),
        F.max(F.when(F.col("pick") == 1, F.struct(*keep))).alias("top"))
    for n in sizes:
        first = F.filter("ranked", lambda x: x["pick"] <= n)  # noqa: B023
        combo = F.array_join(F.array_sort(F.transform(first, lambda x: x[ENTRY])).cast("array<string>"), "-")
        races = races.withColumn(f"combo{n}", F.when(F.size("ranked") >= n, combo))
    return races.drop("ranked")


def with_payout(bets: DataFrame, pays: DataFrame, bet: str | Column, combo: str, out: str = "pay") -> DataFrame:
    """Left join of the payout; null means the bet lost."""
    if isinstance(bet, str):
        p = pays.filter(F.col("bet_type") == bet).select(RACE, F.col("combo").alias(combo), F.col("pay").alias(out))
        return bets.join(p, [RACE, combo], "left")
    p = pays.select(RACE, F.col("bet_type").alias("__bet"), F.col("combo").alias(combo), F.col("pay").alias(out))
    return bets.withColumn("__bet", bet).join(p, [RACE, "__bet", combo], "left").drop("__bet")


def gated_bets(entries: DataFrame, preds: DataFrame, payoffs: DataFrame, bet: str, prob: str = "win_prob") -> DataFrame:
    """One row per race that has enough runners: ``ev`` and ``tier0`` of its best runner, and the payout of the best two or three."""
    n = BET_SIZE[bet]
    races = pick_races(merged(entries, preds, prob), (n,), prob).filter(F.col(f"combo{n}").isNotNull())
    return with_payout(races.select(RACE, f"combo{n}", F.col("top.ev").alias("ev"), F.col("top.tier").alias("tier0")),
                       payoff_map(payoffs), bet, f"combo{n}")


def bet_records(entries: DataFrame, preds: DataFrame, payoffs: DataFrame, bet: str,
                thresholds: Sequence[float] = tuple(S.EV_THRESHOLDS), prob: str = "win_prob") -> DataFrame:
    """One row per bet and cell ``(threshold, tier)``: the race counts when its best runner passes the gate."""
    bets = gated_bets(entries, preds, payoffs, bet, prob)
    passed = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("ev") > t)
    return (
        bets.withColumn("threshold", F.explode(passed))
        .withColumn("tier", F.explode(F.array(F.lit(S.ALL_TIER), F.col("tier0"))))
        .select("threshold", "tier", RACE, F.col("pay").isNotNull().cast("double").alias("is_hit"),
                F.coalesce(F.col("pay") / 100, F.lit(0.0)).alias("payout_odds"))
    )
