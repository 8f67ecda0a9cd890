"""Evaluation, bets, resampled intervals, combination probabilities and recommendations."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from hindcast import schema as S
from hindcast.operators import bets as B
from hindcast.operators import combos as G
from hindcast.operators import evaluate as E
from hindcast.operators import resample as R
from hindcast.operators import splits as D
from hindcast.operators.race import predicted_rank
from hindcast.plans import entries as en
from hindcast.plans.catalog.base import on_entries, oracle
from hindcast.plans.oracle_base import PAYOFFS, POP_TIER
from hindcast.session import ensure_checkpoint_dir, stored
from hindcast.sources import store

N_BOOT = 10_000
TIER = POP_TIER.format("popularity")


def model_sql(name: str, m: str) -> str:
    """Entries with the probabilities of one model, expected value, tier and pick order."""
    w, p = ("win_prob", "place_prob") if m == "a" else ("win_prob_b", "place_prob_b")
    return f"""
{name} AS (
  SELECT race_id, horse_number, horse_id, date, is_win, is_placed, odds, popularity, grade, head_count, {w} AS p, {p} AS pp,
         {w} * odds AS ev, {TIER} AS tier,
         row_number() OVER (PARTITION BY race_id ORDER BY {w} DESC, horse_number) AS k,
         row_number() OVER (PARTITION BY race_id ORDER BY {p} DESC, horse_number) AS kp
  FROM e
)"""


MB, MA = model_sql("mb", "b"), model_sql("ma", "a")


def _nll(y: str, p: str) -> str:
    q = f"least(greatest({p}, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE)"
    return f"CASE WHEN {y} IS NOT NULL AND {p} IS NOT NULL THEN -CASE WHEN {y} = 1 THEN ln({q}) ELSE ln(1 - {q}) END END"


METRIC_SQL = f"""avg(CASE WHEN k = 1 THEN is_win END) AS win_accuracy,
  sum(CASE WHEN k = 1 THEN is_win * odds ELSE 0 END) / count(DISTINCT race_id) AS recovery_rate,
  avg({_nll('is_win', 'p')}) AS win_logloss, avg({_nll('is_placed', 'pp')}) AS place_logloss,
  avg((p - is_win) * (p - is_win)) AS win_brier, avg((pp - is_placed) * (pp - is_placed)) AS place_brier"""


def _frames(e, model="b"):
    return en.outcomes(e), en.predictions(e, model)


def _gaps(e):
    """Predictions with holes: every fifth win probability and every seventh place probability is missing, and races
    without any win probability are left."""
    p = en.predictions(e, "b")
    win = F.when((F.col("horse_id") % 5 != 0) & (F.col("race_id") % 11 != 0), F.col("win_prob"))
    return p.withColumns({"win_prob": win, "place_prob": F.when(F.col("horse_id") % 7 != 0, F.col("place_prob"))})


@on_entries("evaluate_gaps", oracle(f"""
SELECT avg(hit) AS win_accuracy, sum(ret) / count(hit) AS recovery_rate, sum(lw) / count(lw) AS win_logloss, sum(lp) / count(lp) AS place_logloss,
  avg((p - is_win) * (p - is_win)) AS win_brier, avg((pp - is_placed) * (pp - is_placed)) AS place_brier
FROM (SELECT *, {_nll('is_win', 'p')} AS lw, {_nll('is_placed', 'pp')} AS lp,
        CASE WHEN p IS NOT NULL AND row_number() OVER (PARTITION BY race_id ORDER BY p DESC NULLS LAST, horse_number) = 1 THEN is_win END AS hit,
        CASE WHEN p IS NOT NULL AND row_number() OVER (PARTITION BY race_id ORDER BY p DESC NULLS LAST, horse_number) = 1 THEN is_win * odds END AS ret
      FROM (SELECT race_id, horse_number, is_win, is_placed, odds, CASE WHEN horse_id % 5 <> 0 AND race_id % 11 <> 0 THEN p END AS p,
              CASE WHEN horse_id % 7 <> 0 THEN pp END AS pp FROM mb))""", MB, rounds=E.METRICS))
def _(e):
    return E.evaluate(en.outcomes(e), _gaps(e))


@on_entries("evaluate", oracle(f"SELECT {METRIC_SQL} FROM mb", MB, rounds=E.METRICS))
def _(e):
    return E.evaluate(*_frames(e))


def _labels(name: str, labels) -> str:
    rows = ", ".join(f"('{v}', {i})" for i, v in enumerate(labels))
    return f"{name} AS (SELECT * FROM (VALUES {rows}) t({name[2:]}, {name[2:]}_no))"


def _tier_sql(expr: str, labels) -> str:
    return oracle(f"""
SELECT tier, tier_no, count(race_id) AS picks, avg(is_win) AS hit_rate, sum(is_win * odds) / nullif(count(race_id), 0) AS recovery
FROM l_tier LEFT JOIN (SELECT race_id, is_win, odds, {expr} AS t FROM mb WHERE k = 1) ON t = tier GROUP BY tier, tier_no""",
        MB, _labels("l_tier", labels), rounds=["hit_rate", "recovery"])


for _name, _tier, _expr, _labs in (
    ("by_popularity", "popularity", TIER, S.POP_TIERS),
    ("by_odds", "odds", "CASE WHEN odds < 2 THEN '〜1.9倍' WHEN odds < 5 THEN '2-4倍' WHEN odds < 10 THEN '5-9倍' ELSE '10倍以上' END", S.ODDS_TIERS),
    ("by_grade", "grade", "CASE WHEN grade IN ('GI','GII','GIII','L') THEN grade ELSE '平場' END", S.GRADE_TIERS),
):
    on_entries(_name, _tier_sql(_expr, _labs))(lambda e, t=_tier: E.by_tier(*_frames(e), t))

THR = "thr AS (SELECT * FROM (VALUES (1.0::DOUBLE, 0), (1.2::DOUBLE, 1), (1.5::DOUBLE, 2), (2.0::DOUBLE, 3), (3.0::DOUBLE, 4)) t(threshold, threshold_no))"
ALL5 = _labels("l_tier", [S.ALL_TIER, *S.POP_TIERS])


def _ev_sql(model: str) -> str:
    return oracle("""
SELECT threshold, threshold_no, tier, tier_no, count(race_id) AS picks, coalesce(sum(is_win), 0)::BIGINT AS hits, avg(is_win) AS hit_rate,
       sum(is_win * odds) / nullif(count(race_id), 0) AS recovery,
       count(DISTINCT race_id) / (SELECT count(DISTINCT race_id) FROM e)::DOUBLE AS coverage
FROM thr CROSS JOIN l_tier LEFT JOIN (SELECT *, ev AS v, tier AS t0 FROM %s) m ON v > threshold AND (tier_no = 0 OR t0 = l_tier.tier)
GROUP BY threshold, threshold_no, l_tier.tier, tier_no""".replace("tier, tier_no, count", "l_tier.tier AS tier, tier_no, count") % model,
        MB, MA, THR, ALL5, rounds=["hit_rate", "recovery", "coverage"])


@on_entries("ev_grid", _ev_sql("mb"))
def _(e):
    return E.ev_grid(*_frames(e))


@on_entries("ev_grid_other_prob", _ev_sql("ma"))
def _(e):
    preds = e.select("race_id", "horse_number", F.col("win_prob").alias("alt_prob"))
    return E.ev_grid(en.outcomes(e), preds, prob="alt_prob")


@on_entries("prob_compare", oracle("""
SELECT avg(abs(win_prob_b - win_prob)) AS mean_abs_diff, max(abs(win_prob_b - win_prob)) AS max_abs_diff,
       corr(win_prob, win_prob_b) AS correlation, avg(win_prob) AS mean_win_prob FROM e""",
    rounds=["mean_abs_diff", "max_abs_diff", "correlation", "mean_win_prob"]))
def _(e):
    return E.prob_compare(e, "win_prob", "win_prob_b")


def _curve_sql(model: str, p: str, y: str) -> str:
    return f"""
SELECT '{model}' AS model, bin, max(lo + (bin - 0.5::DOUBLE) * width) AS bin_center, avg(p) AS mean_pred, avg(y) AS actual_rate, count(y) AS count
FROM (SELECT {p} AS p, {y} AS y, lo, (hi - lo) / 10 AS width,
             CAST(greatest(1, least(10, ceil(({p} - lo) / ((hi - lo) / 10)))) AS INT) AS bin
      FROM mb, (SELECT min({p}) AS lo, max({p}) AS hi FROM mb))
GROUP BY bin"""


CURVE = f"curve AS ({_curve_sql('win', 'p', 'is_win')} UNION ALL {_curve_sql('place', 'pp', 'is_placed')})"


@on_entries("calibration_curve", oracle("SELECT * FROM curve", MB, CURVE, rounds=["bin_center", "mean_pred", "actual_rate"]))
def _(e):
    return E.calibration_curve(*_frames(e))


@on_entries("calibration_bias", oracle("""
SELECT *, (abs(signed_bias) > 0.01 OR mean_calib_error > 0.02) AS needs_calibration,
       CASE WHEN abs(signed_bias) > 0.01 OR mean_calib_error > 0.02 THEN CASE WHEN round(signed_bias, 9) > 0 THEN 'over' ELSE 'under' END END AS direction
FROM (SELECT model, sum((mean_pred - actual_rate) * count) / sum(count) AS signed_bias,
             sum(abs(mean_pred - actual_rate) * count) / sum(count) AS mean_calib_error FROM curve GROUP BY model)""",
    MB, CURVE, rounds=["signed_bias", "mean_calib_error"]))
def _(e):
    return E.calibration_bias(E.calibration_curve(*_frames(e)))


PAYMAP = """
pm AS (SELECT race_id, bet_type, array_to_string(list_sort(list_transform(string_split(combination, '-'), lambda x: CAST(x AS INT))), '-') AS combo,
              max(CAST(replace(payout, ',', '') AS DOUBLE)) AS pay FROM pay GROUP BY ALL)"""
PICKS = """
pk AS (SELECT race_id, max(head_count) AS heads, max(CASE WHEN k = 1 THEN ev END) AS ev, max(CASE WHEN k = 1 THEN tier END) AS tier0,
              max(CASE WHEN k = 1 THEN is_win END) AS is_win, max(CASE WHEN k = 1 THEN odds END) AS odds,
              max(CASE WHEN k = 1 THEN horse_number END) || '' AS combo1, max(CASE WHEN kp = 1 THEN horse_number END) || '' AS place1,
              CASE WHEN max(k) >= 2 THEN array_to_string(list_sort(list(horse_number) FILTER (WHERE k <= 2)), '-') END AS combo2,
              CASE WHEN max(k) >= 3 THEN array_to_string(list_sort(list(horse_number) FILTER (WHERE k <= 3)), '-') END AS combo3
       FROM mb GROUP BY race_id)"""
BACK = (PAYOFFS, MB, PAYMAP, PICKS)


@on_entries("multi_bet", oracle("""
SELECT bet, count(*) AS picks, count(pay) AS hits, count(pay) / count(*)::DOUBLE AS hit_rate, coalesce(sum(pay), 0) / (count(*) * 100) AS recovery
FROM (SELECT '複勝' AS bet, pay FROM pk LEFT JOIN pm ON pm.race_id = pk.race_id AND bet_type = '複勝' AND combo = place1
      UNION ALL SELECT '馬連', pay FROM pk LEFT JOIN pm ON pm.race_id = pk.race_id AND bet_type = '馬連' AND combo = combo2 WHERE combo2 IS NOT NULL
      UNION ALL SELECT '三連複', pay FROM pk LEFT JOIN pm ON pm.race_id = pk.race_id AND bet_type = '三連複' AND combo = combo3 WHERE combo3 IS NOT NULL)
GROUP BY bet""", *BACK, rounds=["hit_rate", "recovery"]))
def _(e):
    return E.multi_bet(*_frames(e), en.payoffs(e))


@on_entries("ev_bet_grid", oracle("""
SELECT threshold, threshold_no, l_tier.tier AS tier, tier_no, l_bet.bet AS bet, bet_no, count(x.race_id) AS picks, coalesce(sum(hit), 0)::BIGINT AS hits,
       sum(hit) / nullif(count(x.race_id), 0)::DOUBLE AS hit_rate, sum(ret) / nullif(count(x.race_id), 0) AS recovery
FROM thr CROSS JOIN l_tier CROSS JOIN l_bet LEFT JOIN (
  SELECT race_id, ev, tier0, '単勝' AS bet, is_win AS hit, is_win * odds AS ret FROM pk
  UNION ALL SELECT pk.race_id, ev, tier0, b.bet, CAST(pay IS NOT NULL AS INT), coalesce(pay / 100, 0)
  FROM (SELECT *, unnest(['複勝', '馬連', '三連複']) AS bet, unnest([combo1, combo2, combo3]) AS c FROM pk) b
  JOIN pk ON pk.race_id = b.race_id LEFT JOIN pm ON pm.race_id = b.race_id AND bet_type = b.bet AND combo = c WHERE c IS NOT NULL
) x ON x.ev > threshold AND (tier_no = 0 OR tier0 = l_tier.tier) AND x.bet = l_bet.bet
GROUP BY ALL""".replace("SELECT pk.race_id, ev, tier0, b.bet", "SELECT pk.race_id, pk.ev, pk.tier0, b.bet"),
    *BACK, THR, ALL5, _labels("l_bet", E.BETS), rounds=["hit_rate", "recovery"]))
def _(e):
    """The columns in use are written once: otherwise the sorts and windows of the entries would hold memory in the tasks of each of the three
    readers, beside their own sums."""
    e = stored(e.select("race_id", "horse_number", "horse_id", "finishing_position", "is_win", "is_placed", "odds", "popularity", "grade", "win_prob_b", "place_prob_b"))
    return E.ev_bet_grid(*_frames(e), en.payoffs(e))


def records_cte(bet: str, combo: str, name: str = "rec") -> str:
    return f"""
{name} AS (SELECT threshold, t AS tier, b.race_id, CAST(pay IS NOT NULL AS DOUBLE) AS is_hit, coalesce(pay / 100, 0) AS payout_odds
  FROM (SELECT pk.race_id, pk.ev, pk.tier0, pm.pay FROM pk LEFT JOIN pm ON pm.race_id = pk.race_id AND bet_type = '{bet}' AND combo = {combo}
        WHERE {combo} IS NOT NULL) b
  JOIN thr ON b.ev > threshold, unnest(['全体', tier0]) u(t))"""


for _name, _bet, _combo in (("bet_records_quinella", S.QUINELLA, "combo2"), ("bet_records_wide", S.WIDE, "combo2"),
                            ("bet_records_trio", S.TRIO, "combo3")):
    on_entries(_name, oracle("SELECT * FROM rec", *BACK, THR, records_cte(_bet, _combo), rounds=["payout_odds"]))(
        lambda e, b=_bet: B.bet_records(*_frames(e), en.payoffs(e), b))


@on_entries("longshot_metrics", oracle(f"""
SELECT count(*) AS n, avg({_nll('is_win', 'p')}) AS win_logloss, avg((p - is_win) * (p - is_win)) AS win_brier FROM mb WHERE popularity >= 7""",
    MB, rounds=["win_logloss", "win_brier"]))
def _(e):
    return E.longshot_metrics(*_frames(e))


FOLDS = """
days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM e)),
folds AS (SELECT CAST(f AS INT) AS fold, (SELECT date FROM days WHERE i = (n * f) // 6) AS d1,
                 (SELECT date FROM days WHERE i = (n * (f + 1)) // 6 - 1) AS d2 FROM range(1, 6) t(f))"""


def fold_rows(e):
    """Metrics of every fold's test period in one pass over the entries."""
    tests = D.walk_forward_rows(e, 5).filter("role = 'test'")
    folds = tests.select("race_id", "fold").distinct()
    stats = E.race_stats(tests, en.predictions(e, "b")).join(folds, "race_id").groupBy("fold").agg(
        F.avg("hit").alias("win_accuracy"), (F.sum("ret") / F.count("hit")).alias("recovery_rate"),
        (F.sum("nll_win") / F.sum("n_win")).alias("win_logloss"), (F.sum("nll_place") / F.sum("n_place")).alias("place_logloss"),
        (F.sum("se_win") / F.sum("n_win")).alias("win_brier"), (F.sum("se_place") / F.sum("n_place")).alias("place_brier"))
    return stats.join(F.broadcast(tests.groupBy("fold").agg(F.count(F.lit(1)).alias("test_rows"))), "fold")  # a row for each fold


FOLD_SQL = f"fr AS (SELECT fold, {METRIC_SQL}, count(*) AS test_rows FROM mb JOIN folds ON date BETWEEN d1 AND d2 GROUP BY fold)"


@on_entries("fold_summary", oracle(f"""
SELECT CAST(fold AS VARCHAR) AS fold, {', '.join(E.METRICS)}, test_rows FROM fr
UNION ALL SELECT 'mean', {', '.join(f'avg({m})' for m in E.METRICS)}, NULL FROM fr""", MB, FOLDS, FOLD_SQL, rounds=E.METRICS))
def _(e):
    return E.fold_summary(fold_rows(e))


@on_entries("fold_pivot", oracle("""
SELECT tier, """ + ", ".join(f"avg(CASE WHEN fold = {k} THEN CAST(is_win AS DOUBLE) END) AS \"{k}\"" for k in range(1, 6)) + """
FROM mb JOIN folds ON date BETWEEN d1 AND d2 GROUP BY tier""", MB, FOLDS, rounds=[f'"{k}"' for k in range(1, 6)]))
def _(e):
    rows = D.walk_forward_rows(B.merged(e.select("race_id", "horse_number", "date", "is_win", "odds", "popularity"), en.predictions(e, "b")), 5)
    return E.fold_pivot(rows.filter("role = 'test'"), ["tier"], "is_win", range(1, 6))


@on_entries("compare_metrics", oracle(f"""
SELECT a.metric, a.value AS value_before, b.value AS value_after, b.value - a.value AS value_change
FROM (UNPIVOT (SELECT {METRIC_SQL} FROM ma) ON COLUMNS(*) INTO NAME metric VALUE value) a
JOIN (UNPIVOT (SELECT {METRIC_SQL} FROM mb) ON COLUMNS(*) INTO NAME metric VALUE value) b ON a.metric = b.metric""",
    MA, MB, rounds=["value_before", "value_after", "value_change"]))
def _(e):
    before, after = (E.metric_rows(E.evaluate(*_frames(e, m))) for m in "ab")
    return E.compare(before, after, ["metric"], ["value"])


# ---- resampling ---------------------------------------------------------------------------------------------------

def hash_sql(unit: str, seed: int = 42) -> str:
    """Coefficients h0..h3 of a unit key."""
    digest = f"md5('{seed}|' || {unit})"
    return ", ".join(f"CAST('0x' || substr({digest}, {1 + 7 * i}, 7) AS BIGINT) AS h{i}" for i in range(4))


# Written out, not taken from the operator: the largest prime below 2**28, and its product with the probabilities that a
# Poisson(1) count is at most 0, 1, ... 8.
P = 268435399
CUTS = [98751865, 197503729, 246879661, 263338306, 267452967, 268275899, 268413054, 268432648, 268435097]
UNIFORM = f"((((h3 * (b + 1) + h2) % {P}) * (b + 1) + h1) % {P} * (b + 1) + h0) % {P}"
COUNT = " + ".join(f"CAST(x >= {c} AS INT)" for c in CUTS)
BOOTS = f"boots AS (SELECT CAST(b AS BIGINT) AS b FROM range({N_BOOT}) t(b))"


def weights_cte(unit_table: str, unit: str, key: str) -> str:
    """(key, b, w) rows of every unit with a positive count."""
    return f"""
wts AS (SELECT {key}, b, w FROM (SELECT {key}, b, {COUNT} AS w FROM (
  SELECT {key}, b, {UNIFORM} AS x FROM (SELECT DISTINCT {key}, {hash_sql(unit)} FROM {unit_table}), boots)) WHERE w > 0)"""


FLAGS = "0.95::DOUBLE AS ci_level, coalesce(q[1] > 1.0, false) AS above_100, coalesce(q[1] > 1.1, false) AS above_110"
QUANT = "quantile_cont(rate, [0.025::DOUBLE, 0.975::DOUBLE]) AS q"
CI = ["point_estimate", "ci_lower", "ci_upper"]


@on_entries("bootstrap_ci", oracle(f"""
SELECT n_bets, point_estimate, q[1] AS ci_lower, q[2] AS ci_upper, {FLAGS}
FROM (SELECT count(*) AS n_bets, avg(is_win * odds) AS point_estimate FROM mb WHERE k = 1),
     (SELECT {QUANT} FROM (SELECT b, sum(w * is_win * odds) / sum(w) AS rate FROM wts JOIN mb USING (race_id) WHERE k = 1 GROUP BY b))""",
    MB, BOOTS, weights_cte("mb", "race_id", "race_id"), rounds=CI))
def _(e):
    from hindcast.operators.race import top1
    bets = top1(B.merged(*_frames(e)))
    return R.bootstrap_ci(bets, ["race_id"], hit="is_win", odds="odds", n_boot=N_BOOT)


def _top_bets(e):
    from hindcast.operators.race import top1
    return top1(B.merged(*_frames(e))).select("race_id", "tier", "is_win", "odds")


@on_entries("bootstrap_draws", oracle(f"""
SELECT tier, n_bets, point_estimate, q[1] AS ci_lower, q[2] AS ci_upper, {FLAGS}
FROM (SELECT tier, count(*) AS n_bets, avg(is_win * odds) AS point_estimate FROM mb WHERE k = 1 GROUP BY tier)
JOIN (SELECT tier, {QUANT} FROM (
  SELECT d.tier, b, avg(x.is_win * x.odds) AS rate
  FROM (SELECT tier, b, 1 + ({UNIFORM} * n) // {P} AS pick FROM (SELECT tier, n, {hash_sql("tier || '|' || idx")} FROM idx), boots) d
  JOIN idx x ON x.tier = d.tier AND x.idx = d.pick GROUP BY d.tier, b) GROUP BY tier) USING (tier)""",
    MB, BOOTS, """idx AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY race_id) AS idx, count(*) OVER (PARTITION BY tier) AS n
                          FROM mb WHERE k = 1)""", rounds=CI))
def _(e):
    return R.bootstrap_ci(_top_bets(e), ["race_id"], ["tier"], hit="is_win", odds="odds", n_boot=N_BOOT, method="draws")


@on_entries("draw_counts", oracle(f"""
SELECT tier, {N_BOOT}::BIGINT AS replicates, count(*) AS least_draws, count(*) AS most_draws, true AS mean_near FROM mb WHERE k = 1 GROUP BY tier""", MB))
def _(e):
    """Each replicate draws as many bets as its cell has, and the mean of the replicates is within four standard errors of the cell's."""
    x = _top_bets(e).select("tier", F.coalesce(F.col("is_win") * F.col("odds"), F.lit(0.0)).alias("__x"))
    sums = R.drawn_sums(x, ["tier"], N_BOOT, 42).groupBy("tier").agg(
        F.count(F.lit(1)).alias("replicates"), F.min("n").alias("least_draws"), F.max("n").alias("most_draws"), F.avg(F.col("s") / F.col("n")).alias("mean"))
    cell = x.groupBy("tier").agg(F.avg("__x").alias("own"), (F.coalesce(F.stddev_pop("__x"), F.lit(0.0)) / F.sqrt(F.count("__x") * N_BOOT)).alias("se"))
    return sums.join(cell, "tier").select("tier", "replicates", "least_draws", "most_draws", (F.abs(F.col("mean") - F.col("own")) <= 4 * F.col("se") + 1e-9).alias("mean_near"))


@on_entries("ev_grid_ci", oracle(f"""
SELECT threshold, threshold_no, l_tier.tier AS tier, tier_no, coalesce(n_bets, 0) AS n_bets, point_estimate, q[1] AS ci_lower, q[2] AS ci_upper, {FLAGS}
FROM thr CROSS JOIN l_tier
LEFT JOIN (SELECT threshold AS t1, t AS t2, count(*) AS n_bets, avg(is_win * odds) AS point_estimate
           FROM mb JOIN thr ON ev > threshold, unnest(['全体', tier]) u(t) GROUP BY ALL) p ON t1 = threshold AND t2 = l_tier.tier
LEFT JOIN (SELECT t3, t4, {QUANT} FROM (
             SELECT threshold AS t3, t AS t4, b, sum(w * is_win * odds) / sum(w) AS rate
             FROM mb JOIN thr ON ev > threshold JOIN wts USING (race_id, horse_number), unnest(['全体', tier]) u(t) GROUP BY ALL) GROUP BY t3, t4) c
  ON t3 = threshold AND t4 = l_tier.tier""", MB, THR, ALL5, BOOTS,
    weights_cte("mb", "race_id || '|' || horse_number", "race_id, horse_number"), rounds=CI))
def _(e):
    return R.ev_grid_ci(*_frames(e), n_boot=N_BOOT)


def pooled_sql(*records: str) -> str:
    return oracle(f"""
SELECT threshold, threshold_no, l_tier.tier AS tier, tier_no, coalesce(n_bets, 0) AS n_bets, point_estimate, q[1] AS ci_lower, q[2] AS ci_upper, {FLAGS}
FROM thr CROSS JOIN l_tier
LEFT JOIN (SELECT threshold AS t1, tier AS t2, count(*) AS n_bets, avg(is_hit * payout_odds) AS point_estimate FROM rec GROUP BY ALL) p
  ON t1 = threshold AND t2 = l_tier.tier
LEFT JOIN (SELECT t3, t4, {QUANT} FROM (SELECT threshold AS t3, tier AS t4, b, sum(w * is_hit * payout_odds) / sum(w) AS rate
             FROM rec JOIN wts USING (race_id) GROUP BY ALL) GROUP BY t3, t4) c ON t3 = threshold AND t4 = l_tier.tier""",
        *BACK, THR, ALL5, *records, BOOTS, weights_cte("rec", "race_id", "race_id"), rounds=CI)


for _name, _bet, _combo in (("quinella_ci", S.QUINELLA, "combo2"), ("wide_ci", S.WIDE, "combo2"), ("trio_ci", S.TRIO, "combo3")):
    on_entries(_name, pooled_sql(records_cte(_bet, _combo)))(
        lambda e, b=_bet: R.combo_ci(*_frames(e), en.payoffs(e), b, n_boot=N_BOOT))


FINE = [(10 + k) / 10 for k in range(16)]
THR16 = "thr AS (SELECT CAST(k AS INT) AS threshold_no, (10 + k) / 10::DOUBLE AS threshold FROM range(16) t(k))"
POOLED = [("quinella", S.QUINELLA, "combo2"), ("wide", S.WIDE, "combo2"), ("trio", S.TRIO, "combo3")]


def _gated_sql(name: str, bet: str, combo: str) -> str:
    return f"""SELECT '{name}' AS bet, pk.race_id, pk.ev, pk.tier0, coalesce(pm.pay / 100, 0) AS ret, (SELECT count(*) FROM thr WHERE pk.ev > threshold) AS band
  FROM pk LEFT JOIN pm ON pm.race_id = pk.race_id AND bet_type = '{bet}' AND combo = {combo}
  WHERE {combo} IS NOT NULL AND pk.race_id IN (SELECT race_id FROM e JOIN folds ON date BETWEEN d1 AND d2)"""


@on_entries("pooled_ci", oracle(f"""
SELECT bet, bet_no, threshold, threshold_no, tier, tier_no, coalesce(n_bets, 0) AS n_bets, point_estimate, q[1] AS ci_lower, q[2] AS ci_upper, {FLAGS}
FROM thr CROSS JOIN l_tier CROSS JOIN l_bet
LEFT JOIN (SELECT bet, threshold_no, t AS tier, count(*) AS n_bets, avg(ret) AS point_estimate
           FROM gated JOIN thr ON threshold_no < band, unnest(['全体', tier0]) u(t) GROUP BY ALL) p USING (bet, threshold_no, tier)
LEFT JOIN (SELECT bet, threshold_no, tier, {QUANT} FROM (
             SELECT bet, threshold_no, t AS tier, b, sum(s) / sum(n) AS rate
             FROM (SELECT bet, tier0, band, b, sum(w * ret) AS s, sum(w) AS n FROM gated JOIN wts USING (race_id) GROUP BY ALL)
             JOIN thr ON threshold_no < band, unnest(['全体', tier0]) u(t) GROUP BY ALL) GROUP BY bet, threshold_no, tier) c USING (bet, threshold_no, tier)""",
    *BACK, THR16, ALL5, _labels("l_bet", [n for n, _, _ in POOLED]), FOLDS, "gated AS (" + " UNION ALL ".join(_gated_sql(*p) for p in POOLED) + ")",
    BOOTS, weights_cte("gated", "race_id", "race_id"), rounds=CI), store=True)
def _(e):
    """The test periods of all folds together: quinella, wide and trio on the fine grid."""
    tests = D.walk_forward_rows(e.select("race_id", "horse_number", "date", "odds", "popularity"), 5).filter("role = 'test'").drop("date", "role")
    preds, pays = en.predictions(e, "b"), en.payoffs(e)
    parts = [B.gated_bets(tests, preds, pays, bet).select("race_id", "ev", "tier0", "pay", F.lit(n).alias("bet")) for n, bet, _ in POOLED]
    return R.pooled_grid(parts[0].unionByName(parts[1]).unionByName(parts[2]), [n for n, _, _ in POOLED], FINE, N_BOOT)


def _stats_cte(name: str, m: str) -> str:
    return f"""
{name} AS (SELECT race_id, sum({_nll('is_win', 'p')}) AS nw, sum({_nll('is_placed', 'pp')}) AS np, count(*) AS n,
   max(CASE WHEN k = 1 THEN is_win END) AS hit, max(CASE WHEN k = 1 THEN is_win * odds END) AS ret FROM {m} GROUP BY race_id)"""


def _side(w: str, s: str) -> str:
    return (f"sum({w} * {s}.nw) / sum({w} * {s}.n), sum({w} * {s}.np) / sum({w} * {s}.n), "
            f"sum({w} * {s}.hit) / sum({w})::DOUBLE, sum({w} * {s}.ret) / sum({w})")


@on_entries("paired_bootstrap", oracle(f"""
SELECT r.metric, r.a, r.b, r.b - r.a AS diff_b_minus_a, q[1] AS ci_lower, q[2] AS ci_upper, NOT (q[1] <= 0 AND q[2] >= 0) AS significant
FROM (SELECT unnest(['win_logloss', 'place_logloss', 'win_accuracy', 'recovery_rate']) AS metric, unnest([{_side('1', 'sa')}]) AS a, unnest([{_side('1', 'sb')}]) AS b
      FROM sa JOIN sb USING (race_id)) r
JOIN (SELECT metric, quantile_cont(d, [0.025::DOUBLE, 0.975::DOUBLE]) AS q FROM (
        SELECT b, unnest(['win_logloss', 'place_logloss', 'win_accuracy', 'recovery_rate']) AS metric, unnest(vb) - unnest(va) AS d
        FROM (SELECT b, [{_side('w', 'sa')}] AS va, [{_side('w', 'sb')}] AS vb FROM wts JOIN sa USING (race_id) JOIN sb USING (race_id) GROUP BY b)) GROUP BY metric) c
  USING (metric)""", MA, MB, _stats_cte("sa", "ma"), _stats_cte("sb", "mb"), BOOTS, weights_cte("e", "race_id", "race_id"),
    rounds=["a", "b", "diff_b_minus_a", "ci_lower", "ci_upper"]))
def _(e):
    return R.paired_bootstrap(en.outcomes(e), en.predictions(e, "a"), en.predictions(e, "b"), n_boot=N_BOOT)


# ---- combination probabilities ------------------------------------------------------------------------------------

ST = "s AS (SELECT race_id, horse_number AS h, head_count AS n, win_prob_b / sum(win_prob_b) OVER (PARTITION BY race_id) AS p FROM e)"
ORD2 = "o2 AS (SELECT a.race_id, a.n, a.h AS i, b.h AS j, a.p * b.p / (1 - a.p) AS q, a.p AS pa, b.p AS pb FROM s a JOIN s b ON a.race_id = b.race_id AND a.h <> b.h)"
ORD3 = """o3 AS (SELECT o.race_id, o.i, o.j, c.h AS k, o.q * c.p / (1 - o.pa - o.pb) AS q
  FROM o2 o JOIN s c ON c.race_id = o.race_id AND c.h <> o.i AND c.h <> o.j)"""
QUIN = "quin AS (SELECT race_id, least(i, j) AS i, greatest(i, j) AS j, sum(q) AS prob FROM o2 GROUP BY ALL)"
WIDE_ = """wide AS (SELECT race_id, i, j, CASE WHEN bool_and(n2) THEN max(q) ELSE sum(q) END AS prob FROM (
  SELECT race_id, least(i, j) AS i, greatest(i, j) AS j, q, false AS n2 FROM o3
  UNION ALL SELECT race_id, least(i, k), greatest(i, k), q, false FROM o3
  UNION ALL SELECT race_id, least(j, k), greatest(j, k), q, false FROM o3
  UNION ALL SELECT race_id, i, j, 1.0::DOUBLE, true FROM o2 WHERE n = 2 AND i < j) GROUP BY race_id, i, j)"""
TRIO_ = "trio AS (SELECT race_id, t[1] AS i, t[2] AS j, t[3] AS k, sum(q) AS prob FROM (SELECT race_id, list_sort([i, j, k]) AS t, q FROM o3) GROUP BY ALL)"


@on_entries("pl_win", oracle("SELECT race_id, h AS horse_number, p AS win_prob FROM s", ST, rounds=["win_prob"]))
def _(e):
    return G.pl_win(en.predictions(e, "b"))


@on_entries("pl_place", oracle("""
SELECT race_id, h AS horse_number, CASE WHEN n <= 3 THEN 1.0::DOUBLE ELSE p + q2 + q3 END AS place_prob
FROM s JOIN (SELECT race_id, j AS h, sum(q) AS q2 FROM o2 GROUP BY ALL) USING (race_id, h) JOIN (SELECT race_id, k AS h, sum(q) AS q3 FROM o3 GROUP BY ALL) USING (race_id, h)
UNION ALL SELECT race_id, h, 1.0::DOUBLE FROM s WHERE n <= 2""", ST, ORD2, ORD3, rounds=["place_prob"]))
def _(e):
    return G.pl_place(en.predictions(e, "b"), most=None)


@on_entries("pl_quinella", oracle("SELECT * FROM quin", ST, ORD2, QUIN, rounds=["prob"]))
def _(e):
    return G.pl_quinella(en.predictions(e, "b"), most=None)


@on_entries("pl_wide", oracle("SELECT * FROM wide", ST, ORD2, ORD3, WIDE_, rounds=["prob"]))
def _(e):
    return G.pl_wide(en.predictions(e, "b"), most=None)


@on_entries("pl_trio", oracle("SELECT * FROM trio", ST, ORD2, ORD3, TRIO_, rounds=["prob"]))
def _(e):
    return G.pl_trio(en.predictions(e, "b"), most=None)


def priced(e):
    return en.predictions(e, "b").join(e.select("race_id", "horse_number", "odds"), ["race_id", "horse_number"])


RANKED = f"""
rk AS (SELECT race_id, horse_number, win_prob_b AS p, place_prob_b AS pp, odds, win_prob_b * odds AS ev,
       {POP_TIER.format('rank() OVER (PARTITION BY race_id ORDER BY odds)')} AS tier,
       row_number() OVER (PARTITION BY race_id ORDER BY win_prob_b DESC, horse_number) AS k,
       rank() OVER (PARTITION BY race_id ORDER BY place_prob_b DESC) AS kp,
       row_number() OVER (PARTITION BY race_id ORDER BY CASE WHEN win_prob_b * odds > 1.5 THEN win_prob_b END DESC NULLS LAST, horse_number) AS kw FROM e),
tp AS (SELECT race_id, tier AS top_tier, ev AS top_ev, cnt FROM (SELECT *, count(*) OVER (PARTITION BY race_id) AS cnt FROM rk) WHERE k = 1)"""
BEST = """
bq AS (SELECT race_id, unnest([i, j]) AS horse_number FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY round(prob, 12) DESC, i, j) AS r FROM quin) WHERE r = 1),
bw AS (SELECT race_id, unnest([i, j]) AS horse_number FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY round(prob, 12) DESC, i, j) AS r FROM wide) WHERE r = 1),
bt AS (SELECT race_id, unnest([i, j, k]) AS horse_number FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY round(prob, 12) DESC, i, j, k) AS r FROM trio) WHERE r = 1)"""
FLAGGED = """
fl AS (SELECT *, recommended_win OR recommended_place OR recommended_quinella OR recommended_wide OR recommended_trio AS recommended FROM (
  SELECT rk.race_id, rk.horse_number, p AS win_prob, pp AS place_prob, odds, ev,
         kw = 1 AND ev > 1.5 AND top_tier <> '7番人気以下' AS recommended_win, kp <= 3 AS recommended_place,
         bq.race_id IS NOT NULL AND top_tier <> '7番人気以下' AS recommended_quinella,
         bw.race_id IS NOT NULL AND top_tier <> '7番人気以下' AS recommended_wide,
         bt.race_id IS NOT NULL AND top_tier <> '7番人気以下' AS recommended_trio
  FROM rk JOIN tp USING (race_id) LEFT JOIN bq ON bq.race_id = rk.race_id AND bq.horse_number = rk.horse_number
  LEFT JOIN bw ON bw.race_id = rk.race_id AND bw.horse_number = rk.horse_number
  LEFT JOIN bt ON bt.race_id = rk.race_id AND bt.horse_number = rk.horse_number))"""
STRAT = """
sp AS (SELECT '堅実' AS strategy, 'wide' AS bet, race_id, horse_number, top_ev AS ev FROM rk JOIN tp USING (race_id)
       WHERE top_tier = '2-3番人気' AND top_ev > 1.5 AND cnt >= 2 AND k <= 2
       UNION ALL SELECT '大穴', 'win', race_id, horse_number, top_ev FROM rk JOIN tp USING (race_id) WHERE top_tier = '7番人気以下' AND k = 1)"""
ALLBEST = (ST, ORD2, ORD3, QUIN, WIDE_, TRIO_, RANKED, BEST, FLAGGED)


@on_entries("recommend", oracle("SELECT * FROM fl", *ALLBEST, rounds=["win_prob", "place_prob", "odds", "ev"]))
def _(e):
    return G.recommend(priced(e), most=None)


@on_entries("recommend_no_odds", oracle("""
SELECT *, recommended_win OR recommended_place OR recommended_quinella OR recommended_wide OR recommended_trio AS recommended FROM (
  SELECT rk.race_id, rk.horse_number, p AS win_prob, pp AS place_prob, NULL::DOUBLE AS odds, NULL::DOUBLE AS ev, k = 1 AS recommended_win, kp <= 3 AS recommended_place,
         bq.race_id IS NOT NULL AS recommended_quinella, bw.race_id IS NOT NULL AS recommended_wide, bt.race_id IS NOT NULL AS recommended_trio
  FROM rk LEFT JOIN bq ON bq.race_id = rk.race_id AND bq.horse_number = rk.horse_number
  LEFT JOIN bw ON bw.race_id = rk.race_id AND bw.horse_number = rk.horse_number
  LEFT JOIN bt ON bt.race_id = rk.race_id AND bt.horse_number = rk.horse_number)""", *ALLBEST, rounds=["win_prob", "place_prob"]))
def _(e):
    return G.recommend(en.predictions(e, "b"), most=None)


@on_entries("strategy_picks", oracle("SELECT * FROM sp", RANKED, STRAT, rounds=["ev"]))
def _(e):
    return G.strategy_picks(priced(e))


@on_entries("picks_document", oracle("""
SELECT race_id, CAST(to_json({'betting': {'win': w, 'win_ev': we, 'place': pl, 'quinella': q, 'wide': d, 'trio': t},
   'strategies': [{'name': '堅実', 'bet_type': 'wide', 'horses': h0, 'ev': e0}, {'name': '大穴', 'bet_type': 'win', 'horses': h1, 'ev': e1}]}) AS VARCHAR) AS document
FROM (SELECT race_id, coalesce(list_sort(list(horse_number) FILTER (WHERE recommended_win)), []) AS w,
        round(max(CASE WHEN recommended_win THEN ev END), 4) AS we,
        coalesce(list_sort(list(horse_number) FILTER (WHERE recommended_place)), []) AS pl,
        coalesce(list_sort(list(horse_number) FILTER (WHERE recommended_quinella)), []) AS q,
        coalesce(list_sort(list(horse_number) FILTER (WHERE recommended_wide)), []) AS d,
        coalesce(list_sort(list(horse_number) FILTER (WHERE recommended_trio)), []) AS t FROM fl GROUP BY race_id)
LEFT JOIN (SELECT race_id, coalesce(list_sort(list(horse_number) FILTER (WHERE strategy = '堅実')), []) AS g0,
        coalesce(list_sort(list(horse_number) FILTER (WHERE strategy = '大穴')), []) AS g1,
        round(max(CASE WHEN strategy = '堅実' THEN ev END), 4) AS e0, round(max(CASE WHEN strategy = '大穴' THEN ev END), 4) AS e1
        FROM sp GROUP BY race_id) USING (race_id), LATERAL (SELECT coalesce(g0, []) AS h0, coalesce(g1, []) AS h1)""", *ALLBEST, STRAT))
def _(e):
    p = priced(e)
    return store.picks_document(G.recommend(p, most=None), G.strategy_picks(p), G.STRATEGIES)


@on_entries("saved_run", oracle("""
SELECT race_id, horse_number, CAST(rank() OVER (PARTITION BY race_id ORDER BY win_prob DESC) AS INT) AS predicted_rank, win_prob FROM e""", rounds=["win_prob"]))
def _(e):
    """A run's predictions written to its folder and read back."""
    spark = e.sparkSession
    ensure_checkpoint_dir(spark)
    p = predicted_rank(e.select("race_id", "horse_number", "win_prob")).select("race_id", "horse_number", "predicted_rank", "win_prob")
    path = store.save_run(p, f"{spark.sparkContext.getCheckpointDir()}/runs-{uuid4().hex}", "20240101_000000")
    return spark.read.schema(p.schema).option("header", True).csv(path)
