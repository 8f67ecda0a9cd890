"""Cleaning, buckets and within-race queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions import clean as C
from hindcast.functions import tiers as T
from hindcast.operators import race as R
from hindcast.plans import entries as en
from hindcast.plans.catalog.base import on_entries, oracle, register
from hindcast.plans.oracle_base import PAYOFFS, POP_TIER
from hindcast.sources import store

RAW = """
rr AS (
  SELECT race_id, CAST(horse_number AS VARCHAR) AS horse_number,
         CASE WHEN horse_weight_diff = 10 THEN '中止' ELSE CAST(finishing_position AS VARCHAR) END AS finishing_position,
         horse_id, jockey_id, trainer_id, owner, venue, course_type, distance, head_count, sex, age,
         sex || CAST(CAST(age AS INT) AS VARCHAR) AS sex_age,
         ' ' || CAST(weight_carried AS VARCHAR) AS weight_carried,
         (tenths // 600) || ':' || lpad(CAST((tenths % 600) // 10 AS VARCHAR), 2, '0') || '.' || (tenths % 10) AS finish_time,
         lpad(CAST(first_corner_pos AS VARCHAR), 2, '0') || '-' || lpad(CAST(horse_number AS VARCHAR), 2, '0') AS passing_order,
         last_3f, CASE WHEN horse_weight_diff = 9 THEN '---' ELSE CAST(odds AS VARCHAR) END AS odds,
         CAST(popularity AS VARCHAR) AS popularity,
         CAST(CAST(horse_weight AS INT) AS VARCHAR) || '(' || CASE WHEN horse_weight_diff > 0 THEN '+' ELSE '' END
           || horse_weight_diff || ')' AS horse_weight
  FROM e
)"""

RACES = """
ra AS (
  SELECT o_orderkey AS race_id, 'Race ' || o_orderkey || coalesce('(' || g || ')', '') AS race_name,
         strftime(o_orderdate, '%Y/%m/%d') AS date,
         CASE WHEN o_orderkey % 2 = 0 THEN g ELSE ' ' END AS grade,
         CASE o_orderstatus WHEN 'F' THEN '良' WHEN 'O' THEN '稍重' WHEN 'P' THEN '重' END AS track_condition,
         ['2歳新馬', '3歳未勝利', '1勝クラス', '1000万下', '3勝クラス ハンデ', 'オープン'][CAST(o_orderkey % 6 + 1 AS INT)] AS race_condition
  FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'GI' WHEN '2-HIGH' THEN 'GII' WHEN '3-MEDIUM' THEN 'GIII'
                       WHEN '4-NOT SPECIFIED' THEN 'L' END AS g FROM orders) x
)"""

CLASS_SQL = """CASE WHEN race_condition LIKE '%新馬%' THEN 0.0::DOUBLE WHEN race_condition LIKE '%未勝利%' THEN 1.0::DOUBLE
  WHEN regexp_matches(race_condition, '500万下|1勝クラス') THEN 2.0::DOUBLE
  WHEN regexp_matches(race_condition, '1000万下|2勝クラス') THEN 3.0::DOUBLE
  WHEN regexp_matches(race_condition, '1600万下|3勝クラス') THEN 4.0::DOUBLE
  WHEN race_condition LIKE '%オープン%' THEN 5.0::DOUBLE END"""

SECONDS_SQL = ("CAST(split_part(finish_time, ':', 1) AS DOUBLE) * 60 + CAST(split_part(finish_time, ':', 2) AS DOUBLE)")


@on_entries("clean_time_corner", oracle(f"""
SELECT race_id, horse_number, {SECONDS_SQL} AS seconds, CAST(split_part(passing_order, '-', 1) AS INT) AS corner,
       regexp_extract(sex_age, '^([^0-9]+)', 1) AS sex, CAST(regexp_extract(sex_age, '([0-9]+)$', 1) AS DOUBLE) AS age
FROM rr""", RAW, rounds=["seconds"]))
def _(e):
    return en.result_table(e).select("race_id", "horse_number", C.race_seconds("finish_time").alias("seconds"),
                                     C.first_corner("passing_order").alias("corner"), C.sex("sex_age").alias("sex"),
                                     C.age("sex_age").alias("age"))


@on_entries("clean_numbers", oracle("""
SELECT race_id, horse_number, CAST(regexp_extract(horse_weight, '([0-9]+)', 1) AS INT) AS weight,
       CAST(regexp_extract(horse_weight, '\\(([+-]?[0-9]+)\\)', 1) AS INT) AS weight_diff,
       try_cast(odds AS DOUBLE) AS odds, try_cast(trim(weight_carried) AS DOUBLE) AS carried,
       try_cast(finishing_position AS DOUBLE) AS position, nullif(trim(weight_carried), '') AS carried_text,
       CAST(regexp_matches(finishing_position, '^[0-9]+$') AND try_cast(finishing_position AS DOUBLE) <= 3 AS INT) AS is_placed
FROM rr""", RAW, rounds=["odds"]))
def _(e):
    pos = C.to_number("finishing_position")
    return en.result_table(e).select(
        "race_id", "horse_number", C.first_int("horse_weight").alias("weight"), C.paren_delta("horse_weight").alias("weight_diff"),
        C.to_number("odds").alias("odds"), C.to_number("weight_carried").alias("carried"), pos.alias("position"),
        C.or_none("weight_carried").alias("carried_text"), C.is_placed(pos).alias("is_placed"))


@register("clean_class_grade", oracle(f"""
SELECT race_id, {CLASS_SQL} AS class_level, CAST(race_condition LIKE '%ハンデ%' AS DOUBLE) AS is_handicap,
       CASE WHEN trim(grade) <> '' THEN grade ELSE nullif(regexp_extract(race_name, '\\((GI{{1,3}}|L)\\)', 1), '') END AS grade,
       nullif(regexp_extract(race_name, '\\((GIII|GII|GI|L)\\)\\s*$', 1), '') AS grade_in_name,
       CAST(strptime(date, '%Y/%m/%d') AS DATE) AS date
FROM ra""", RACES))
def _(spark, d):
    return en.race_table(spark, d).select(
        "race_id", C.class_level("race_condition").alias("class_level"), C.is_handicap("race_condition").alias("is_handicap"),
        C.grade_or_name("grade", "race_name").alias("grade"),
        C.grade_or_name(F.lit(None).cast("string"), "race_name", anchored=True).alias("grade_in_name"),
        C.to_date_ymd("date").alias("date"))


@on_entries("clean_payout_combo", oracle("""
SELECT race_id, bet_type, combination, CAST(replace(payout, ',', '') AS DOUBLE) AS pay,
       array_to_string(list_transform(list_sort(list_transform(string_split(combination, '-'), lambda x: CAST(x AS INT))),
                                      lambda x: CAST(x AS VARCHAR)), '-') AS combo
FROM pay""", PAYOFFS))
def _(e):
    return en.payoffs(e).select("race_id", "bet_type", "combination", C.payout_value("payout").alias("pay"),
                                C.combo_norm("combination").alias("combo"))


@on_entries("bucket_tiers", oracle(f"""
SELECT race_id, horse_number,
       CASE WHEN distance <= 0 OR distance > 10000 THEN NULL WHEN distance <= 1400 THEN 0 WHEN distance <= 1800 THEN 1
            WHEN distance <= 2200 THEN 2 ELSE 3 END AS band,
       {POP_TIER.format('popularity')} AS pop_tier,
       CASE WHEN odds < 2 THEN '〜1.9倍' WHEN odds < 5 THEN '2-4倍' WHEN odds < 10 THEN '5-9倍' ELSE '10倍以上' END AS odds_tier,
       CASE WHEN grade IN ('GI','GII','GIII','L') THEN grade ELSE '平場' END AS grade_tier,
       CASE WHEN distance <= 1400 THEN '短距離(~1400m)' WHEN distance <= 1800 THEN 'マイル(1401-1800m)'
            WHEN distance <= 2400 THEN '中距離(1801-2400m)' ELSE '長距離(2401m~)' END AS distance_bucket,
       CASE WHEN head_count <= 9 THEN '少頭数(~9頭)' WHEN head_count <= 15 THEN '中頭数(10-15頭)' ELSE '多頭数(16頭~)' END AS heads,
       CASE WHEN horse_weight_diff <= -6 THEN '大幅減(-6kg以下)' WHEN horse_weight_diff >= 6 THEN '大幅増(+6kg以上)'
            ELSE '通常(-5~+5kg)' END AS weight_bucket
FROM e"""))
def _(e):
    return e.select("race_id", "horse_number", T.band("distance").alias("band"), T.pop_tier("popularity").alias("pop_tier"),
                    T.odds_tier("odds").alias("odds_tier"), T.grade_tier("grade").alias("grade_tier"),
                    T.distance_bucket("distance").alias("distance_bucket"), T.head_count_bucket("head_count").alias("heads"),
                    T.weight_diff_bucket("horse_weight_diff").alias("weight_bucket"))


@register("load_and_clean", oracle(f"""
SELECT race_id, CAST(horse_number AS INT) AS horse_number, CAST(strptime(ra.date, '%Y/%m/%d') AS DATE) AS date,
       CAST(finishing_position AS DOUBLE) AS finishing_position, {CLASS_SQL} AS class_level, try_cast(odds AS DOUBLE) AS odds,
       {SECONDS_SQL} AS finish_time_sec, sex, age, CAST(finishing_position = '1' AS INT) AS is_win
FROM rr JOIN ra USING (race_id)
WHERE regexp_matches(finishing_position, '^[0-9]+$') AND venue IN ('A', 'R')""", RAW, RACES, rounds=["odds", "finish_time_sec"]))
def _(spark, d):
    raw = store.load_entries(en.race_table(spark, d), en.result_table(en.entries(spark, d)), venues=["A", "R"])
    full = C.clean_entries(raw.withColumn("horse_weight_diff", C.paren_delta("horse_weight"))
                           .withColumn("horse_weight", C.first_int("horse_weight")))
    return full.select("race_id", "horse_number", "date", "finishing_position", "class_level", "odds", "finish_time_sec",
                       "sex", "age", "is_win")


@on_entries("prev_deltas", oracle("""
SELECT race_id, horse_number, CAST(distance - prev_distance AS DOUBLE) AS distance_change,
       CASE WHEN prev_jockey_id IS NOT NULL THEN CAST(jockey_id <> prev_jockey_id AS DOUBLE) END AS jockey_change,
       CAST(date - prev_race_date AS DOUBLE) AS days_since_last_race
FROM (SELECT *, lag(distance) OVER w AS prev_distance, lag(jockey_id) OVER w AS prev_jockey_id, lag(date) OVER w AS prev_race_date
      FROM e WINDOW w AS (PARTITION BY horse_id ORDER BY date, race_id, horse_number))"""))
def _(e):
    from hindcast.operators.history import ORDER
    from hindcast.operators.keyed import Keyed
    prev = {f"prev_{n}": (lambda c: lambda w: F.lag(c).over(w))(c)
            for n, c in (("distance", "distance"), ("jockey_id", "jockey_id"), ("race_date", "date"))}
    rows = Keyed.of(e.select("race_id", "horse_number", "horse_id", "date", "distance", "jockey_id"), ["horse_id"], ORDER)
    return C.prev_deltas(rows.look_back(prev, 1).result()).select(
        "race_id", "horse_number", "distance_change", "jockey_change", "days_since_last_race")


# ---- within the race ----------------------------------------------------------------------------------------------

@on_entries("race_zscore", oracle("""
SELECT race_id, horse_number,
       CASE WHEN stddev_samp(horse_weight) OVER w > 0 THEN (horse_weight - avg(horse_weight) OVER w) / stddev_samp(horse_weight) OVER w END AS weight_z,
       CASE WHEN stddev_samp(finish_time_sec) OVER w > 0 THEN (avg(finish_time_sec) OVER w - finish_time_sec) / stddev_samp(finish_time_sec) OVER w END AS time_z
FROM e WINDOW w AS (PARTITION BY race_id)""", rounds=["weight_z", "time_z"]))
def _(e):
    return e.select("race_id", "horse_number", R.zscore("horse_weight").alias("weight_z"),
                    R.zscore("finish_time_sec", invert=True).alias("time_z"))


@on_entries("rank_keep", oracle("""
SELECT race_id, horse_number, CASE WHEN x IS NOT NULL THEN CAST(rank() OVER (PARTITION BY race_id ORDER BY x NULLS LAST) AS INT) END AS r
FROM (SELECT *, CASE WHEN horse_weight_diff < 5 THEN last_3f END AS x FROM e)"""))
def _(e):
    x = F.when(F.col("horse_weight_diff") < 5, F.col("last_3f"))
    return e.withColumn("x", x).select("race_id", "horse_number", R.rank_keep("x").alias("r"))


@on_entries("rank_bottom", oracle("""
SELECT race_id, horse_number, CAST(rank() OVER (PARTITION BY race_id ORDER BY x NULLS LAST) AS INT) AS r
FROM (SELECT *, CASE WHEN horse_weight_diff < 5 THEN last_3f END AS x FROM e)"""))
def _(e):
    x = F.when(F.col("horse_weight_diff") < 5, F.col("last_3f"))
    return e.withColumn("x", x).select("race_id", "horse_number", R.rank_bottom("x").alias("r"))


@on_entries("leader_count", oracle("""
SELECT race_id, horse_number, sum(CASE WHEN first_corner_pos <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY race_id) AS leaders
FROM e"""))
def _(e):
    return e.select("race_id", "horse_number", R.count_if(F.col("first_corner_pos") <= 5).alias("leaders"))


@on_entries("predicted_rank", oracle("""
SELECT race_id, horse_number, CAST(rank() OVER (PARTITION BY race_id ORDER BY win_prob_b DESC) AS INT) AS predicted_rank FROM e"""))
def _(e):
    return R.predicted_rank(en.predictions(e, "b")).select("race_id", "horse_number", "predicted_rank")


@on_entries("normalise_prob", oracle("""
SELECT race_id, horse_number, place_prob / sum(place_prob) OVER (PARTITION BY race_id) AS share FROM e""", rounds=["share"]))
def _(e):
    return R.normalise(e.select("race_id", "horse_number", "place_prob"), "place_prob", "share").drop("place_prob")


@on_entries("softmax_prob", oracle("""
SELECT race_id, horse_number, x / sum(x) OVER (PARTITION BY race_id) AS win_prob
FROM (SELECT *, exp(horse_weight / 10 - max(horse_weight / 10) OVER (PARTITION BY race_id)) AS x FROM e)""", rounds=["win_prob"]))
def _(e):
    return R.softmax(e.select("race_id", "horse_number", (F.col("horse_weight") / 10).alias("score"))).drop("score")


@on_entries("relevance_label", oracle("""
SELECT race_id, horse_number, CAST(max(finishing_position) OVER (PARTITION BY race_id) - finishing_position AS INT) AS relevance,
       count(*) OVER (PARTITION BY race_id) AS group_size FROM e"""))
def _(e):
    return R.relevance_label(e).select("race_id", "horse_number", "relevance", "group_size")


PICK = "row_number() OVER (PARTITION BY race_id ORDER BY win_prob_b DESC, horse_number)"


@on_entries("top1_pick", oracle(f"SELECT race_id, horse_number, is_win, odds FROM (SELECT *, {PICK} AS k FROM e) WHERE k = 1", rounds=["odds"]))
def _(e):
    return R.top1(e.select("race_id", "horse_number", "is_win", "odds", "win_prob_b"), "win_prob_b").drop("win_prob_b")


@on_entries("topn_pick", oracle(f"""
SELECT race_id, horse_number, CAST(k AS INT) AS pick FROM (SELECT *, {PICK} AS k FROM e) WHERE k <= 3 AND head_count >= 3"""))
def _(e):
    return R.topn(e.select("race_id", "horse_number", "win_prob_b"), 3, "win_prob_b").select("race_id", "horse_number", "pick")


@on_entries("dispersion_tier", oracle("""
SELECT race_id, d AS dispersion, CASE WHEN d <= q[1] THEN '混戦(オッズ横並び)' WHEN d <= q[2] THEN '普通' WHEN d IS NOT NULL THEN '本命はっきり(差が大きい)' END AS tier
FROM x, (SELECT quantile_cont(d, [1/3::DOUBLE, 2/3::DOUBLE]) AS q FROM x)""",
    "x AS (SELECT race_id, stddev_samp(ln(odds)) AS d FROM e WHERE odds > 0 GROUP BY race_id)", rounds=["dispersion"]))
def _(e):
    return R.dispersion_tier(e.select("race_id", "odds"))
