"""Exploration, data quality, stored tables and vectors."""

from __future__ import annotations

from datetime import date
from uuid import uuid4

from pyspark.sql import functions as F

from hindcast import schema as S
from hindcast.functions import clean as C
from hindcast.operators import explore as N
from hindcast.operators import quality as Q
from hindcast.operators import vectors as VX
from hindcast.plans import entries as en
from hindcast.plans.catalog.base import ORACLES, on_entries, oracle, register
from hindcast.plans.catalog.clean import RACES, RAW
from hindcast.plans.catalog.history import CUT, KEYS, O, PRIOR, daily_sql, history_upcoming
from hindcast.plans.oracle_base import PAYOFFS, POP_TIER
from hindcast.session import ensure_checkpoint_dir, stored
from hindcast.sources import store
from hindcast.sources.buckets import BucketedTable
from hindcast.streaming.odds import upsert_stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def percent_sql(payout: str, n: str) -> str:
    """Percent to one place, halves up, from sums in cents."""
    return (f"CAST((20 * sum(CAST(round({payout} * 100) AS BIGINT)) + 100 * {n}) // nullif(200 * {n}, 0) AS DOUBLE) / 10")


@register("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def _(spark, d):
    return N.table_counts({t: en.table(spark, d, t) for t in TABLES})


@register("yearly_counts", oracle("SELECT substr(date, 1, 4) AS year, count(*) AS n_races FROM ra GROUP BY 1", RACES))
def _(spark, d):
    return N.yearly_counts(en.race_table(spark, d))


@on_entries("null_rates", oracle("""
UNPIVOT (SELECT avg(CAST(odds IS NULL AS DOUBLE)) * 100 AS odds, avg(CAST(grade IS NULL AS DOUBLE)) * 100 AS grade,
                avg(CAST(try_cast(odds_text AS DOUBLE) IS NULL AS DOUBLE)) * 100 AS odds_text
         FROM (SELECT e.*, rr.odds AS odds_text FROM e JOIN rr ON rr.race_id = e.race_id AND rr.horse_number = CAST(e.horse_number AS VARCHAR)))
ON COLUMNS(*) INTO NAME "column" VALUE null_rate""", RAW, rounds=["null_rate"]))
def _(e):
    text = F.when(F.col("horse_weight_diff") == 9, "---").otherwise(F.col("odds").cast("string"))
    return N.null_rates(e.withColumn("odds_text", C.to_number(text)), ["odds", "grade", "odds_text"])


@on_entries("value_counts", oracle("SELECT popularity, count(*) AS n FROM e GROUP BY 1"))
def _(e):
    return N.value_counts(e, "popularity")


@on_entries("clipped_hist", oracle("""
SELECT CAST(least(floor((x - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin, count(*) AS n
FROM (SELECT least(odds, 50::DOUBLE) AS x FROM e), (SELECT min(least(odds, 50::DOUBLE)) AS lo, max(least(odds, 50::DOUBLE)) AS hi FROM e) GROUP BY 1"""))
def _(e):
    return N.clipped_hist(e, "odds")


BASE = f"""
bf AS (SELECT e.*, coalesce(w.v, 0) AS win_payout, coalesce(p.v, 0) AS place_payout, {POP_TIER.format('popularity')} AS popularity_tier
  FROM e LEFT JOIN (SELECT race_id, combination, CAST(replace(payout, ',', '') AS DOUBLE) AS v FROM pay WHERE bet_type = '単勝') w
    ON w.race_id = e.race_id AND w.combination = CAST(e.horse_number AS VARCHAR)
  LEFT JOIN (SELECT race_id, combination, CAST(replace(payout, ',', '') AS DOUBLE) AS v FROM pay WHERE bet_type = '複勝') p
    ON p.race_id = e.race_id AND p.combination = CAST(e.horse_number AS VARCHAR))"""


def base(e):
    return N.base_frame(e, en.payoffs(e))


@on_entries("base_frame", oracle(f"SELECT {KEYS}, win_payout, place_payout, popularity_tier FROM bf WHERE track_condition IN ('良', '稍重', '重', '不良') AND course_type IN ('F', 'O')",
                                 PAYOFFS, BASE))
def _(e):
    return N.valid_categories(base(e), ["F", "O"]).select("race_id", "horse_number", "win_payout", "place_payout", "popularity_tier")


for _name, _bet, _col in (("recovery_by_popularity", S.WIN, "win_payout"), ("place_recovery_by_popularity", S.PLACE, "place_payout")):
    on_entries(_name, oracle(f"""
SELECT popularity, count(*) AS n, sum({_col}) AS total_payout, {percent_sql(_col, 'count(*)')} AS recovery_rate
FROM bf GROUP BY popularity HAVING count(*) >= 30""", PAYOFFS, BASE))(lambda e, b=_bet: N.recovery_by(e, en.payoffs(e), bet=b))


def pivot_sql(axis: str, values, names, payout: str = "win_payout", source: str = "bf", *ctes: str) -> str:
    cols = []
    for v, n in zip(values, names):
        lit = f"'{v}'" if isinstance(v, str) else str(v)
        cols.append(f"""{percent_sql(f'CASE WHEN axis = {lit} THEN {payout} END', f'count(CASE WHEN axis = {lit} THEN 1 END)')} AS recovery_{n},
  count(CASE WHEN axis = {lit} THEN 1 END) AS n_{n}""")
    tiers = ", ".join(f"('{t}', {i})" for i, t in enumerate(S.POP_TIERS))
    return oracle(f"""
SELECT t.tier AS tier, t.tier_no AS tier_no, {', '.join(cols)}
FROM (VALUES {tiers}) t(tier, tier_no) LEFT JOIN (SELECT *, {axis} AS axis FROM {source}) x ON x.popularity_tier = t.tier GROUP BY 1, 2""",
        PAYOFFS, BASE, *ctes)


N4 = ["a", "b", "c", "d", "e", "f", "g", "h"]
DIST_SQL = ("CASE WHEN distance <= 1400 THEN '短距離(~1400m)' WHEN distance <= 1800 THEN 'マイル(1401-1800m)' "
            "WHEN distance <= 2400 THEN '中距離(1801-2400m)' ELSE '長距離(2401m~)' END")
_AXIS_SQL = {
    "course": ("course_type", ["F", "O"]),
    "track": ("track_condition", S.TRACK_CONDITIONS),
    "distance": (DIST_SQL, S.DISTANCE_BUCKETS),
    "head_count": ("CASE WHEN head_count <= 9 THEN '少頭数(~9頭)' WHEN head_count <= 15 THEN '中頭数(10-15頭)' ELSE '多頭数(16頭~)' END", S.HEAD_COUNT_BUCKETS),
    "grade": ("coalesce(grade, '平場')", list(reversed(S.GRADE_TIERS))),
    "bracket": ("bracket_number", list(range(1, 9))),
    "weight_diff": ("CASE WHEN horse_weight_diff <= -6 THEN '大幅減(-6kg以下)' WHEN horse_weight_diff >= 6 THEN '大幅増(+6kg以上)' ELSE '通常(-5~+5kg)' END",
                    S.WEIGHT_DIFF_BUCKETS),
}
for _axis, (_sql, _vals) in _AXIS_SQL.items():
    _key = "recovery_pivot" if _axis == "course" else f"{_axis}_axis"

    def _report(e, axis=_axis, vals=_vals):
        named = e.withColumn("race_name", F.concat(F.lit("R"), F.coalesce(F.concat(F.lit("("), F.col("grade"), F.lit(")")), F.lit(""))))
        return N.axis_report(base(named), axis, names=N4[:len(vals)], order=vals)
    on_entries(_key, pivot_sql(_sql, _vals, N4))(_report)


@on_entries("place_recovery_pivot", pivot_sql("track_condition", S.TRACK_CONDITIONS, N4, "place_payout"))
def _(e):
    return N.axis_report(base(e), "track", "place_payout", names=N4[:4])


@on_entries("dispersion_axis", oracle(f"""
SELECT {DIST_SQL} AS distance_band, CASE WHEN d <= q[1] THEN '混戦(オッズ横並び)' WHEN d <= q[2] THEN '普通' ELSE '本命はっきり(差が大きい)' END AS dispersion,
       popularity_tier, count(*) AS n, {percent_sql('win_payout', 'count(*)')} AS win_recovery, {percent_sql('place_payout', 'count(*)')} AS place_recovery
FROM bf JOIN dx USING (race_id), (SELECT quantile_cont(d, [1/3::DOUBLE, 2/3::DOUBLE]) AS q FROM dx)
WHERE track_condition = '良' AND d IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 30""", PAYOFFS, BASE,
    "dx AS (SELECT race_id, stddev_samp(ln(odds)) AS d FROM bf WHERE track_condition = '良' AND odds > 0 GROUP BY race_id)"))
def _(e):
    return N.dispersion_report(base(e))


@on_entries("entity_tier_whole", oracle("""
SELECT jockey_id, mounts, wins, win_rate, CASE WHEN win_rate <= q[1] THEN '下位(勝率)' WHEN win_rate <= q[2] THEN '中位(勝率)' ELSE '上位(勝率)' END AS tier
FROM st, (SELECT quantile_cont(win_rate, [1/3::DOUBLE, 2/3::DOUBLE]) AS q FROM st)""",
    "st AS (SELECT jockey_id, count(*) AS mounts, sum(is_win)::BIGINT AS wins, sum(is_win) / count(*)::DOUBLE AS win_rate FROM e GROUP BY 1 HAVING count(*) >= 500)",
    rounds=["win_rate"]))
def _(e):
    return N.entity_tier_whole(e, "jockey_id")


def _prior_sql(key: str, n: int, lo: float, hi: float) -> str:
    return pivot_sql("tier_prior", S.RATE_TIERS, ["low", "mid", "high"], "win_payout", "tp", daily_sql("dp", key), f"""
tp AS (SELECT *, CASE WHEN prior_mounts >= {n} THEN CASE WHEN prior_win_rate <= {lo} THEN '下位(勝率)' WHEN prior_win_rate >= {hi} THEN '上位(勝率)'
       ELSE '中位(勝率)' END END AS tier_prior FROM (SELECT bf.*, {PRIOR} FROM bf JOIN dp USING ({key}, date)))""")


def _prior(e, key: str, n: int, lo: float, hi: float):
    return N.recovery_pivot(N.entity_tier_prior(base(e), key, n, lo, hi), "tier_prior", S.RATE_TIERS, "win_payout", names=["low", "mid", "high"])


for _name, _key, _n, _lo, _hi in (("entity_tier_prior", "jockey_id", 50, 0.22, 0.26), ("trainer_tier_prior", "trainer_id", 500, 0.24, 0.25),
                                  ("sire_tier_prior", "sire", 300, 0.23, 0.26), ("owner_tier_prior", "owner", 10, 0.15, 0.3)):
    on_entries(_name, _prior_sql(_key, _n, _lo, _hi))(lambda e, a=(_key, _n, _lo, _hi): _prior(e, *a))


@on_entries("rest_days_axis", pivot_sql(
    "CASE WHEN d <= 13 THEN '連闘(~13日)' WHEN d <= 34 THEN '中2-4週(14-34日)' WHEN d <= 63 THEN '中5-8週(35-63日)' WHEN d <= 119 THEN '中9-16週(64-119日)' WHEN d IS NOT NULL THEN '休み明け(120日~)' END",
    S.REST_DAYS_BUCKETS, N4, "win_payout", "rd", f"rd AS (SELECT *, date - lag(date) OVER (PARTITION BY horse_id {O}) AS d FROM bf)"))
def _(e):
    return N.rest_days_report(base(e), names=N4[:5])


# ---- quality ------------------------------------------------------------------------------------------------------

MASTERS = (("horse", "horse_id", "part", "p_partkey", "p_retailprice > 1000", "sire"),
           ("jockey", "jockey_id", "supplier", "s_suppkey", "s_acctbal > 0", "venue"),
           ("owner", "owner", "customer", "c_custkey", "c_acctbal > 0", "venue"))


@register("missing_masters", oracle(" UNION ALL ".join(
    f"SELECT '{k}' AS kind, CAST({key} AS VARCHAR) AS id, min({name}) AS name FROM e WHERE {key} NOT IN (SELECT {pk} FROM {t} WHERE {cond}) GROUP BY {key}"
    for k, key, t, pk, cond, name in MASTERS)))
def _(spark, d):
    e, out = en.entries(spark, d), None
    for kind, key, t, pk, cond, name in MASTERS:
        master = en.table(spark, d, t).filter(cond).select(F.col(pk).alias(key))
        r = Q.missing_master(e, master, key, name).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(name).alias("name"))
        out = r if out is None else out.unionByName(r)
    return out


AS_OF = date(2000, 1, 1)


@register("missing_children", oracle("""
SELECT race_id, race_name, date FROM ra WHERE strptime(date, '%Y/%m/%d') < DATE '2000-01-01' AND NOT EXISTS (SELECT 1 FROM e WHERE e.race_id = ra.race_id)""", RACES))
def _(spark, d):
    return Q.missing_results(en.race_table(spark, d), en.entries(spark, d), AS_OF)


FINISHED_PAY = "fp AS (SELECT pay.* FROM pay JOIN rr ON rr.race_id = pay.race_id AND rr.finishing_position = '1')"


def _known_payoffs(e):
    """Payoffs exist where the winner's position is on record."""
    done = en.result_table(e).filter("finishing_position = '1'").select("race_id")
    return store.load_payoffs(en.payoffs(e), done)


@register("missing_payoffs", oracle("""
SELECT race_id, race_name, date FROM ra WHERE EXISTS (SELECT 1 FROM rr WHERE rr.race_id = ra.race_id AND regexp_matches(finishing_position, '^[0-9]+$'))
  AND NOT EXISTS (SELECT 1 FROM fp WHERE fp.race_id = ra.race_id)""", RACES, RAW, PAYOFFS, FINISHED_PAY))
def _(spark, d):
    e = en.entries(spark, d)
    return Q.missing_payoffs(en.race_table(spark, d), en.result_table(e), _known_payoffs(e))


BAD = """SELECT DISTINCT ra.race_id, race_name, date FROM ra JOIN rr USING (race_id)
WHERE regexp_matches(finishing_position, '^[0-9]+$') AND (odds IS NULL OR NOT regexp_matches(odds, '^[0-9.]+$'))"""


@register("bad_odds", oracle(BAD, RACES, RAW))
def _(spark, d):
    return Q.bad_odds(en.race_table(spark, d), en.result_table(en.entries(spark, d)))


@register("quality_summary", oracle(f"""
SELECT 'bad_odds' AS "check", count(*) AS n, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT CAST(race_id AS VARCHAR) AS k FROM ({BAD}) ORDER BY k LIMIT 10)) AS samples FROM ({BAD})
UNION ALL SELECT 'no_result', count(*), (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT CAST(race_id AS VARCHAR) AS k FROM nr ORDER BY k LIMIT 10)) FROM nr""",
    RACES, RAW, "nr AS (SELECT race_id FROM ra WHERE race_id NOT IN (SELECT race_id FROM e))"))
def _(spark, d):
    e, ra = en.entries(spark, d), en.race_table(spark, d)
    return Q.quality_summary({"bad_odds": Q.bad_odds(ra, en.result_table(e)), "no_result": Q.missing_results(ra, e, date(2100, 1, 1))})


@register("incomplete_master", oracle("""
SELECT DISTINCT race_id FROM e WHERE race_id NOT IN (SELECT race_id FROM ra WHERE trim(grade) <> '' AND grade IS NOT NULL)""", RACES))
def _(spark, d):
    return Q.incomplete_master(en.entries(spark, d), en.race_table(spark, d), "race_id", ["grade"])


@register("worklist_limit", oracle(f"SELECT * FROM ({BAD}) ORDER BY date DESC, race_id LIMIT 100", RACES, RAW))
def _(spark, d):
    return Q.worklist(Q.bad_odds(en.race_table(spark, d), en.result_table(en.entries(spark, d))), [F.desc("date"), "race_id"], 100)


# Work lists of the other checks: ids without a master row, and races without results. Suppliers stand for jockeys, and the
# first half of them has a master row.
@register("worklist_jockeys", """
SELECT l_suppkey AS jockey_id, 'J' || l_suppkey AS jockey_name FROM (SELECT DISTINCT l_suppkey FROM lineitem)
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) ORDER BY 1 LIMIT 50""")
def _(spark, d):
    used = en.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("jockey_id"), F.concat(F.lit("J"), F.col("l_suppkey").cast("string")).alias("jockey_name"))
    master = en.table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("jockey_id"))
    return Q.worklist(Q.missing_master(used, master, "jockey_id", "jockey_name"), ["jockey_id"], 50)


@register("worklist_trainers", """
SELECT o_custkey AS trainer_id, 'T' || o_custkey AS trainer_name FROM (SELECT DISTINCT o_custkey FROM orders)
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) ORDER BY 1 LIMIT 50""")
def _(spark, d):
    used = en.table(spark, d, "orders").select(F.col("o_custkey").alias("trainer_id"), F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("trainer_name"))
    master = en.table(spark, d, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("trainer_id"))
    return Q.worklist(Q.missing_master(used, master, "trainer_id", "trainer_name"), ["trainer_id"], 50)


@register("worklist_races", oracle("""
SELECT race_id, race_name, date FROM ra WHERE race_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY date DESC, race_id LIMIT 100""", RACES))
def _(spark, d):
    done = en.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("race_id"))
    return Q.worklist(Q.missing_results(en.race_table(spark, d), done, date(2100, 1, 1)), [F.desc("date"), "race_id"], 100)


# ---- stored tables ------------------------------------------------------------------------------------------------

EV = "events"
MID = "TIMESTAMP '2024-01-10 00:00:00'"


def _events(spark, d):
    ev = en.table(spark, d, EV)
    return ev.select("user_id", "event_type", "value", "ts", F.col("ts").alias("created_at"))


@register("upsert_latest", """
SELECT user_id, event_type, arg_max(value, {ts: ts, v: value}) AS value, max(ts) AS ts, min(ts) AS created_at FROM events GROUP BY 1, 2""")
def _(spark, d):
    ev = _events(spark, d)
    mid = F.expr(MID)
    text = ev.filter(F.col("ts") >= mid).withColumn("value", F.col("value").cast("string"))
    return store.upsert_latest(ev.filter(F.col("ts") < mid), text, ["user_id", "event_type"], "ts", "value")


@register("upsert", f"""
SELECT user_id, coalesce(b.value, a.value) AS value, coalesce(b.n, a.n) AS n, coalesce(a.created_at, b.created_at) AS created_at
FROM (SELECT user_id, max(value) AS value, count(*) AS n, min(ts) AS created_at FROM events WHERE ts < {MID} GROUP BY 1) a
FULL JOIN (SELECT user_id, max(value) AS value, count(*) AS n, min(ts) AS created_at FROM events WHERE ts >= {MID} GROUP BY 1) b USING (user_id)""")
def _(spark, d):
    ev = en.table(spark, d, EV)
    half = lambda c: ev.filter(c).groupBy("user_id").agg(
        F.max("value").alias("value"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("created_at"))
    mid = F.expr(MID)
    return store.upsert(half(F.col("ts") < mid), half(F.col("ts") >= mid), "user_id")


def _fresh(spark, name: str) -> str:
    """A new folder beside the checkpoints, which all executors see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"


@register("upsert_buckets", ORACLES["upsert"])
def _(spark, d):
    """The stored half is written in buckets, and the buckets of the other half's users are replaced."""
    ev = en.table(spark, d, EV)
    half = lambda c: ev.filter(c).groupBy("user_id").agg(
        F.max("value").alias("value"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("created_at"))
    mid = F.expr(MID)
    old = half(F.col("ts") < mid)
    table = BucketedTable(_fresh(spark, "upsert"), ("user_id",), old.schema, 16)
    table.upsert(old)
    table.upsert(half(F.col("ts") >= mid))
    return table.read(spark)


@register("stream_latest", """
SELECT user_id, event_type, arg_max(value, {ts: ts, v: value}) AS value, max(ts) AS ts, min(created_at) AS created_at
FROM (SELECT *, ts AS created_at FROM events) GROUP BY 1, 2""")
def _(spark, d):
    """All events as a stream of six files, each with every sixth day, so that most rows come late."""
    ev = _events(spark, d)
    source = _fresh(spark, "stream")
    for k in range(6):
        ev.filter(F.pmod(F.coalesce(F.dayofmonth("ts"), F.lit(0)), F.lit(6)) == k).coalesce(1).write.mode("append").parquet(source)
    table = BucketedTable(_fresh(spark, "latest"), ("user_id", "event_type"), ev.schema, 16)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 2).parquet(source)
    upsert_stream(stream, table, _fresh(spark, "offsets"), "ts", "value").awaitTermination()
    return table.read(spark)


@on_entries("replace_children", oracle("""
SELECT race_id, bet_type, combination, payout FROM pay WHERE race_id NOT IN (SELECT race_id FROM up)
UNION ALL SELECT race_id, bet_type, combination, '0' FROM pay WHERE race_id IN (SELECT race_id FROM up) AND bet_type = '単勝'""", CUT, PAYOFFS))
def _(e):
    pays = en.payoffs(e)
    _, up = history_upcoming(e)
    new = store.load_payoffs(pays, up.select("race_id").distinct()).filter(F.col("bet_type") == S.WIN).withColumn("payout", F.lit("0"))
    return store.replace_children(pays, new)


@register("replace_children_buckets", ORACLES["replace_children"])
def _(spark, d):
    e = stored(en.entries(spark, d).select("race_id", "horse_number", "date", "odds", "finishing_position"))
    pays = en.payoffs(e)
    _, up = history_upcoming(e)
    new = store.load_payoffs(pays, up.select("race_id").distinct()).filter(F.col("bet_type") == S.WIN).withColumn("payout", F.lit("0"))
    table = BucketedTable(_fresh(spark, "children"), ("race_id",), pays.schema, 16)
    table.replace_children(pays)
    table.replace_children(new)
    return table.read(spark)


@on_entries("load_payoffs", oracle("SELECT race_id, bet_type, combination, payout FROM pay WHERE race_id IN (SELECT race_id FROM up)", CUT, PAYOFFS))
def _(e):
    return store.load_payoffs(en.payoffs(e), history_upcoming(e)[1])


@register("load_upcoming", oracle("SELECT race_id, CAST(horse_number AS INT) AS horse_number, race_name FROM up JOIN ra USING (race_id)", CUT, RACES))
def _(spark, d):
    e = en.entries(spark, d)
    hist, up = history_upcoming(e)
    rows = hist.unionByName(up).withColumn("finishing_position", F.col("finishing_position").cast("string"))
    return store.load_upcoming(en.race_table(spark, d), rows, up).select("race_id", "horse_number", "race_name")


@on_entries("load_odds", oracle("SELECT race_id, horse_number, odds AS win_odds FROM e WHERE race_id IN (SELECT race_id FROM up)", CUT, rounds=["win_odds"]))
def _(e):
    return store.load_odds(e.select("race_id", "horse_number", F.col("odds").alias("win_odds")), history_upcoming(e)[1])


@register("missing_keys", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(spark, d):
    stored = en.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return store.missing_keys(en.table(spark, d, "orders"), stored, "o_orderkey")


@register("existing_keys", "SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def _(spark, d):
    stored = en.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return store.existing_keys(en.table(spark, d, "orders"), stored, "o_orderkey")


@register("latest_month", "SELECT CAST(year(max(o_orderdate)) AS INT) AS year, CAST(month(max(o_orderdate)) AS INT) AS month FROM orders")
def _(spark, d):
    return store.latest_month(en.race_table(spark, d))


@register("month_range", """
SELECT CAST(year(m) AS INT) AS year, CAST(month(m) AS INT) AS month
FROM (SELECT unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS m
      FROM (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders))""")
def _(spark, d):
    span = en.table(spark, d, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return store.month_range(span, F.col("a"), F.col("b"))


@register("filter_venues", oracle(f"SELECT {KEYS}, venue FROM e WHERE venue IN ('A', 'N') AND substr(lpad(CAST(race_id AS VARCHAR), 12, '0'), 11, 2) IN ('05', '06', '77')"
                                  .replace("11, 2", "11, 2")))
def _(spark, d):
    e = en.entries(spark, d)
    ids = F.concat(F.lit("2024"), F.lpad(F.col("race_id").cast("string"), 12, "0").substr(11, 2), F.col("race_id").cast("string"))
    rows = e.select("race_id", "horse_number", "venue", F.struct("race_id", "horse_number").alias("k")).withColumn("race_id", ids)
    return store.filter_venues(rows, ["A", "N"], ["05", "06", "77"]).select("k.*", "venue")


@on_entries("with_raw_json", oracle("""
SELECT race_id, horse_number, CAST(to_json({'race_id': race_id, 'horse_number': horse_number, 'sire': sire, 'grade': grade}) AS VARCHAR) AS raw_data FROM e"""))
def _(e):
    return store.with_raw_json(e.select("race_id", "horse_number", "sire", "grade")).select("race_id", "horse_number", "raw_data")


@register("ad_hoc_sql", oracle("SELECT sire, count(*) AS n, avg(odds) AS mean_odds FROM e WHERE odds < 5 GROUP BY sire", rounds=["mean_odds"]))
def _(spark, d):
    return store.query(spark, "SELECT sire, count(*) AS n, avg(odds) AS mean_odds FROM {e} WHERE odds < :top GROUP BY sire", {"top": 5},
                       e=en.entries(spark, d))


# ---- vectors ------------------------------------------------------------------------------------------------------

DIM = 64


def vector_table(spark, d):
    return en.table(spark, d, "embeddings").select(F.lit("owner").alias("category"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@register("mean_vectors", "SELECT CAST(label AS VARCHAR) AS category, " + ", ".join(
    f"round(avg(CAST(embedding[{i + 1}] AS DOUBLE)), 6) + 0.0::DOUBLE AS m{i}" for i in range(DIM)) + " FROM embeddings GROUP BY 1")
def _(spark, d):
    v = en.table(spark, d, "embeddings").select(F.col("label").cast("string").alias("category"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return VX.mean_vectors(v, DIM).select("category", *[F.col("vec")[i].alias(f"m{i}") for i in range(DIM)])


@register("vector_lookup_mean", "SELECT c_custkey, " + ", ".join(
    f"round(coalesce(CAST(embedding[{i + 1}] AS DOUBLE), m{i}), 6) + 0.0::DOUBLE AS owner_emb_{i}" for i in range(DIM))
    + " FROM customer LEFT JOIN embeddings ON vec_id = c_custkey, (SELECT "
    + ", ".join(f"avg(CAST(embedding[{i + 1}] AS DOUBLE)) AS m{i}" for i in range(DIM)) + " FROM embeddings)")
def _(spark, d):
    c = en.table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("owner"))
    return VX.add_vectors(c, vector_table(spark, d), ["owner"]).drop("owner")


@register("cosine_topn", """
SELECT id, round(similarity, 6) AS similarity FROM (
  SELECT e.vec_id AS id, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[]))
         / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(t.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])))) AS similarity
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) t WHERE e.vec_id <> 0) ORDER BY similarity DESC, id LIMIT 10""")
def _(spark, d):
    return VX.cosine_topn(vector_table(spark, d), "owner", 0, 10)


@register("vector_covariance", f"""
WITH v AS (SELECT CAST(label AS VARCHAR) AS category, vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT a.category, CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, count(*) AS n, round(covar_samp(a.x, b.x), 6) + 0.0::DOUBLE AS cov
FROM v a JOIN v b ON a.category = b.category AND a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL""")
def _(spark, d):
    v = en.table(spark, d, "embeddings").select(F.col("label").cast("string").alias("category"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    rows = VX.covariances(v).select("category", "n", F.posexplode("cov").alias("i", "row"))
    cells = rows.select("category", "n", "i", F.posexplode("row").alias("j", "cov")).filter("i <= j")
    return cells.select("category", (F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), "n", "cov")


@register("pca_vectors")
def _(spark, d):
    return VX.pca_vectors(vector_table(spark, d), 8)
