"""Point-in-time features and time splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.tiers import rate_tier
from hindcast.operators import cuts as K
from hindcast.operators import history as H
from hindcast.operators import serving as V
from hindcast.operators import splits as D
from hindcast.operators.keyed import Keyed
from hindcast.operators.race import pace
from hindcast.plans.catalog.base import on_entries, oracle
from hindcast.session import stored

KEYS = "race_id, horse_number"
#: Columns of the entries that the features for training and serving are made of.
HISTORY = ["race_id", "horse_number", "horse_id", "date", "jockey_id", "trainer_id", "owner", "sire", "venue", "course_type", "distance",
           "bracket_number", "class_level", "finishing_position", "is_win", "is_placed", "first_corner_pos", "last_3f", "finish_time_sec",
           "horse_weight", "weight_carried"]
CUT_DAYS = """
days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM e)),
cut AS (SELECT max(CASE WHEN i = CAST(floor(n * (1 - 0.1::DOUBLE - 0.2::DOUBLE)) AS BIGINT) THEN date END) AS val_from,
               max(CASE WHEN i = CAST(floor(n * (1 - 0.2::DOUBLE)) AS BIGINT) THEN date END) AS test_from FROM days)"""
O = "ORDER BY date, race_id, horse_id, horse_number"  # noqa: E741

MEASURED = """
m AS (
  SELECT *, CASE WHEN stddev_samp(finish_time_sec) OVER r > 0
                 THEN (avg(finish_time_sec) OVER r - finish_time_sec) / stddev_samp(finish_time_sec) OVER r END AS race_time_zscore,
         rank() OVER (PARTITION BY race_id ORDER BY last_3f) AS last_3f_rank
  FROM e WINDOW r AS (PARTITION BY race_id)
)"""
STEMS = {"finishing_position": "avg_finish", "last_3f": "avg_last3f", "first_corner_pos": "avg_corner",
         "last_3f_rank": "avg_last3f_rank", "race_time_zscore": "avg_speed_index"}


def _recent_sql(key: str, cond: bool, frame: str = "{n} PRECEDING AND 1 PRECEDING", off: int = 0) -> tuple[str, list[str]]:
    out, names, tail = [], [], "_cond" if cond else ""
    for n in (3, 5):
        w = f"OVER (PARTITION BY {key} {O} ROWS BETWEEN {frame.format(n=n - off)})"
        for col, stem in STEMS.items():
            if not (cond and stem == "avg_speed_index"):
                names.append(f"{stem}_last{n}{tail}")
                out.append(f"avg({col}) {w} AS {names[-1]}")
        names.append(f"best_finish_last{n}{tail}")
        out.append(f"min(finishing_position) {w} AS {names[-1]}")
    return ", ".join(out), names


def _doubles(names):
    return [n for n in names if not n.startswith("best_")]


@on_entries("lag_features", oracle(f"""
SELECT {KEYS}, CAST(date - lag(date) OVER w AS DOUBLE) AS days_since_last_race, CAST(distance - lag(distance) OVER w AS DOUBLE) AS distance_change,
       class_level - lag(class_level) OVER w AS class_change,
       CASE WHEN lag(course_type) OVER w IS NOT NULL THEN CAST(course_type <> lag(course_type) OVER w AS DOUBLE) END AS course_type_change,
       CASE WHEN lag(jockey_id) OVER w IS NOT NULL THEN CAST(jockey_id <> lag(jockey_id) OVER w AS DOUBLE) END AS jockey_change
FROM e WINDOW w AS (PARTITION BY horse_id {O})"""))
def _(e):
    cols = ["race_id", "horse_number", "horse_id", "date", "distance", "class_level", "course_type", "jockey_id"]
    return H.lag_features(e.select(*cols)).select("race_id", "horse_number", *H.LAGS)


_ROLL, _ROLL_N = _recent_sql("horse_id", False)
_COND, _COND_N = _recent_sql("horse_id, course_type, distance", True)
_FACTS = ["race_id", "horse_number", "horse_id", "date", "course_type", "distance", *STEMS]


@on_entries("rolling_3_5", oracle(f"SELECT {KEYS}, {_ROLL} FROM m", MEASURED, rounds=_doubles(_ROLL_N)))
def _(e):
    rows = Keyed.of(H.race_measures(e).select(*_FACTS), ["horse_id"], H.ORDER)
    return rows.look_back(H.recent_exprs(), 5).result().select("race_id", "horse_number", *_ROLL_N)


@on_entries("rolling_cond", oracle(f"SELECT {KEYS}, {_COND} FROM m", MEASURED, rounds=_doubles(_COND_N)))
def _(e):
    rows = Keyed.of(H.race_measures(e).select(*_FACTS), ["horse_id"], H.ORDER)
    return rows.look_back(H.recent_exprs(cond=True), 5, within=H.COND).result().select("race_id", "horse_number", *_COND_N)


@on_entries("cum_rate_venue", oracle(f"""
SELECT {KEYS}, avg(CAST(is_win AS DOUBLE)) OVER (PARTITION BY jockey_id, venue, course_type {O}
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rate FROM e""", rounds=["rate"]))
def _(e):
    f = e.select("race_id", "horse_number", "horse_id", "date", "jockey_id", "venue", "course_type", "is_win")
    return H.cum_rate(f, ["jockey_id", "venue", "course_type"], "is_win", "rate").select("race_id", "horse_number", "rate")


@on_entries("last30_rate", oracle(f"""
SELECT {KEYS}, avg(is_win) OVER (PARTITION BY trainer_id {O} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS rate FROM e""", rounds=["rate"]))
def _(e):
    f = e.select("race_id", "horse_number", "horse_id", "date", "trainer_id", "is_win")
    return H.last_rate(f, "trainer_id", "is_win", 30, "rate").select("race_id", "horse_number", "rate")


def daily_sql(name: str, key: str, flag: str = "is_win", table: str = "e") -> str:
    """Rows and total of a flag before each day of a key, from daily totals."""
    part = f"PARTITION BY {key} " if key else ""
    cols = f"{key}, " if key else ""
    return f"""
{name} AS (SELECT {cols}date, coalesce(sum(n) OVER w, 0) AS n, coalesce(sum(s) OVER w, 0) AS s
  FROM (SELECT {cols}date, count({flag}) AS n, sum({flag}) AS s FROM {table} GROUP BY ALL)
  WINDOW w AS ({part}ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


PRIOR = "CAST(n AS DOUBLE) AS prior_mounts, s / nullif(CAST(n AS DOUBLE), 0) AS prior_win_rate"


for _key, _name in (("jockey_id", "jockey"), ("trainer_id", "trainer"), ("owner", "owner")):
    def _rate(e, key=_key):
        f = e.select("race_id", "horse_number", "date", key, "is_win")
        return H.asof_rate(f, key).select("race_id", "horse_number", "prior_mounts", "prior_win_rate")
    on_entries(f"asof_rate_{_name}", oracle(f"SELECT {KEYS}, {PRIOR} FROM e JOIN dp USING ({_key}, date)", daily_sql("dp", _key),
                                            rounds=["prior_win_rate"]))(_rate)


SIRE_DAYS = daily_sql("sp", "sire, course_type", "is_placed")
SPEED_DAYS = daily_sql("sz", "sire, course_type", "race_time_zscore", "m")


@on_entries("shrunk_rate", oracle(f"""
SELECT {KEYS}, (s + 20 * (SELECT avg(is_placed) FROM e)) / (n + 20) AS rate, CAST(n AS DOUBLE) AS mounts
FROM e JOIN sp USING (sire, course_type, date)""", SIRE_DAYS, rounds=["rate"]))
def _(e):
    f = e.select("race_id", "horse_number", "date", "sire", "course_type", "is_placed")
    return H.asof_shrunk_rate(f, ["sire", "course_type"], out="rate", out_n="mounts").select("race_id", "horse_number", "rate", "mounts")


@on_entries("shrunk_rate_asof", oracle(f"""
SELECT {KEYS}, (sp.s + 20 * coalesce(g.s / nullif(CAST(g.n AS DOUBLE), 0), 0)) / (sp.n + 20) AS rate
FROM e JOIN sp USING (sire, course_type, date) JOIN g ON g.date = e.date""", SIRE_DAYS, daily_sql("g", "", "is_placed"), rounds=["rate"]))
def _(e):
    f = e.select("race_id", "horse_number", "date", "sire", "course_type", "is_placed")
    return H.asof_shrunk_rate(f, ["sire", "course_type"], prior="asof", out="rate").select("race_id", "horse_number", "rate")


@on_entries("shrunk_mean", oracle(f"""
SELECT {KEYS}, s / (n + 10) AS speed FROM m JOIN sz USING (sire, course_type, date)""",
    MEASURED, SPEED_DAYS, rounds=["speed"]))
def _(e):
    f = H.race_measures(e).select("race_id", "horse_number", "date", "sire", "course_type", "race_time_zscore")
    return H.asof_shrunk_mean(f, ["sire", "course_type"], out="speed").select("race_id", "horse_number", "speed")


BAND_SQL = ("CASE WHEN distance <= 0 OR distance > 10000 THEN NULL WHEN distance <= 1400 THEN 0 WHEN distance <= 1800 THEN 1 "
            "WHEN distance <= 2200 THEN 2 ELSE 3 END")


@on_entries("bracket_cum_mean", oracle(f"""
SELECT {KEYS}, avg(finishing_position) OVER (PARTITION BY bracket_number, band {O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean_finish
FROM (SELECT *, {BAND_SQL} AS band FROM e)""", rounds=["mean_finish"]))
def _(e):
    f = e.select("race_id", "horse_number", "horse_id", "date", "bracket_number", "distance", "finishing_position")
    return H.bracket_cum_mean(f, out="mean_finish").select("race_id", "horse_number", "mean_finish")


@on_entries("rolling_any", oracle(f"""
SELECT {KEYS}, avg(odds) OVER w AS avg_odds_last4, min(odds) OVER w AS min_odds_last4
FROM e WINDOW w AS (PARTITION BY owner {O} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""", rounds=["avg_odds_last4", "min_odds_last4"]))
def _(e):
    f = e.select("race_id", "horse_number", "horse_id", "date", "owner", "odds")
    return H.rolling(f, ["owner"], ["odds"], 4, ("avg", "min")).select("race_id", "horse_number", "avg_odds_last4", "min_odds_last4")


@on_entries("pace", oracle(f"""
SELECT {KEYS}, CAST(rank() OVER (PARTITION BY race_id ORDER BY c NULLS LAST) AS INT) AS corner_style_race_rank,
       sum(CASE WHEN c <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY race_id) AS race_leader_count
FROM (SELECT *, avg(first_corner_pos) OVER (PARTITION BY horse_id {O} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS c FROM e)"""))
def _(e):
    rows = Keyed.of(e.select("race_id", "horse_number", "horse_id", "date", "first_corner_pos"), ["horse_id"], H.ORDER)
    out = rows.look_back({"avg_corner_last3": H.mean_last("first_corner_pos", 3)}, 3).result()
    return pace(out).select("race_id", "horse_number", "corner_style_race_rank", "race_leader_count")


@on_entries("decay_weight", oracle(f"""
SELECT {KEYS}, pow(0.5::DOUBLE, ((SELECT max(date) FROM e) - date) / 1095.0::DOUBLE) AS w FROM e""", rounds=["w"]))
def _(e):
    ref = e.agg(F.max("date")).scalar()
    return e.select("race_id", "horse_number", H.decay_weight("date", ref, 1095.0).alias("w"))


@on_entries("rate_tier", oracle(f"""
SELECT {KEYS}, CASE WHEN prior_mounts >= 100 THEN CASE WHEN prior_win_rate <= 0.22 THEN '下位(勝率)' WHEN prior_win_rate >= 0.26 THEN '上位(勝率)'
       ELSE '中位(勝率)' END END AS tier FROM (SELECT {KEYS}, {PRIOR} FROM e JOIN dp USING (jockey_id, date))""", daily_sql("dp", "jockey_id")))
def _(e):
    f = H.asof_rate(e.select("race_id", "horse_number", "date", "jockey_id", "is_win"), "jockey_id")
    return f.select("race_id", "horse_number", rate_tier("prior_win_rate", "prior_mounts", 100, 0.22, 0.26).alias("tier"))


_ALL_PICK = ["avg_finish_last3", "best_finish_last5", "avg_speed_index_last5", "avg_corner_last3_cond", "jockey_win_rate_venue_cond",
             "trainer_win_rate_last30", "owner_prior_win_rate", "sire_place_rate_cond", "sire_avg_speed_index_cond",
             "bracket_distance_avg_finish"]
_ALL_SQL = f"""
SELECT {KEYS}, avg(finishing_position) OVER (h ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS avg_finish_last3,
  min(finishing_position) OVER (h ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS best_finish_last5,
  avg(race_time_zscore) OVER (h ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS avg_speed_index_last5,
  avg(first_corner_pos) OVER (PARTITION BY horse_id, course_type, distance {O} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS avg_corner_last3_cond,
  avg(is_win) OVER (PARTITION BY jockey_id, venue, course_type {O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS jockey_win_rate_venue_cond,
  avg(is_win) OVER (PARTITION BY trainer_id {O} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS trainer_win_rate_last30,
  dp.s / nullif(CAST(dp.n AS DOUBLE), 0) AS owner_prior_win_rate,
  (sp.s + 20 * (SELECT avg(is_placed) FROM e)) / (sp.n + 20) AS sire_place_rate_cond, sz.s / (sz.n + 10) AS sire_avg_speed_index_cond,
  avg(finishing_position) OVER (PARTITION BY bracket_number, {BAND_SQL} {O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bracket_distance_avg_finish
FROM m JOIN dp USING (owner, date) JOIN sp USING (sire, course_type, date) JOIN sz USING (sire, course_type, date)
WINDOW h AS (PARTITION BY horse_id {O})"""


@on_entries("training_features", oracle(_ALL_SQL, MEASURED, daily_sql("dp", "owner"), SIRE_DAYS, SPEED_DAYS, rounds=[c for c in _ALL_PICK if not c.startswith("best")]), store=HISTORY)
def _(e):
    return H.training_features(e).select("race_id", "horse_number", *_ALL_PICK)


# ---- features under history cuts ----------------------------------------------------------------------------------

_CUT_PICK = ["days_since_last_race", "distance_change", "class_change", "course_type_change", "jockey_change", *_ROLL_N, *_COND_N,
             "jockey_win_rate_venue_cond", "trainer_win_rate_last30", "bracket_distance_avg_finish", "trainer_prior_mounts", "trainer_prior_win_rate",
             "jockey_prior_mounts", "jockey_prior_win_rate", "owner_prior_mounts", "owner_prior_win_rate", "sire_place_rate_cond",
             "sire_progeny_mounts_cond", "sire_avg_speed_index_cond"]


def _prior_sql(name: str, keys: str, col: str) -> str:
    """Non-null values and their sum before each day of a key, recomputed for each cut."""
    return f"""
{name} AS (SELECT k, {keys}, date, coalesce(sum(n) OVER w, 0) AS n, coalesce(sum(s) OVER w, 0) AS s FROM (
  SELECT k, {keys}, date, count({col}) AS n, coalesce(sum({col}), 0) AS s FROM c GROUP BY ALL)
  WINDOW w AS (PARTITION BY k, {keys} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


_PRIORS = [("pt", "trainer_id", "is_win"), ("pj", "jockey_id", "is_win"), ("po", "owner", "is_win"), ("ps", "sire, course_type", "is_placed"),
           ("pz", "sire, course_type", "race_time_zscore")]
_OF_CUT = lambda sql, key: sql.replace(f"PARTITION BY {key}", f"PARTITION BY k, {key}")


@on_entries("cut_features", oracle(f"""
SELECT c.k AS years, race_id, horse_number, CAST(date - lag(date) OVER h AS DOUBLE) AS days_since_last_race,
  CAST(distance - lag(distance) OVER h AS DOUBLE) AS distance_change, class_level - lag(class_level) OVER h AS class_change,
  CASE WHEN lag(course_type) OVER h IS NOT NULL THEN CAST(course_type <> lag(course_type) OVER h AS DOUBLE) END AS course_type_change,
  CASE WHEN lag(jockey_id) OVER h IS NOT NULL THEN CAST(jockey_id <> lag(jockey_id) OVER h AS DOUBLE) END AS jockey_change,
  {_OF_CUT(_ROLL, "horse_id")}, {_OF_CUT(_COND, "horse_id")},
  avg(is_win) OVER (PARTITION BY k, jockey_id, venue, course_type {O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS jockey_win_rate_venue_cond,
  avg(is_win) OVER (PARTITION BY k, trainer_id {O} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS trainer_win_rate_last30,
  avg(finishing_position) OVER (PARTITION BY k, bracket_number, band {O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bracket_distance_avg_finish,
  CAST(pt.n AS DOUBLE) AS trainer_prior_mounts, pt.s / nullif(CAST(pt.n AS DOUBLE), 0) AS trainer_prior_win_rate,
  CAST(pj.n AS DOUBLE) AS jockey_prior_mounts, pj.s / nullif(CAST(pj.n AS DOUBLE), 0) AS jockey_prior_win_rate,
  CAST(po.n AS DOUBLE) AS owner_prior_mounts, po.s / nullif(CAST(po.n AS DOUBLE), 0) AS owner_prior_win_rate,
  (ps.s + 20 * placed) / (ps.n + 20) AS sire_place_rate_cond, CAST(ps.n AS DOUBLE) AS sire_progeny_mounts_cond, pz.s / (pz.n + 10) AS sire_avg_speed_index_cond
FROM c JOIN pt USING (k, trainer_id, date) JOIN pj USING (k, jockey_id, date) JOIN po USING (k, owner, date) JOIN ps USING (k, sire, course_type, date)
JOIN pz USING (k, sire, course_type, date) JOIN (SELECT k, avg(is_placed) AS placed FROM c GROUP BY k) USING (k)
WINDOW h AS (PARTITION BY k, horse_id {O})""",
    MEASURED, CUT_DAYS, f"""
c AS (SELECT k, m.*, {BAND_SQL} AS band FROM m, cut, (VALUES ('2', 2), ('4', 4), ('6', 6), ('8', 8), ('all', NULL)) y(k, years)
      WHERE years IS NULL OR date >= val_from - CAST(365 * years AS INT))""", *[_prior_sql(*p) for p in _PRIORS],
    rounds=[c for c in _CUT_PICK if not c.startswith("best_")]), store=HISTORY)
def _(e):
    """The features of all five history lengths, from one run."""
    cuts = K.history_cuts(D.cut_dates(e)[0])
    every = K.cut_features(e, cuts)  # all features of all cuts are written, the entries' own facts are not read again
    wide = stored(every.select(*K.KEY, "date", *[c for c in every.columns if "__" in c]))
    parts = [K.of_cut(wide, k, first).select(F.lit(k).alias("years"), "race_id", "horse_number", *_CUT_PICK) for k, first in cuts.items()]
    return reduce(DataFrame.unionByName, parts)


# ---- serving: the test period is upcoming, everything before it is history ----------------------------------------

CUT = f"""{CUT_DAYS},
hist AS (SELECT * FROM e WHERE date < (SELECT test_from FROM cut)),
up AS (SELECT * FROM e WHERE date >= (SELECT test_from FROM cut))"""


def history_upcoming(e):
    _, test_from = D.cut_dates(e)
    gone = {c: F.lit(None).cast(t) for c, t in e.dtypes if c in ("finishing_position", "is_win", "is_placed", "finish_time_sec",
                                                                 "last_3f", "first_corner_pos")}
    return e.filter(F.col("date") < F.lit(test_from)), e.filter(F.col("date") >= F.lit(test_from)).withColumns(gone)


_STATE, _STATE_N = _recent_sql("horse_id", False, "{n} PRECEDING AND CURRENT ROW", 1)
_STATE_C, _STATE_CN = _recent_sql("horse_id, course_type, distance", True, "{n} PRECEDING AND CURRENT ROW", 1)
HIST_M = MEASURED.replace("m AS (", "hm AS (").replace("FROM e", "FROM hist")


@on_entries("serve_latest_state", oracle(f"""
SELECT up.race_id, up.horse_number, {', '.join(_STATE_N)}, {', '.join(_STATE_CN)}, prev_distance, prev_jockey_id, prev_race_date
FROM up LEFT JOIN st ON up.horse_id = st.horse_id AND st.rn = 1
LEFT JOIN sc ON up.horse_id = sc.horse_id AND up.course_type = sc.course_type AND up.distance = sc.distance AND sc.rn = 1""",
    CUT, HIST_M,
    f"""st AS (SELECT horse_id, distance AS prev_distance, jockey_id AS prev_jockey_id, date AS prev_race_date, {_STATE},
             row_number() OVER (PARTITION BY horse_id ORDER BY date DESC, race_id DESC, horse_number DESC) AS rn FROM hm)""",
    f"""sc AS (SELECT horse_id, course_type, distance, {_STATE_C},
             row_number() OVER (PARTITION BY horse_id, course_type, distance ORDER BY date DESC, race_id DESC, horse_number DESC) AS rn FROM hm)""",
    rounds=_doubles(_STATE_N + _STATE_CN)), store=HISTORY)
def _(e):
    hist, up = history_upcoming(e)
    keep = ["race_id", "horse_number", "horse_id", "date", "jockey_id", "course_type", "distance"]
    return V.serve_latest_state(hist, up.select(*keep)).select(
        "race_id", "horse_number", *_STATE_N, *_STATE_CN, "prev_distance", "prev_jockey_id", "prev_race_date")


@on_entries("serve_rates_before_date", oracle("""
SELECT key, kind, up_date AS as_of, CAST(n AS DOUBLE) AS mounts, CASE WHEN n > 0 THEN w / n END AS rate FROM (
  SELECT k.kind, k.key, k.up_date, sum(coalesce(h.n, 0)) AS n, sum(coalesce(h.w, 0)) AS w
  FROM (SELECT DISTINCT 'jockey' AS kind, jockey_id AS key, date AS up_date FROM up
        UNION SELECT DISTINCT 'owner', owner, date FROM up UNION SELECT DISTINCT 'trainer', trainer_id, date FROM up) k
  LEFT JOIN (SELECT 'jockey' AS kind, jockey_id AS key, date, count(*) AS n, sum(CAST(is_win AS DOUBLE)) AS w FROM hist GROUP BY ALL
             UNION ALL SELECT 'owner', owner, date, count(*), sum(CAST(is_win AS DOUBLE)) FROM hist GROUP BY ALL
             UNION ALL SELECT 'trainer', trainer_id, date, count(*), sum(CAST(is_win AS DOUBLE)) FROM hist GROUP BY ALL) h
    ON h.kind = k.kind AND h.key = k.key AND h.date < k.up_date
  GROUP BY k.kind, k.key, k.up_date)""", CUT, rounds=["rate"]))
def _(e):
    hist, up = history_upcoming(e)
    out = None
    for kind, key in (("jockey", "jockey_id"), ("owner", "owner"), ("trainer", "trainer_id")):
        r = V.rate_before(hist.select(key, "date", "is_win"), V.targets_of(up, [key]), key).select(
            F.col(key).alias("key"), F.lit(kind).alias("kind"), "as_of", F.col("prior_mounts").alias("mounts"),
            F.col("prior_win_rate").alias("rate"))
        out = r if out is None else out.unionByName(r)
    return out


_SERVE = ["avg_finish_last5", "avg_corner_last3_cond", "jockey_win_rate_venue_cond", "trainer_win_rate_last30", "trainer_prior_win_rate",
          "owner_prior_mounts", "sire_place_rate_cond", "sire_avg_speed_index_cond", "bracket_distance_avg_finish", "distance_change",
          "jockey_change", "class_change", "days_since_last_race"]


@on_entries("serve_assemble", oracle(f"""
SELECT up.race_id, up.horse_number, st.avg_finish_last5, sc.avg_corner_last3_cond, jv.rate AS jockey_win_rate_venue_cond,
       t30.rate AS trainer_win_rate_last30, tr.rate AS trainer_prior_win_rate, ow.n AS owner_prior_mounts,
       (coalesce(sp.s, 0) + 20 * g.rate) / (coalesce(sp.n, 0) + 20) AS sire_place_rate_cond,
       coalesce(ss.s / (ss.n + 10), 0) AS sire_avg_speed_index_cond, br.rate AS bracket_distance_avg_finish,
       CAST(up.distance - st.prev_distance AS DOUBLE) AS distance_change,
       CAST(up.jockey_id <> st.prev_jockey_id AS DOUBLE) AS jockey_change, up.class_level - st.prev_class AS class_change,
       CAST(up.date - st.prev_date AS DOUBLE) AS days_since_last_race
FROM up
LEFT JOIN (SELECT horse_id, distance AS prev_distance, jockey_id AS prev_jockey_id, class_level AS prev_class, date AS prev_date,
        avg(finishing_position) OVER (PARTITION BY horse_id {O} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS avg_finish_last5,
        row_number() OVER (PARTITION BY horse_id ORDER BY date DESC, race_id DESC, horse_number DESC) AS rn FROM hm) st
  ON st.horse_id = up.horse_id AND st.rn = 1
LEFT JOIN (SELECT horse_id, course_type, distance,
        avg(first_corner_pos) OVER (PARTITION BY horse_id, course_type, distance {O} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS avg_corner_last3_cond,
        row_number() OVER (PARTITION BY horse_id, course_type, distance ORDER BY date DESC, race_id DESC, horse_number DESC) AS rn FROM hm) sc
  ON sc.horse_id = up.horse_id AND sc.course_type = up.course_type AND sc.distance = up.distance AND sc.rn = 1
LEFT JOIN (SELECT jockey_id, venue, course_type, avg(is_win) AS rate FROM hist GROUP BY ALL) jv
  ON jv.jockey_id = up.jockey_id AND jv.venue = up.venue AND jv.course_type = up.course_type
LEFT JOIN (SELECT trainer_id, avg(is_win) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY trainer_id ORDER BY date DESC, race_id DESC,
        horse_id DESC, horse_number DESC) AS rn FROM hist) WHERE rn <= 30 GROUP BY trainer_id) t30 ON t30.trainer_id = up.trainer_id
LEFT JOIN (SELECT trainer_id, avg(is_win) AS rate FROM hist GROUP BY ALL) tr ON tr.trainer_id = up.trainer_id
LEFT JOIN (SELECT owner, CAST(count(*) AS DOUBLE) AS n FROM hist GROUP BY ALL) ow ON ow.owner = up.owner
LEFT JOIN (SELECT sire, course_type, sum(is_placed) AS s, count(*) AS n FROM hist GROUP BY ALL) sp ON sp.sire = up.sire AND sp.course_type = up.course_type
LEFT JOIN (SELECT sire, course_type, sum(race_time_zscore) AS s, count(race_time_zscore) AS n FROM hm GROUP BY ALL) ss
  ON ss.sire = up.sire AND ss.course_type = up.course_type
LEFT JOIN (SELECT bracket_number, {BAND_SQL} AS band, avg(finishing_position) AS rate FROM hist GROUP BY ALL) br
  ON br.bracket_number = up.bracket_number AND br.band = {BAND_SQL.replace('distance', 'up.distance')}
CROSS JOIN (SELECT avg(is_placed) AS rate FROM hist) g""", CUT, HIST_M, rounds=_SERVE), store=HISTORY)
def _(e):
    hist, up = history_upcoming(e)
    return V.serve_assemble(hist, up.drop("odds", "tenths")).select("race_id", "horse_number", *_SERVE)


# ---- splits -------------------------------------------------------------------------------------------------------

@on_entries("split_by_date", oracle(f"""
SELECT {KEYS}, CASE WHEN date < val_from THEN 'train' WHEN date < test_from THEN 'val' ELSE 'test' END AS role FROM e, cut""", CUT))
def _(e):
    return D.split_roles(e.select("race_id", "horse_number", "date")).drop("date")


@on_entries("walk_forward", oracle("""
SELECT fold, CASE WHEN date < d1 THEN 'train' ELSE 'test' END AS role, count(*) AS n, min(date) AS first_day, max(date) AS last_day
FROM e, (SELECT CAST(f AS INT) AS fold, (SELECT date FROM days WHERE i = (n * f) // 6) AS d1,
                (SELECT date FROM days WHERE i = (n * (f + 1)) // 6 - 1) AS d2 FROM range(1, 6) t(f)) folds
WHERE date <= d2 GROUP BY ALL""", CUT))
def _(e):
    rows = D.walk_forward_rows(e.select("date"), 5)
    return rows.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@on_entries("truncate_history", oracle(f"SELECT {KEYS} FROM e, cut WHERE date >= val_from - INTERVAL 730 DAY", CUT))
def _(e):
    return D.truncate_history(e.select("race_id", "horse_number", "date"), 2).drop("date")


@on_entries("longshot_filter", oracle(f"SELECT {KEYS}, popularity FROM e WHERE popularity >= 7"))
def _(e):
    return D.filter_longshot(e.select("race_id", "horse_number", "popularity"))


@on_entries("feature_columns")
def _(e):
    from hindcast.operators.history import feature_columns
    wanted = feature_columns(drop=["class_level", "class_change", "grade"])
    f = H.training_features(stored(e.select(*[c for c in e.columns if c in HISTORY or c in wanted])))
    cols = [c for c in wanted if c in f.columns]
    return f.select("race_id", *cols)


