"""Loads, keyed snapshots, and run outputs on files.

There is no in-place update: a write produces a new snapshot of the table from the old one and the changes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date as Date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast import schema as S
from hindcast.functions.clean import first_int, is_finished, or_none, paren_delta, payout_value, to_date_ymd, to_number

RACE, ENTRY = "race_id", "horse_number"
RACE_COLS = ["race_id", "race_name", "race_number", "date", "venue", "course_type", "distance", "direction", "weather",
             "track_condition", "grade", "head_count", "race_condition"]
RESULT_COLS = ["race_id", "horse_number", "finishing_position", "bracket_number", "horse_id", "horse_name", "sex_age",
               "weight_carried", "jockey_id", "jockey_name", "finish_time", "passing_order", "last_3f", "odds",
               "popularity", "horse_weight", "horse_weight_diff", "trainer_id", "owner"]
HORSE_COLS = ["horse_id", "sire", "dam", "broodmare_sire"]


def _have(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in cols if c in df.columns])


def filter_venues(df: DataFrame, names: Sequence[str] | None = None, codes: Sequence[str] | None = None) -> DataFrame:
    """By venue name, or by the code in characters 5-6 of the race id."""
    if names is not None:
        df = df.filter(F.col("venue").isin(list(names)))
    if codes is not None:
        df = df.filter(F.substring(F.col(RACE).cast("string"), 5, 2).isin(list(codes)))
    return df


def _joined(races: DataFrame, results: DataFrame, horses: DataFrame | None) -> DataFrame:
    shared = set(races.columns) & set(results.columns) - {RACE}
    rows = results.join(races.drop(*shared), RACE)
    return rows if horses is None else rows.join(_have(horses, HORSE_COLS), "horse_id", "left")


def load_entries(races: DataFrame, results: DataFrame, horses: DataFrame | None = None,
                 venues: Sequence[str] | None = None) -> DataFrame:
    """Finished entries with their race and pedigree. Filters sit on the inputs, so scans can use them."""
    races, results = _have(races, RACE_COLS), _have(results, [*RESULT_COLS, "venue", "course_type", "distance", "head_count"])
    results = results.filter(is_finished("finishing_position"))
    if venues is not None:
        on_race = "venue" in races.columns
        races, results = (filter_venues(races, venues), results) if on_race else (races, filter_venues(results, venues))
    return _joined(races, results, horses)


def load_upcoming(races: DataFrame, results: DataFrame, race_ids: DataFrame | None = None,
                  horses: DataFrame | None = None) -> DataFrame:
    """Entries without a position yet, of many races at once."""
    results = _have(results, [*RESULT_COLS, "venue", "course_type", "distance", "head_count"]).filter(
        F.col("finishing_position").isNull())
    if race_ids is not None:
        results = results.join(race_ids.select(RACE), RACE, "left_semi")
    return _joined(_have(races, RACE_COLS), results, horses)


def load_payoffs(payoffs: DataFrame, races: DataFrame) -> DataFrame:
    return payoffs.join(races.select(RACE), RACE, "left_semi").select(RACE, "bet_type", "combination", "payout")


def load_odds(odds: DataFrame, races: DataFrame) -> DataFrame:
    return odds.join(races.select(RACE), RACE, "left_semi").select(RACE, ENTRY, "win_odds")


def query(spark: SparkSession, sql: str, params: Mapping | None = None, **frames: DataFrame) -> DataFrame:
    """Ad-hoc SQL with named parameters (``:name``) over the given frames (``{name}``)."""
    return spark.sql(sql, args=dict(params) if params else None, **frames)


# ---- keyed snapshots ----------------------------------------------------------------------------------------------

def _newest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], first: Sequence[str]) -> DataFrame:
    """One row per key: the values of the highest ``order``; ``first`` columns come from the lowest. Combines map-side."""
    rest = [c for c in rows.columns if c not in keys and not c.startswith("__")]
    by = F.struct(*order)
    aggs = [F.max_by(F.struct(*rest), by).alias("new")]
    if first:
        aggs.append(F.min_by(F.struct(*first), by).alias("old"))
    out = rows.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[F.col(f"old.{c}" if c in first else f"new.{c}").alias(c) for c in rest])


def upsert(target: DataFrame, updates: DataFrame, key: str | Sequence[str], keep: Sequence[str] = ("created_at",),
           order: str | None = None) -> DataFrame:
    """New snapshot: updates win over stored rows, ``keep`` columns of a stored row survive.

    Among several updates of one key the latest by ``order`` (then by value) wins.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in target.columns if c not in keys]
    seq = F.col(order) if order else F.lit(0)
    both = target.withColumns({"__src": F.lit(0), "__seq": seq}).unionByName(
        updates.select(*target.columns).withColumns({"__src": F.lit(1), "__seq": seq}))
    return _newest_per_key(both, keys, [F.col("__src"), F.col("__seq"), F.struct(*rest)], list(keep)).select(*target.columns)


def replace_children(target: DataFrame, new: DataFrame, parent: str = RACE) -> DataFrame:
    """Children of a parent are replaced only where new children came for it."""
    return target.join(new.select(parent).distinct(), parent, "left_anti").select(*target.columns).unionByName(
        new.select(*target.columns))


def upsert_latest(target: DataFrame, updates: DataFrame, keys: Sequence[str] = (RACE, ENTRY), ts: str = "scraped_at",
                  value: str = "win_odds") -> DataFrame:
    """Latest value per key by time; unparsable text becomes null, the earliest ``created_at`` survives. The order in which rows
    come, in one batch or several, doesn't matter."""
    cols = target.columns
    dtype = dict(target.dtypes)[value]
    fresh = updates.withColumn(value, to_number(value).cast(dtype)).select(*cols)
    rest = [c for c in cols if c not in keys and c != "created_at"]
    aggs = [F.max_by(F.struct(*rest), F.struct(ts, value)).alias("new")]
    if "created_at" in cols:
        aggs.append(F.min("created_at").alias("created_at"))
    out = target.unionByName(fresh).groupBy(*keys).agg(*aggs)
    return out.select(*[F.col(f"new.{c}") if c in rest else F.col(c) for c in cols])


def with_raw_json(df: DataFrame, out: str = "raw_data") -> DataFrame:
    return df.withColumn(out, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))


def missing_keys(candidates: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return candidates.select(key).distinct().join(stored.select(key), key, "left_anti")


def existing_keys(candidates: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return candidates.select(key).distinct().join(stored.select(key), key, "left_semi")


def latest_month(races: DataFrame, date: str = "date") -> DataFrame:
    """(year, month) of the newest race; no row for an empty table."""
    d = F.to_date(F.max(to_date_ymd(date) if dict(races.dtypes)[date] == "string" else F.col(date)))
    return races.agg(d.alias("d")).filter("d IS NOT NULL").select(F.year("d").alias("year"), F.month("d").alias("month"))


def month_range(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row (year, month) per month from start to end."""
    first = F.explode(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month")))
    return df.select(first.alias("m")).select(F.year("m").alias("year"), F.month("m").alias("month"))


# ---- boundary rows of the extraction jobs -------------------------------------------------------------------------

# Field names of the extracted records and their stored columns.
RACE_FIELDS = {"レース名": "race_name", "R": "race_number", "日付": "date", "開催": "venue", "コース種別": "course_type",
               "距離": "distance", "回り": "direction", "天候": "weather", "馬場状態": "track_condition",
               "グレード": "grade", "発走時刻": "start_time", "レース条件": "race_condition"}
RESULT_FIELDS = {"馬番": "horse_number", "着順": "finishing_position", "枠番": "bracket_number", "馬名": "horse_name",
                 "馬ID": "horse_id", "性齢": "sex_age", "斤量": "weight_carried", "騎手": "jockey_name",
                 "騎手ID": "jockey_id", "タイム": "finish_time", "着差": "margin", "通過": "passing_order",
                 "上り": "last_3f", "単勝オッズ": "odds", "人気": "popularity", "馬体重": "horse_weight",
                 "調教師": "trainer_name", "調教師ID": "trainer_id", "馬主": "owner", "賞金": "prize_money"}
PAYOFF_FIELDS = {"券種": "bet_type", "組番": "combination", "払戻金": "payout", "人気": "popularity"}
HORSE_FIELDS = {"馬名": "horse_name", "性別": "sex", "毛色": "coat_color", "生年月日": "birthday", "調教師": "trainer_name",
                "調教師ID": "trainer_id", "馬主": "owner", "馬主ID": "owner_id", "生産者": "breeder", "産地": "birthplace",
                "父": "sire", "母": "dam", "母父": "broodmare_sire"}


def rename_record(df: DataFrame, fields: Mapping[str, str], keys: Sequence[str]) -> DataFrame:
    """Record map column ``rec`` to stored columns: trimmed text, the record itself kept as JSON."""
    cols = [or_none(F.try_element_at("rec", F.lit(k))).alias(v) for k, v in fields.items()]
    return df.select(*keys, *cols, F.to_json("rec").alias("raw_data"))


def result_record(df: DataFrame) -> DataFrame:
    """Extracted result records as stored rows; the weight text splits into weight and change."""
    out = rename_record(df, RESULT_FIELDS, [RACE])
    return out.withColumns({"horse_weight_diff": paren_delta("horse_weight"), "horse_weight": first_int("horse_weight")})


def race_record(df: DataFrame) -> DataFrame:
    return rename_record(df, RACE_FIELDS, [RACE]).withColumn("distance", first_int("distance"))


# ---- outputs ------------------------------------------------------------------------------------------------------

def save_run(df: DataFrame, base: str, run_ts: str, fmt: str = "csv", sort: Sequence[str] = (RACE, "predicted_rank")) -> str:
    """One folder per run under ``base``; rows of a file are in race and rank order. Races stay in one file."""
    keys = [c for c in sort if c in df.columns]
    out = df.repartition(keys[0]) if keys else df
    out = out.sortWithinPartitions(*keys) if keys else out
    path = f"{base}/run_ts={run_ts}"
    writer = out.write.mode("errorifexists")
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.format(fmt).save(path)
    return path


def picks_document(flags: DataFrame, picks: DataFrame, strategies: Sequence[tuple]) -> DataFrame:
    """One JSON document per race: the recommended runners per bet type and per strategy.

    ``flags`` is the output of the recommendation, ``picks`` of the strategies.
    """
    def lst(flag: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col(flag), F.col(ENTRY))))
    bets = {b: lst(f"recommended_{b}") for b in ("win", "place", "quinella", "wide", "trio")}
    ev = F.round(F.max(F.when(F.col("recommended_win"), F.col("ev"))), 4).alias("win_ev")
    doc = flags.groupBy(RACE).agg(*[c.alias(k) for k, c in bets.items()], ev)
    sides = []
    for i, (name, bet, *_rest) in enumerate(strategies):
        mine = F.when(F.col("strategy") == name, F.col(ENTRY))
        sides += [F.array_sort(F.collect_list(mine)).alias(f"h{i}"),
                  F.round(F.max(F.when(F.col("strategy") == name, F.col("ev"))), 4).alias(f"e{i}")]
    doc = doc.join(picks.groupBy(RACE).agg(*sides), RACE, "left")
    empty = F.array().cast("array<int>")
    strat = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(bet).alias("bet_type"), F.coalesce(F.col(f"h{i}"), empty).alias("horses"),
                 F.col(f"e{i}").alias("ev")) for i, (name, bet, *_r) in enumerate(strategies)])
    body = F.struct(F.struct("win", "win_ev", "place", "quinella", "wide", "trio").alias("betting"), strat.alias("strategies"))
    return doc.select(RACE, F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))
