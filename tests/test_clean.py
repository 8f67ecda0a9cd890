from datetime import date

import pytest
from pyspark.sql import functions as F

from hindcast.functions import clean as C
from hindcast.functions import tiers as T
from hindcast.sources import store


def value(spark, expr, x, kind="string"):
    df = spark.createDataFrame([(x,)], f"x {kind}")
    return df.select(expr("x").alias("v")).first().v


@pytest.mark.parametrize("text, want", [("1:33.4", 93.4), ("93.4", 93.4), (" 59.9 ", 59.9), ("2:00", None), ("inf", None), ("-5.0", None),
                                        ("中止", None), (None, None), ("", None)])
def test_race_seconds(spark, text, want):
    got = value(spark, C.race_seconds, text)
    assert got == pytest.approx(want) if want is not None else got is None


@pytest.mark.parametrize("text, want", [("03-03-02-02", 3), ("12", 12), ("", None), ("x-1", None), (None, None)])
def test_first_corner(spark, text, want):
    assert value(spark, C.first_corner, text) == want


@pytest.mark.parametrize("text, want", [("2歳新馬", 0.0), ("3歳未勝利", 1.0), ("3歳以上500万下", 2.0), ("1勝クラス", 2.0), ("4歳以上1000万下", 3.0),
                                        ("2勝クラス", 3.0), ("1600万下", 4.0), ("3勝クラス", 4.0), ("オープン(国際)", 5.0), ("その他", None), (None, None)])
def test_class_level(spark, text, want):
    assert value(spark, C.class_level, text) == want


@pytest.mark.parametrize("text, want", [("5.2", 5.2), ("NaN", None), ("1e3", 1000.0), (" 5 ", 5.0), ("---", None), ("5d", None), (None, None)])
def test_to_number(spark, text, want):
    assert value(spark, C.to_number, text) == want


def test_small_parsers(spark):
    assert value(spark, C.or_none, "　 a b　") == "a b" and value(spark, C.or_none, " 　 ") is None
    assert value(spark, C.first_int, "芝1600m") == 1600 and value(spark, C.first_int, "x") is None
    assert value(spark, C.paren_delta, "480(-2)") == -2 and value(spark, C.paren_delta, "460(+4)") == 4
    assert value(spark, C.paren_delta, "計不") is None
    assert value(spark, C.to_date_ymd, "2024/1/06") == date(2024, 1, 6) and value(spark, C.to_date_ymd, "2024/13/01") is None
    assert value(spark, C.sex, "牡5") == "牡" and value(spark, C.age, "牡5") == 5.0
    assert value(spark, C.is_handicap, "ハンデ") == 1.0 and value(spark, C.is_handicap, None) == 0.0
    assert value(spark, C.payout_value, "1,310") == 1310.0 and value(spark, C.payout_value, "特払") is None
    assert value(spark, lambda c: C.payout_value(c, 0), None) == 0.0


@pytest.mark.parametrize("text, want", [("7-3", "3-7"), ("10-2-1", "1-2-10"), (" 4 - 2", "2-4"), ("a-1", "a-1"), ("5", "5")])
def test_combo_norm(spark, text, want):
    assert value(spark, C.combo_norm, text) == want


def test_grade_or_name(spark):
    df = spark.createDataFrame([("G1", "x(GII)"), ("", "日経賞(GII)"), (None, "a(GI)特別"), (" ", "平場")], "g string, n string")
    assert [r[0] for r in df.select(C.grade_or_name("g", "n")).collect()] == ["G1", "GII", "GI", None]
    assert [r[0] for r in df.select(C.grade_or_name(F.lit(None).cast("string"), "n", anchored=True)).collect()] == ["GII", "GII", None, None]


def test_tiers(spark):
    got = [value(spark, T.pop_tier, v, "double") for v in (1.0, 3.0, 6.0, 7.0, None)]
    assert got == ["1番人気", "2-3番人気", "4-6番人気", "7番人気以下", "7番人気以下"]
    assert value(spark, lambda c: T.pop_tier(c, null_label=None), None, "double") is None
    assert [value(spark, T.odds_tier, v, "double") for v in (1.9, 2.0, 9.9, 10.0, None)] == ["〜1.9倍", "2-4倍", "5-9倍", "10倍以上", "10倍以上"]
    assert [value(spark, T.band, v, "int") for v in (0, -1, 1400, 1401, 2200, 2201, 10001)] == [None, None, 0, 1, 2, 3, None]
    assert value(spark, lambda c: T.band(c, bounds=None), 10001, "int") == 3
    assert value(spark, T.rest_days_bucket, None, "int") is None and value(spark, T.rest_days_bucket, 14, "int") == "中2-4週(14-34日)"
    assert value(spark, T.weight_diff_bucket, -6, "int") == "大幅減(-6kg以下)" and value(spark, T.weight_diff_bucket, None, "int") is None


RAW = ("race_id string, date string, venue string, course_type string, distance int, grade string, race_name string, race_condition string, "
       "horse_number string, finishing_position string, bracket_number string, horse_id string, sex_age string, weight_carried string, "
       "finish_time string, passing_order string, last_3f string, odds string, popularity string, horse_weight int, horse_weight_diff int")


def test_clean_entries_drops_unfinished(spark):
    row = ["R0", "2024/01/01", "東京", "芝", 1600, "", "a(GIII)", "3歳未勝利 ハンデ", "1", "1", "1", "H0", "牡4", "57.0", "1:33.4", "04-04", "34.5", "5.2", "2", 480, 0]
    other = list(row)
    other[8], other[9] = "2", "除外"
    df = spark.createDataFrame([tuple(row), tuple(other)], RAW)
    got = C.clean_entries(df).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.date, r.is_win, r.is_placed, r.grade, r.is_handicap, r.class_level, r.finish_time_sec) == (date(2024, 1, 1), 1, 1, "GIII", 1.0, 1.0, 93.4)
    kept = {x.horse_number: x for x in C.clean_entries(df, keep_unfinished=True).collect()}
    assert kept[2].is_win == 0 and kept[2].finishing_position is None


def test_venue_filters(spark):
    df = spark.createDataFrame([("202405010101", "東京"), ("202444010101", "大井")], "race_id string, venue string")
    assert [r.venue for r in store.filter_venues(df, names=["東京"]).collect()] == ["東京"]
    assert [r.venue for r in store.filter_venues(df, codes=["44"]).collect()] == ["大井"]
