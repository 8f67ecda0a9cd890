"""Cleaning of text-typed facts. Every function is a built-in expression: no Python workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast import schema as S


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def or_none(c: Column | str) -> Column:
    """Trim all white space (the full-width space too); empty text becomes null."""
    return F.nullif(F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", ""), F.lit(""))


def _group(c: Column, pattern: str, idx: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, idx), F.lit(""))


def first_int(c: Column | str) -> Column:
    return _group(_c(c), r"([0-9]+)").try_cast("int")


def paren_delta(c: Column | str) -> Column:
    return _group(_c(c), r"\(([+-]?[0-9]+)\)").try_cast("int")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def to_number(c: Column | str) -> Column:
    """Text to double; anything unparsable, and NaN, is null. A Java-style ``5d``/``5f`` is not a number."""
    text = _c(c).cast("string")
    return nan_to_null(F.when(~text.rlike(r"(?i)[0-9.][df]\s*$"), text.try_cast("double")))


def to_date_ymd(c: Column | str) -> Column:
    return F.try_to_date(_c(c), "yyyy/M/d")


def race_seconds(c: Column | str) -> Column:
    """``m:ss.f`` or plain seconds; strict digits, so ``inf`` and signs are null."""
    t = F.trim(_c(c))
    minutes = _group(t, r"^([0-9]+):([0-9]+\.[0-9]+)$", 1).cast("double")
    seconds = _group(t, r"^([0-9]+):([0-9]+\.[0-9]+)$", 2).cast("double")
    plain = _group(t, r"^([0-9]+\.?[0-9]*)$").cast("double")
    return F.coalesce(minutes * 60 + seconds, plain)


def first_corner(c: Column | str) -> Column:
    return F.trim(F.element_at(F.split(_c(c), "-"), 1)).try_cast("int")


def class_level(c: Column | str) -> Column:
    out = None
    for level, pattern in enumerate(S.CLASS_PATTERNS):
        hit = _c(c).rlike(pattern)
        value = F.lit(float(level))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def sex(c: Column | str) -> Column:
    return _group(_c(c), r"^([^0-9]+)")


def age(c: Column | str) -> Column:
    return _group(_c(c), r"([0-9]+)$").try_cast("double")


def grade_or_name(grade: Column | str, name: Column | str, anchored: bool = False) -> Column:
    """Grade, or the one written in the race name when the grade is blank."""
    pattern = r"\((GIII|GII|GI|L)\)\s*$" if anchored else r"\((GI{1,3}|L)\)"
    return F.when(F.trim(_c(grade)) != "", _c(grade)).otherwise(_group(_c(name), pattern))


def is_handicap(c: Column | str) -> Column:
    return F.coalesce(_c(c).contains("ハンデ"), F.lit(False)).cast("double")


def is_finished(pos: Column | str) -> Column:
    """A numeric finishing position in text form."""
    return F.coalesce(_c(pos).cast("string").rlike("^[0-9]+$"), F.lit(False))


def is_win(pos: Column | str) -> Column:
    return F.coalesce(_c(pos) == 1, F.lit(False)).cast("int")


def is_placed(pos: Column | str, n: int = 3) -> Column:
    return F.coalesce(_c(pos) <= n, F.lit(False)).cast("int")


def payout_value(c: Column | str, null_as: float | None = None) -> Column:
    value = to_number(F.regexp_replace(_c(c), ",", ""))
    return value if null_as is None else F.coalesce(value, F.lit(float(null_as)))


def combo_norm(c: Column | str) -> Column:
    """``7-3`` to ``3-7`` by number; text with a non-numeric part is returned unchanged."""
    parts = F.transform(F.split(_c(c), "-"), lambda x: F.trim(x).try_cast("int"))
    return F.when(F.exists(parts, lambda x: x.isNull()), _c(c)).otherwise(
        F.array_join(F.array_sort(parts).cast("array<string>"), "-")
    )


def clean_entries(raw: DataFrame, keep_unfinished: bool = False) -> DataFrame:
    """Typed entries from the raw text rows of ``load_entries``/``load_upcoming`` (no shuffle)."""
    out = raw.withColumns({
        "date": to_date_ymd("date"),
        "finishing_position": to_number("finishing_position"),
        "class_level": class_level("race_condition"),
        "odds": to_number("odds"),
        "popularity": to_number("popularity"),
        "weight_carried": to_number("weight_carried"),
        "last_3f": to_number("last_3f"),
        "horse_number": to_number("horse_number").cast("int"),
        "bracket_number": to_number("bracket_number"),
        "horse_weight": to_number("horse_weight"),
        "horse_weight_diff": to_number("horse_weight_diff"),
        "finish_time_sec": race_seconds("finish_time"),
        "first_corner_pos": first_corner("passing_order"),
        "sex": sex("sex_age"),
        "age": age("sex_age"),
        "grade": grade_or_name("grade", "race_name"),
        "is_handicap": is_handicap("race_condition"),
    })
    if not keep_unfinished:
        out = out.filter(F.col("finishing_position").isNotNull())
    return out.withColumns({
        "is_win": is_win("finishing_position"),
        "is_placed": is_placed("finishing_position"),
    }).drop("sex_age", "finish_time", "passing_order", "race_name", "race_condition")


def prev_deltas(df: DataFrame) -> DataFrame:
    """Changes against the previous run where that run's columns are supplied (serving rows)."""
    have = set(df.columns)
    new: dict[str, Column] = {}
    if "prev_distance" in have:
        new["distance_change"] = to_number("distance") - to_number("prev_distance")
    for prev, cur, out in (("prev_course_type", "course_type", "course_type_change"),
                           ("prev_jockey_id", "jockey_id", "jockey_change")):
        if prev in have:
            new[out] = F.when(F.col(prev).isNotNull(), (~F.col(cur).eqNullSafe(F.col(prev))).cast("double"))
    if "prev_race_condition" in have:
        new["class_change"] = F.col("class_level") - class_level("prev_race_condition")
    if "prev_race_date" in have:
        new["days_since_last_race"] = F.datediff("date", F.col("prev_race_date").cast("date")).cast("double")
    dropped = [c for c in ("prev_distance", "prev_course_type", "prev_jockey_id", "prev_race_condition",
                           "prev_race_date") if c in have]
    return df.withColumns(new).drop(*dropped) if new else df
