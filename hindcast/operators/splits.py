"""Time splits on distinct dates. The date list is bounded by the calendar, not by the rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date as Date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast import schema as S
from hindcast.functions.clean import to_number

DATE = "date"


def distinct_dates(df: DataFrame, date: str = DATE) -> list[Date]:
    rows = df.select(F.col(date).cast("date").alias("d")).filter(F.col("d").isNotNull()).distinct().collect()
    return sorted(r.d for r in rows)


def cut_dates(df: DataFrame, val: float = S.VAL_SHARE, test: float = S.TEST_SHARE, date: str = DATE) -> tuple[Date, Date]:
    dates = distinct_dates(df, date)
    return dates[int(len(dates) * (1 - val - test))], dates[int(len(dates) * (1 - test))]


def split_by_date(df: DataFrame, val: float = S.VAL_SHARE, test: float = S.TEST_SHARE,
                  date: str = DATE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train / validation / test by share of the distinct dates; each part is a filter the scan can prune by."""
    val_from, test_from = cut_dates(df, val, test, date)
    d = F.col(date)
    return df.filter(d < val_from), df.filter((d >= val_from) & (d < test_from)), df.filter(d >= test_from)


def split_roles(df: DataFrame, val: float = S.VAL_SHARE, test: float = S.TEST_SHARE, date: str = DATE) -> DataFrame:
    """The same split as one ``role`` column, in one pass."""
    val_from, test_from = cut_dates(df, val, test, date)
    d = F.col(date)
    return df.withColumn("role", F.when(d < val_from, "train").when(d < test_from, "val").when(d >= test_from, "test"))


def fold_bounds(dates: Sequence[Date], n_splits: int) -> list[tuple[int, Date, Date]]:
    """(fold, first test date, last test date) of the expanding folds."""
    n = len(dates)
    if n < n_splits + 1:
        raise ValueError(f"{n} dates are too few for {n_splits} folds")
    points = [int(n * i / (n_splits + 1)) for i in range(1, n_splits + 2)]
    return [(i + 1, dates[points[i]], dates[points[i + 1] - 1]) for i in range(n_splits)]


def walk_forward(df: DataFrame, n_splits: int = 5, date: str = DATE) -> list[tuple[int, DataFrame, DataFrame]]:
    """Expanding folds ``(fold, train, test)``. Fold edges are real dates, so no fold is empty."""
    d = F.col(date)
    return [(k, df.filter(d < first), df.filter((d >= first) & (d <= last)))
            for k, first, last in fold_bounds(distinct_dates(df, date), n_splits) if first <= last]


def walk_forward_rows(df: DataFrame, n_splits: int = 5, date: str = DATE) -> DataFrame:
    """All folds in one pass: each row once per fold it belongs to, with ``fold`` and ``role``."""
    d = F.col(date)
    parts = []
    for k, first, last in fold_bounds(distinct_dates(df, date), n_splits):
        role = F.when(d < first, "train").when(d <= last, "test")
        parts.append(F.struct(F.lit(k).alias("fold"), role.alias("role")))
    rows = df.withColumn("__f", F.explode(F.array(*parts))).filter(F.col("__f.role").isNotNull())
    return rows.select(*df.columns, F.col("__f.fold").alias("fold"), F.col("__f.role").alias("role"))


def truncate_history(df: DataFrame, years: int | None, anchor: Date | None = None, date: str = DATE) -> DataFrame:
    """Rows from ``365 * years`` days before ``anchor`` (default: first validation date) on.

    Apply it before the feature windows, so that no history older than the cut reaches a feature.
    """
    if years is None:
        return df
    anchor = anchor or cut_dates(df, date=date)[0]
    return df.filter(F.col(date) >= F.date_sub(F.lit(anchor), 365 * years))


def filter_longshot(df: DataFrame, popularity: str = "popularity") -> DataFrame:
    return df.filter(to_number(popularity) >= S.LONGSHOT_POPULARITY)
