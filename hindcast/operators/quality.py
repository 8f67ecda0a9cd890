"""Data-quality checks and backfill work lists, as anti and semi joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date as Date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.clean import is_finished, or_none, to_date_ymd


def _known(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))


def missing_master(results: DataFrame, master: DataFrame, key: str, name: str) -> DataFrame:
    """Ids that results use and the master lacks, with one name each. Ids are combined before the join."""
    used = _known(results, key).groupBy(key).agg(F.min(name).alias(name))
    return used.join(master.select(key), key, "left_anti")


def missing_results(races: DataFrame, results: DataFrame, as_of: Date) -> DataFrame:
    past = races.filter(to_date_ymd("date") < F.lit(as_of))
    return past.join(results.select("race_id"), "race_id", "left_anti").select("race_id", "race_name", "date")


def missing_payoffs(races: DataFrame, results: DataFrame, payoffs: DataFrame) -> DataFrame:
    done = results.filter(is_finished("finishing_position")).select("race_id")
    return (races.join(done, "race_id", "left_semi").join(payoffs.select("race_id"), "race_id", "left_anti")
            .select("race_id", "race_name", "date"))


def bad_odds(races: DataFrame, results: DataFrame) -> DataFrame:
    bad = F.coalesce(~F.col("odds").rlike("^[0-9.]+$"), F.lit(True))
    rows = results.filter(is_finished("finishing_position") & bad).select("race_id")
    return races.join(rows, "race_id", "left_semi").select("race_id", "race_name", "date")


def quality_summary(checks: Mapping[str, DataFrame], sample: int = 10) -> DataFrame:
    """Count per check and the first samples in the order of the first column (top-k per check, no sort of all)."""
    out = None
    for name, df in checks.items():
        key = df.columns[0]
        n = df.agg(F.count(F.lit(1)).alias("n"))
        first = df.select(F.col(key).cast("string").alias("k")).orderBy("k").limit(sample)
        ids = first.agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("samples"))
        one = n.select(F.lit(name).alias("check"), "n", ids.scalar().alias("samples"))
        out = one if out is None else out.unionByName(one)
    return out


def incomplete_master(results: DataFrame, master: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """Ids in results whose master row is absent or has a blank required column."""
    ok = master.filter(F.lit(True))
    for c in required:
        ok = ok.filter(or_none(c).isNotNull())
    return _known(results, key).select(key).distinct().join(ok.select(key), key, "left_anti")


def worklist(check: DataFrame, order: Sequence, limit: int | None = None) -> DataFrame:
    ordered = check.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)
