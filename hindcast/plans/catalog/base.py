"""Registry of named queries and, where SQL can say the same, the equivalent DuckDB query."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.plans.entries import entries
from hindcast.plans.oracle_base import with_e
from hindcast.session import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PLACES = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded, so that summation order does not decide a comparison; -0.0 becomes 0.0."""
    return df.withColumns({c: F.round(c, PLACES) + F.lit(0.0) for c, t in df.dtypes if t == "double"})


def oracle(select: str, *ctes: str, rounds: Sequence[str] = (), base: bool = True) -> str:
    head = with_e(*ctes) if base else ("WITH " + ",\n".join(ctes) if ctes else "")
    if not rounds:
        return f"{head}\n{select}"
    swap = ", ".join(f"round({c}, {PLACES}) + CAST(0 AS DOUBLE) AS {c}" for c in rounds)
    return f"{head}\nSELECT * REPLACE ({swap}) FROM (\n{select}\n) q"


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def on_entries(name: str, sql: str | None = None, store: bool | Sequence[str] = False):
    """Register a function of the typed entries; ``store`` for functions that read them many times. Columns given there are written, and
    all that the function reads; the others are neither made, shuffled nor written."""
    def wrap(fn):
        def run(spark, sf_dir):
            e = entries(spark, sf_dir)
            return fn(stored(e if store is True else e.select(*store)) if store else e)
        register(name, sql)(run)
        return fn
    return wrap
