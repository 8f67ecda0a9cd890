"""Keyed tables in hash buckets, updated in place of the buckets that the updates touch.

A table is a folder with one subfolder for each bucket of its keys. A merge reads the buckets of the updates' keys alone (a
partition filter, so the scan lists no other folder) and writes those back by a dynamic partition overwrite; the files of all
other buckets stay as they are. Merging the same updates again gives the same table, so a batch that was cut off
is simply repeated. Readers take the table between merges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.sources.store import replace_children, upsert, upsert_latest

BUCKET = "bucket"


@dataclass(frozen=True)
class BucketedTable:
    """``schema`` does not hold the bucket. ``buckets`` is part of the layout and must not change over a table's life; choose it so
    that a bucket is a file or a few."""

    path: str
    keys: tuple[str, ...]
    schema: T.StructType
    buckets: int = 64

    def bucket(self) -> Column:
        """Bucket of a row: a function of the text of its keys, so that it does not depend on their type."""
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _stored(self, spark: SparkSession) -> DataFrame:
        whole = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        try:
            return spark.read.schema(whole).parquet(self.path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], whole)

    def read(self, spark: SparkSession) -> DataFrame:
        """The whole table; empty before the first merge."""
        return self._stored(spark).drop(BUCKET)

    def touched(self, updates: DataFrame) -> list[int]:
        """Buckets of the updates: one small number for each, at most ``buckets``."""
        return sorted(r[0] for r in updates.select(self.bucket()).distinct().collect())

    def part(self, spark: SparkSession, buckets: Sequence[int]) -> DataFrame:
        """The rows of some buckets; only their folders are listed and read."""
        return self._stored(spark).filter(F.col(BUCKET).isin(list(buckets))).drop(BUCKET)

    def merge(self, updates: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the touched buckets by ``combine(their rows, updates)``, whose rows must keep to these buckets' keys. Returns the
        touched buckets; without updates nothing is written."""
        spark = updates.sparkSession
        touched = self.touched(updates)
        if touched:
            names = [f.name for f in self.schema.fields]
            merged = combine(self.part(spark, touched), updates).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema.fields])
            merged = merged.select(*names, self.bucket().alias(BUCKET)).repartition(len(touched), BUCKET)
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        return touched

    def upsert(self, updates: DataFrame, keep: Sequence[str] = ("created_at",), order: str | None = None) -> list[int]:
        """Updates win over stored rows of their key; see :func:`store.upsert`."""
        return self.merge(updates, lambda old, new: upsert(old, new, list(self.keys), keep, order))

    def replace_children(self, new: DataFrame) -> list[int]:
        """All rows of a parent (the key) go where new ones came for it; see :func:`store.replace_children`."""
        if len(self.keys) != 1:
            raise ValueError("children hang on one key column")
        return self.merge(new, lambda old, rows: replace_children(old, rows, self.keys[0]))

    def upsert_latest(self, updates: DataFrame, ts: str = "scraped_at", value: str = "win_odds") -> list[int]:
        """Latest value per key by time; see :func:`store.upsert_latest`."""
        return self.merge(updates, lambda old, new: upsert_latest(old, new, self.keys, ts, value))
