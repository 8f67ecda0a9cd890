"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a Python worker takes apart at a time; one longer text is taken alone.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batch: pa.RecordBatch, column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with at most ``budget`` bytes of text each, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + budget, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(df: DataFrame, text_col: str, keep: list[str], added: T.StructType,
              make: Callable[[], Callable[[pa.RecordBatch, list[str]], list]]) -> DataFrame:
    """``df`` with columns computed in Python from its texts, row by row and without a shuffle.

    ``make()`` runs once in each task and returns a function of a part of a batch and its texts (null: ``""``) that
    gives the added columns, one sequence of values for each. Columns of ``keep`` that have the name of an added one
    are left out.
    """
    keep = [c for c in keep if c not in added.names]
    frame = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    schema = T.StructType([f for f in frame.schema.fields if f.name != "__text"] + list(added.fields))
    from pyspark.sql.pandas.types import to_arrow_type
    kinds = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in text_slices(batch, "__text"):
                texts = [t or "" for t in part.column("__text").to_pylist()]
                values = work(part, texts)
                columns = [part.column(c) for c in keep]
                columns += [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, type=k)
                            for v, k in zip(values, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *added.names])

    return frame.mapInArrow(run, schema)


def sha256(col: Column) -> Column:
    """Lowercase hex digest of a string's UTF-8 bytes; null counts as empty."""
    return F.sha2(F.coalesce(col, F.lit("")), 256)


def lower_ascii(col: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Keys that may be sent to every task.
BROADCAST_KEYS = 1_000_000


def within(df: DataFrame, keys: DataFrame, key: str, anti: bool = False) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``keys``, or with ``anti`` the others. Few keys, as counted, are sent to the
    tasks; more are joined."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, key, "left_anti" if anti else "left_semi")


def right_small(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Inner join of ``df`` with ``keys``, which is sent to the tasks if it has few rows, as counted."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, key)


def left_small(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Left join of ``df`` with ``found``, which is sent to the tasks if it has few rows, as counted."""
    few = found.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(found) if few else found, key, "left")


def attach(df: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` left-joined with ``found`` (one row for each of its ``keys``, nulls included).

    If few rows are found, as counted, only the rows of ``df`` with the hash of a found key take part in the join, and
    the texts of all others are not shuffled.
    """
    hashed = F.xxhash64(*keys)
    hashes = found.select(hashed.alias("__hash")).distinct()
    rows = df.withColumn("__hash", hashed)
    added = [F.col(c) for c in found.columns if c not in keys]
    right = found.withColumn("__hash", hashed).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = rows["__hash"] == right["__hash"]
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    if hashes.limit(BROADCAST_KEYS + 1).count() > BROADCAST_KEYS:
        return rows.join(right, same, "left").select(*df.columns, *added)
    few = F.broadcast(hashes)
    touched = rows.join(few, "__hash", "left_semi")
    same = touched["__hash"] == right["__hash"]
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = touched.join(right, same, "left").select(*df.columns, *added)
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields if f.name not in keys]
    return rows.join(few, "__hash", "left_anti").select(*df.columns, *missing).unionByName(joined)
