"""Isotonic fit of any number of scores: neighbours that fall are pooled within ranges of scores, then across them.

Pooling two neighbouring blocks of which the left one's mean is not the smaller one is right in any order, so each range of
scores can be pooled in a task of its own. What is left to pool lies at the cuts between ranges. The next round has fewer rows
and one range more or less than the last for the same number of rows, so that its cuts are others; the rounds end when no
mean falls across a cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.session import stored

#: Blocks of a range, on average. No more are ever in one task, but for the unevenness of sampled cuts.
RANGE_ROWS = 200_000

BLOCK = "lo double, hi double, n long, weight double, total double"
NAMES = ["lo", "hi", "n", "weight", "total"]
#: Whether a block is the first and the last one of its range.
EDGED = f"{BLOCK}, first boolean, last boolean"


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pooled blocks of a range whose blocks come in order."""
    stack: list[list] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in NAMES), strict=True):
            block = list(row)
            while stack and stack[-1][4] * block[3] >= block[4] * stack[-1][3]:
                left = stack.pop()
                block = [left[0], block[1], left[2] + block[2], left[3] + block[3], left[4] + block[4]]
            stack.append(block)
    step = 1 << 16
    for at in range(0, len(stack), step):
        part = stack[at:at + step]
        columns = [pa.array(c, t) for c, t in zip(zip(*part, strict=True), [pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()], strict=True)]
        first = pa.array([at + i == 0 for i in range(len(part))])
        last = pa.array([at + i == len(stack) - 1 for i in range(len(part))])
        yield pa.RecordBatch.from_arrays([*columns, first, last], names=[*NAMES, "first", "last"])


def isotonic_blocks(df: DataFrame, score: str, label: str, weight: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The steps of the least-squares non-decreasing fit of ``label`` on ``score``: ``lo``, ``hi`` (first and last score of a
    step), ``n`` rows, ``weight``, ``total`` (weighted sum of labels) and ``mean``, which grows from step to step.

    Rows with a null or NaN score or label, or without a positive weight, do not take part; equal scores are one point, however many rows
    have it. No rows give no steps. No task gets more than about ``range_rows`` points.
    """
    w = F.lit(1.0) if weight is None else F.col(f"`{weight}`").cast("double")
    rows = df.select(F.col(f"`{score}`").cast("double").alias("s"), F.col(f"`{label}`").cast("double").alias("y"), w.alias("w")).filter(
        "s IS NOT NULL AND y IS NOT NULL AND NOT isnan(s) AND NOT isnan(y) AND w > 0")
    points = rows.groupBy((F.col("s") + 0.0).alias("lo")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("y")).alias("total"))
    blocks = stored(points.select("lo", F.col("lo").alias("hi"), "n", "weight", "total"))
    turn = 0
    while True:
        count = blocks.count()
        ranges = 1 if count <= range_rows else -(-count // range_rows) + turn % 2
        pooled = stored(blocks.select(*NAMES).repartitionByRange(ranges, "lo").sortWithinPartitions("lo").mapInArrow(_pool, EDGED))
        blocks = pooled.select(*NAMES)
        # two rows at most for each range
        edge = Window.orderBy("lo")
        before = [F.lag(c).over(edge) for c in ("total", "weight")]
        falls = pooled.filter("first OR last").withColumn("falls", F.col("first") & (before[0] * F.col("weight") >= F.col("total") * before[1]))
        if ranges == 1 or falls.filter("falls").isEmpty():
            return blocks.withColumn("mean", F.col("total") / F.col("weight"))
        turn += 1


def step_points(blocks: DataFrame) -> DataFrame:
    """Both ends of each step as points ``score``, ``mean`` and ``weight``: all that a model of the fit has to hold."""
    ends = F.when(F.col("lo") < F.col("hi"), F.array("lo", "hi")).otherwise(F.array("lo"))
    return blocks.select(F.explode(ends).alias("score"), "mean", "weight")
