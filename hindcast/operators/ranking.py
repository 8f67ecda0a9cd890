"""Boosted trees under a group ranking objective.

One row holds a race: an array of its runners with features, gain and score, so that after one shuffle everything stays in the
row. A round derives the pairwise gradients of every race in one Arrow pass, fits a Spark ML regression tree to the Newton
step (gradient / curvature, weighted by the curvature), fits the leaf values anew by a grouped sum with a ridge, and adds the
tree to the scores as an expression on the feature arrays. Gains are linear: the relevance label itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.operators.race import ENTRY, RACE
from hindcast.session import stored

#: Runners of a race at most, where a caller does not say otherwise; the pairs of a race are formed in its row.
MAX_RUNNERS = 18
#: Rounds after which the scores are written and the lineage ends.
WRITE_EVERY = 5
#: Pairs of runners that a task holds at a time; the pairs of one runner are taken together, however many.
PAIRS = 1 << 18


def checked(runners: Column, most: int | None = MAX_RUNNERS) -> Column:
    """The runners, or an error for a race that is no race; ``most=None`` takes races of any size."""
    if most is None:
        return runners
    return F.when(F.size(runners) > most, F.raise_error(F.concat(
        F.lit(f"more than {most} runners in race "), F.col(RACE).cast("string")))).otherwise(runners)


def grouped(df: DataFrame, gain: str, score: Column, x: Column | None = None, weight: str | None = None, most: int | None = None) -> DataFrame:
    """A row for each race with ``runners``: array of (no, g, w, s[, x]) by number. Rows without a gain take no part."""
    parts = [F.col(ENTRY).alias("no"), F.col(gain).cast("double").alias("g"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"),
             score.cast("double").alias("s")]
    runner = F.struct(*parts, *([x.alias("x")] if x is not None else []))
    rows = df.filter(F.col(gain).isNotNull() & F.col(RACE).isNotNull()).groupBy(RACE).agg(F.sort_array(F.collect_list(runner)).alias("runners"))
    return rows.withColumn("runners", checked(F.col("runners"), most))


def _pairs(size: np.ndarray, start: np.ndarray, first: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of a runner ``first`` <= i < ``stop`` and a runner of its race, which has ``size[i]`` runners from ``start[i]`` on."""
    own = size[first:stop]
    i = np.repeat(np.arange(first, stop), own)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(own) - own - start[first:stop], own)


def _chunks(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of runners with ``PAIRS`` pairs at most, or one runner."""
    ends, first = np.cumsum(size), 0
    while first < len(size):
        done = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        yield first, stop
        first = stop


def _batch_gradients(no: pa.Array, g: np.ndarray, w: pa.Array, s: pa.Array, races: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient, curvature and whether they are null, of the runners of whole races of ``races`` runners each. Scores compare as in SQL:
    NaN is the largest, and nothing is more or less than a null."""
    n = len(g)
    known, numbered = s.is_valid().to_numpy(False), no.is_valid().to_numpy(False)
    number, score = pc.rank(no, tiebreaker="dense").to_numpy(), s.fill_null(0.0).to_numpy(False)
    nan, size = np.isnan(score), np.repeat(races, races)
    start = np.repeat(np.cumsum(races) - races, races)
    place = np.zeros(n)
    for first, stop in _chunks(size):
        i, j = _pairs(size, start, first, stop)
        before = (score[j] > score[i]) | (nan[j] & ~nan[i])
        level = (score[j] == score[i]) | (nan[j] & nan[i])
        before |= level & (number[j] < number[i]) & numbered[i] & numbered[j]
        place[first:stop] = np.bincount(i - first, before & known[i] & known[j], stop - first)
    d = 1.0 / np.log2(place + 2.0)
    race = np.repeat(np.arange(len(races)), races)
    falling = g[np.lexsort((-g, ~np.isnan(g), race))]  # NaN first
    best = np.bincount(race, falling / np.log2(np.arange(n) - start + 2.0), len(races))[race]
    l, h, lost = np.zeros(n), np.zeros(n), np.zeros(n)
    for first, stop in _chunks(size):
        i, j = _pairs(size, start, first, stop)
        other = ~((g[i] == g[j]) | (np.isnan(g[i]) & np.isnan(g[j]))) & ((best[i] > 0) | np.isnan(best[i]))
        i, j = i[other], j[other]
        change = np.abs((g[i] - g[j]) * (d[i] - d[j])) / best[i]
        sign = np.sign(g[i] - g[j])
        rho = 1.0 / (1.0 + np.exp(sign * (score[i] - score[j])))
        for out, x in ((l, sign * rho * change), (h, rho * (1 - rho) * change), (lost, ~(known[i] & known[j]))):
            out[first:stop] = np.bincount(i - first, x, stop - first)
    weight, teaches = w.fill_null(0.0).to_numpy(False), (best > 0) | np.isnan(best)
    null = teaches & ((lost > 0) | ~w.is_valid().to_numpy(False))
    return np.where(teaches, l * weight, 0.0), np.where(teaches, h * weight, 0.0), null


def with_gradients(races: DataFrame) -> DataFrame:
    """``races`` with ``grads``: array of (l, h), in the order of ``runners``.

    A pair of runners with different gains counts with the change of the race's normalised discounted gain if the two
    changed places in the order of the scores (ties by number). With rho = 1 / (1 + exp(better's score - other's score)),
    the better one's gradient l rises and the other's falls by rho times that change, and both curvatures h rise by
    rho (1 - rho) times it. A batch of races is worked on at once, ``PAIRS`` pairs at a time.
    """
    grad = pa.struct([("l", pa.float64()), ("h", pa.float64())])
    schema = T.StructType([*races.schema.fields, T.StructField("grads", T.ArrayType(T.StructType([
        T.StructField("l", T.DoubleType()), T.StructField("h", T.DoubleType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runners = batch.column("runners")
            field = {c: pc.struct_field(runners.flatten(), c) for c in ("no", "g", "w", "s")}
            sizes = pc.list_value_length(runners).to_numpy(False).astype(np.int64)
            with np.errstate(all="ignore"):
                l, h, null = _batch_gradients(field["no"], field["g"].to_numpy(False), field["w"], field["s"], sizes)
            each = pa.StructArray.from_arrays([pa.array(x, mask=null) for x in (l, h)], fields=list(grad))
            grads = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), each)
            yield pa.RecordBatch.from_arrays([*batch.columns, grads], names=[*batch.schema.names, "grads"])

    return races.mapInArrow(run, schema)


def gradients(df: DataFrame, gain: str, score: str, most: int | None = MAX_RUNNERS) -> DataFrame:
    """``gradient`` and ``curvature`` of each entry for the given scores. A race of more than ``most`` runners is an error."""
    rows = with_gradients(grouped(df, gain, F.col(score), most=most))
    each = rows.select(RACE, F.explode(F.arrays_zip("runners", "grads")).alias("r"))
    return each.select(RACE, F.col("r.runners.no").alias(ENTRY), F.col("r.grads.l").alias("gradient"), F.col("r.grads.h").alias("curvature"))


# ---- trees --------------------------------------------------------------------------------------------------------

def parse_tree(text: str) -> list:
    """A tree from its description: ``["split", feature, threshold or categories, left, right]`` or ``["leaf", number]``."""
    lines = iter(x.strip() for x in text.splitlines()[1:] if x.strip())
    count = [0]

    def node() -> list:
        line = next(lines)
        if line.startswith("Predict"):
            count[0] += 1
            return ["leaf", count[0] - 1]
        found = re.match(r"If \(feature (\d+) (?:<= (\S+)|in \{([^}]*)\})\)", line)
        by = float(found[2]) if found[2] else [float(v) for v in found[3].split(",")]
        left = node()
        next(lines)  # the line of the other branch
        return ["split", int(found[1]), by, left, node()]

    return node()


def walk(tree: list, x: Column, leaf) -> Column:
    """What ``leaf`` gives for the leaf that the feature array ``x`` falls into."""
    if tree[0] == "leaf":
        return leaf(tree[1])
    _, feature, by, left, right = tree
    value = F.get(x, F.lit(feature))
    goes = value.isin(by) if isinstance(by, list) else value <= by
    return F.when(goes, walk(left, x, leaf)).otherwise(walk(right, x, leaf))


def leaves(tree: list) -> int:
    return 1 if tree[0] == "leaf" else leaves(tree[3]) + leaves(tree[4])


@dataclass
class RankModel:
    """Preparation of the features, and trees with the values of their leaves (learning rate included)."""

    prepare: PipelineModel
    trees: list = field(default_factory=list)
    values: list = field(default_factory=list)

    def array(self, df: DataFrame) -> DataFrame:
        nums = [c[:-3] for s in self.prepare.stages if hasattr(s, "getOutputCols") for c in s.getOutputCols() if c.endswith("__n")]
        return self.prepare.transform(df.withColumns({c: F.col(c).cast("double") for c in nums})).withColumn("__a", vector_to_array("__x"))

    def kinds(self) -> dict:
        """What the trees are told of the features: which are categories, and how many there are."""
        sizes = [len(labels) + 1 for s in self.prepare.stages if hasattr(s, "labelsArray") for labels in s.labelsArray]
        inputs = self.prepare.stages[-1].getInputCols()
        nominal = [{"idx": i, "name": c, "num_vals": n} for i, (c, n) in enumerate(zip(inputs, sizes))]
        numeric = [{"idx": i, "name": c} for i, c in enumerate(inputs) if i >= len(sizes)]
        kinds = {k: v for k, v in (("nominal", nominal), ("numeric", numeric)) if v}
        return {"ml_attr": {"attrs": kinds, "num_attrs": len(inputs)}}

    def score(self, df: DataFrame, out: str) -> DataFrame:
        score = F.lit(0.0)
        for tree, values in zip(self.trees, self.values, strict=True):
            score = score + walk(tree, F.col("__a"), lambda k, v=values: F.lit(v[k]))
        return self.array(df).withColumn(out, score).select(*df.columns, out)


def _moved(tree: list, values: list[float]):
    return lambda runner: runner.withField("s", runner["s"] + walk(tree, runner["x"], lambda n: F.lit(values[n])))


def fit_rank(df: DataFrame, prepare: PipelineModel, gain: str = "relevance", weight: str | None = None, rounds: int = 20, depth: int = 4,
             step: float = 0.1, ridge: float = 1.0, least: int = 20, bins: int = 64, seed: int = 7) -> RankModel:
    """Boost ``rounds`` trees of ``depth`` on entries with relevance ``gain`` (higher: better) and an optional race ``weight``.

    Races without two different gains teach nothing. A race may have any number of runners.
    """
    model = RankModel(prepare)
    ready = model.array(df)
    meta = model.kinds()
    state = stored(grouped(ready, gain, F.lit(0.0), F.col("__a"), weight))
    for k in range(rounds):
        zipped = with_gradients(state).select(F.explode(F.arrays_zip("runners", "grads")).alias("r"))
        rows = zipped.select(F.col("r.runners.x").alias("a"), F.col("r.grads.l").alias("l"), F.col("r.grads.h").alias("h")).filter("h > 0")
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            data = rows.select(array_to_vector("a").alias("v", metadata=meta), (F.col("l") / F.col("h")).alias("y"), F.col("h").alias("w"))
            if rows.count() == 0:  # by all tasks; the first row alone would be looked for in one partition after the other
                break
            tree = DecisionTreeRegressor(featuresCol="v", labelCol="y", weightCol="w", maxDepth=depth, maxBins=bins, minInstancesPerNode=least,
                                         seed=seed + k).fit(data)
            shape = parse_tree(tree.toDebugString)
            sums = rows.groupBy(walk(shape, F.col("a"), lambda n: F.lit(n)).alias("leaf")).agg(F.sum("l").alias("l"), F.sum("h").alias("h")).collect()
            values = [0.0] * leaves(shape)
            for r in sums:
                values[r.leaf] = step * r.l / (r.h + ridge)
        finally:
            rows.unpersist()
        model.trees.append(shape)
        model.values.append(values)
        state = state.withColumn("runners", F.transform("runners", _moved(shape, values)))
        if (k + 1) % WRITE_EVERY == 0 and k + 1 < rounds:
            state = stored(state)
    return model


def save_rank(model: RankModel, spark, path: str) -> None:
    model.prepare.write().overwrite().save(f"{path}/prepare")
    spark.createDataFrame([(json.dumps([model.trees, model.values]),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/trees")


def load_rank(spark, path: str) -> RankModel:
    trees, values = json.loads(spark.read.text(f"{path}/trees").first().value)
    return RankModel(PipelineModel.load(f"{path}/prepare"), trees, values)
