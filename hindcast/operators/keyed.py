"""Ordered windows over keys of unknown size.

``Window.partitionBy(key)`` puts every row of a key into one task. An entity may hold a third of all rows, so each
keyed window here runs over ``(key, lane)``:

* ordinary keys have the single lane 0 and cost one shuffle, as a plain window does;
* rows with a null key take part in no group (their result is null) and are spread over many lanes;
* keys that hold more rows than an even share of the shuffle partitions are split in order by
  ``repartitionByRange`` on (key, order), and the split is pinned with a reliable checkpoint. Look-back windows
  then receive the last rows of the lanes before, running totals receive the totals of the lanes before.
  Both side tables are bounded by the number of lanes, not by the data.

The answer is the same whichever way a key takes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from hindcast.session import ensure_checkpoint_dir

LANE, HALO = "__lane", "__halo"
HOT_ROWS_CONF = "hindcast.hot.rows"
HOT_ROWS_DEFAULT = 2_000_000
NULL_LANES = 4096


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _any_null(keys: Sequence[str]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.col(k).isNull()
    return out


def hot_keys(df: DataFrame, keysets: Mapping[str, Sequence[str]]) -> dict[str, list[int]]:
    """Hashes of the oversized keys of each key set: one pass, mergeable sketches, no shuffle of rows.

    A key is oversized when it holds more rows than both the floor and an even share of the partitions, so at most
    one key per partition can qualify. The sketch only decides the route of a key, never a result.
    """
    spark = df.sparkSession
    parts = _partitions(spark)
    k = min(parts, 10_000)
    items = min(max(10 * k, 1000), 1_000_000)
    aggs = [F.count(F.lit(1)).alias("total")]
    for name, keys in keysets.items():
        hashed = F.when(~_any_null(keys), F.xxhash64(*keys))
        aggs.append(F.call_function("approx_top_k", hashed, F.lit(k), F.lit(items)).alias(name))
    row = df.agg(*aggs).first()
    floor = int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))
    limit = max(floor, row["total"] / parts)
    return {n: [int(x["item"]) for x in (row[n] or []) if x["item"] is not None and x["count"] > limit]
            for n in keysets}


@dataclass
class Keyed:
    """A frame tagged with lanes for one key set."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    split: bool
    _tails: dict = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, keys: Sequence[str], order: Sequence[str],
           hot: Sequence[int] | None = None) -> Keyed:
        """Tag ``df``; ``hot`` comes from :func:`hot_keys` (looked up here when not given)."""
        keys, order = list(keys), list(order)
        if hot is None:
            hot = hot_keys(df, {"k": keys})["k"]
        spread = -1 - F.pmod(F.xxhash64(*order), F.lit(NULL_LANES)).cast("int")
        if not hot:
            return cls(df.withColumn(LANE, F.when(_any_null(keys), spread).otherwise(0)), keys, order, False)
        spark = df.sparkSession
        ensure_checkpoint_dir(spark)
        is_hot = F.coalesce(F.xxhash64(*keys).isin([int(h) for h in hot]) & ~_any_null(keys), F.lit(False))
        cold = df.filter(~is_hot).withColumn(LANE, F.when(_any_null(keys), spread).otherwise(0))
        lanes = (
            df.filter(is_hot)
            .repartitionByRange(_partitions(spark), *keys, *order)
            .withColumn(LANE, F.spark_partition_id() + 1)
            .checkpoint()
        )
        return cls(cold.unionByName(lanes), keys, order, True)

    def _window(self, within: Sequence[str]) -> WindowSpec:
        return Window.partitionBy(*self.keys, LANE, *within).orderBy(*self.order)

    def _masked(self, exprs: Mapping[str, Column], within: Sequence[str]) -> dict[str, Column]:
        gone = _any_null([*self.keys, *within])
        return {n: F.when(~gone, e) for n, e in exprs.items()}

    def look_back(self, exprs: Mapping[str, Callable[[WindowSpec], Column]], rows: int,
                  within: Sequence[str] = ()) -> Keyed:
        """Add window columns that read at most ``rows`` earlier rows of the key.

        ``within`` narrows the group to more columns without another shuffle.
        """
        w = self._window(within)
        cols = self._masked({n: fn(w) for n, fn in exprs.items()}, within)
        if not self.split:
            return Keyed(self.df.withColumns(cols), self.keys, self.order, False)
        group = [*self.keys, *within]
        laned = self.df.filter((F.col(LANE) > 0) & ~_any_null(group))
        newest = Window.partitionBy(*group, LANE).orderBy(*[F.col(c).desc() for c in self.order])
        tails = laned.withColumn("__rn", F.row_number().over(newest)).filter(F.col("__rn") <= rows).drop("__rn")
        present = laned.select(*group, LANE).distinct().withColumn(
            "__seq", F.row_number().over(Window.partitionBy(*group).orderBy(LANE)))
        ahead = F.explode(F.sequence(F.col("__seq") + 1, F.col("__seq") + rows))
        halo = (
            tails.join(present, [*group, LANE])
            .withColumn("__seq", ahead)
            .drop(LANE)
            .join(present, [*group, "__seq"])
            .drop("__seq")
        )
        both = self.df.withColumn(HALO, F.lit(False)).unionByName(halo.withColumn(HALO, F.lit(True)))
        out = both.withColumns(cols).filter(~F.col(HALO)).drop(HALO)
        return Keyed(out, self.keys, self.order, True)

    def running(self, sums: Mapping[str, Column], within: Sequence[str] = ()) -> Keyed:
        """Add the totals of ``sums`` over all strictly earlier rows of the key (0 when there are none)."""
        w = self._window(within).rowsBetween(Window.unboundedPreceding, -1)
        cols = {n: F.coalesce(F.sum(e).over(w), F.lit(0)) for n, e in sums.items()}
        if not self.split:
            return Keyed(self.df.withColumns(self._masked(cols, within)), self.keys, self.order, False)
        group = [*self.keys, *within]
        totals = (
            self.df.filter((F.col(LANE) > 0) & ~_any_null(group))
            .groupBy(*group, LANE)
            .agg(*[F.coalesce(F.sum(e), F.lit(0)).alias(f"__t_{n}") for n, e in sums.items()])
        )
        before = Window.partitionBy(*group).orderBy(LANE).rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(*group, LANE, *[F.sum(f"__t_{n}").over(before).alias(f"__b_{n}") for n in sums])
        out = self.df.withColumns(cols).join(carry, [*group, LANE], "left")
        out = out.withColumns(self._masked(
            {n: F.col(n) + F.coalesce(F.col(f"__b_{n}"), F.lit(0)) for n in sums}, within))
        return Keyed(out.drop(*[f"__b_{n}" for n in sums]), self.keys, self.order, True)

    def result(self) -> DataFrame:
        return self.df.drop(LANE)


def dense_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "idx") -> DataFrame:
    """1-based position of each row within its key, without putting a key into one task."""
    out = Keyed.of(df, keys, order).running({name: F.lit(1).cast("long")}).result()
    return out.withColumn(name, F.col(name) + 1)


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], settle: int = 200_000) -> list[float] | None:
    """Linearly interpolated quantiles, exact, from map-side combined passes only.

    While the column has more than ``settle`` distinct values, approximate percentiles bracket each wanted order
    statistic and only the bracket is looked at again. The order statistics are then read off the value counts of
    the bracket, so no task holds more than ``settle`` values and the driver sees scalars.
    """
    base = df.select(F.col(col).cast("double").alias("x")).filter(F.col("x").isNotNull())
    size = base.agg(F.count("x"), F.approx_count_distinct("x")).first()
    n = size[0]
    if n == 0:
        return None
    ranks = []
    for p in probs:
        h = (n - 1) * p
        ranks.append((int(h), min(int(h) + 1, n - 1), h - int(h)))
    if size[1] <= settle:
        found = _at_ranks(base, 0, sorted({r for lo, hi, _ in ranks for r in (lo, hi)}))
    else:
        found = {}
        for lo, hi, _ in ranks:
            part, skipped = _bracket(base, n, lo, hi, settle)
            found.update(_at_ranks(part, skipped, sorted({lo, hi})))
    return [found[lo] + (found[hi] - found[lo]) * frac for lo, hi, frac in ranks]


def _at_ranks(part: DataFrame, skipped: int, ranks: Sequence[int]) -> dict[int, float]:
    """Order statistics (0-based ranks of the whole column) from the value counts of ``part``."""
    counts = part.groupBy("x").count()
    upto = counts.withColumn("cum", F.sum("count").over(Window.orderBy("x")))  # at most ``settle`` rows
    row = upto.agg(*[F.min(F.when(F.col("cum") > r - skipped, F.col("x"))) for r in ranks]).first()
    return dict(zip(ranks, row))


def _bracket(base: DataFrame, n: int, lo: int, hi: int, settle: int) -> tuple[DataFrame, int]:
    part, skipped, size = base, 0, n
    while True:
        eps = 0.001
        want = [max(0.0, (lo - skipped) / size - eps), min(1.0, (hi - skipped) / size + eps)]
        a, b = part.agg(F.percentile_approx("x", want, 100_000)).first()[0]
        x = F.col("x")
        row = part.agg(F.count_if(x < a), F.count_if((x >= a) & (x <= b)),
                       F.approx_count_distinct(F.when((x >= a) & (x <= b), x))).first()
        part = base.filter((x >= a) & (x <= b))
        skipped += row[0]
        if row[2] <= settle or row[1] == size:
            return part, skipped
        size = row[1]
