"""Bootstrap intervals by reproducible resampling.

``method='poisson'`` (default) gives every unit an independent Poisson(1) count per replicate. The count is a
function of the unit key and the replicate, so it needs no row numbers and no random state: each lane of units multiplies a
matrix of counts with the units' values, and only ``LANES x cells x replicates`` rows move, whatever the number of partitions.
``method='draws'`` draws exactly n bets per replicate by their index in the cell: draw i of a replicate takes the bet that a
function of the cell, i and the replicate names. A task has a lane of the draws and a range of the returns of one cell, and hands
on the sum of its draws that fall into its range. ``drawn_sums`` draws the same number by multinomials, from bets counted by return.

The counts come from a cubic polynomial over a prime field whose coefficients are taken from the md5 of the unit key:
replicates of a unit are four-wise independent and units are independent. Integer arithmetic only, so any engine
gets the same counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from hashlib import md5
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from hindcast import schema as S
from hindcast.operators.bets import fill_grid, gated_bets, merged
from hindcast.operators.evaluate import flat_stats, stat_exprs
from hindcast.operators.keyed import dense_index
from hindcast.operators.race import ENTRY, RACE
from hindcast.session import stored

PRIME = 268435399  # largest prime below 2**28: seven hex digits per coefficient
POISSON_CUTS = [round(PRIME * exp(-1) * sum(1 / factorial(k) for k in range(m + 1))) for m in range(9)]


def _coefficients(seed: int, unit: Sequence[str]) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in unit]))
    parts = [F.conv(F.substring(digest, 1 + 7 * i, 7), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    return F.struct(*parts)


def _uniform(h: Column, b: Column) -> Column:
    """An integer in [0, PRIME) for replicate ``b`` (0-based)."""
    t = (b + 1).cast("long")
    x = (h["h3"] * t + h["h2"]) % PRIME
    x = (x * t + h["h1"]) % PRIME
    return (x * t + h["h0"]) % PRIME


def poisson_count(x: Column) -> Column:
    out = F.lit(0)
    for cut in POISSON_CUTS:
        out = out + (x >= cut).cast("int")
    return out


def replicates(df: DataFrame, unit: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """``df`` once per replicate with columns ``b`` and ``w`` (count of the unit, rows with count 0 left out): the counts
    themselves, for looking at them. Sums over them are what ``replicate_sums`` is for."""
    x = _uniform(F.col("__h"), F.col("b"))
    rows = df.withColumn("__h", _coefficients(seed, unit)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    return rows.filter(x >= POISSON_CUTS[0]).withColumn("w", poisson_count(x)).drop("__h")


#: Units whose counts are held at a time, and replicates whose counts are made at a time, so that they stay in a core's cache.
BLOCK_UNITS, BLOCK_BOOTS = 10_240, 32
#: Tasks that the units are spread over; each hands on one row for each cell and replicate.
LANES = 32


class UnitCounts:
    """Counts of up to ``BLOCK_UNITS`` units in a range of replicates, in buffers that are used again."""

    def __init__(self) -> None:
        shape = (BLOCK_BOOTS, BLOCK_UNITS)
        self.x, self.over, self.n, self.w = np.empty(shape, np.uint32), np.empty(shape, bool), np.empty(shape, np.int8), np.empty(shape)
        self.less = np.empty(BLOCK_UNITS, np.uint32)
        self.units, self.next, self.state = None, 0, []

    def _begin(self, h: np.ndarray, first: int) -> list[np.ndarray]:
        """The values at a replicate, and their first three differences there."""
        a = h.astype(np.int64)
        at = [(((a[:, 3] * t + a[:, 2]) % PRIME * t + a[:, 1]) % PRIME * t + a[:, 0]) % PRIME for t in range(first + 1, first + 5)]
        steps = [at]
        for _ in range(3):
            steps.append([(q - p) % PRIME for p, q in zip(steps[-1], steps[-1][1:])])
        return [v[0].astype(np.uint32) for v in steps]

    def uniform(self, h: np.ndarray, first: int, last: int) -> np.ndarray:
        """Rows for the replicates ``first`` to ``last`` - 1, columns for the units with coefficients ``h``: integers in [0, PRIME).

        The values of a cubic follow from its value and three differences at the first replicate by additions alone. All stay
        below the modulus: a sum that is not is taken less the modulus, and one that is wraps around to something larger.
        """
        part = (slice(last - first), slice(len(h)))
        x, less = self.x[part], self.less[part[1]]
        if self.units is not h or self.next != first:  # else the replicates go on where the last ones ended
            self.state = self._begin(h, first)
        now, d1, d2, d3 = self.state
        prime = np.uint32(PRIME)

        def add(p: np.ndarray, q: np.ndarray, out: np.ndarray) -> None:
            np.add(p, q, out=out)
            np.subtract(out, prime, out=less)
            np.minimum(out, less, out=out)

        for k in range(last - first):
            x[k] = now
            add(now, d1, now)
            add(d1, d2, d1)
            add(d2, d3, d2)
        self.units, self.next = h, last
        return x

    def of(self, h: np.ndarray, first: int, last: int) -> np.ndarray:
        """Rows for the units with coefficients ``h``, columns for the replicates ``first`` to ``last`` - 1."""
        part = (slice(last - first), slice(len(h)))
        x, over, n, w = self.uniform(h, first, last), self.over[part], self.n[part], self.w[part]
        np.greater_equal(x, np.uint32(POISSON_CUTS[0]), out=over)
        n[:] = over
        for cut in POISSON_CUTS[1:]:
            np.greater_equal(x, np.uint32(cut), out=over)
            n += over.view(np.int8)
        w[:] = n
        return w.T


def replicate_sums(df: DataFrame, unit: Sequence[str], values: Mapping[str, Column], n_boot: int, seed: int,
                   cells: Sequence[str] = (), repeated: bool = False) -> DataFrame:
    """For each cell and replicate ``b`` the sums of ``values`` over the units, each times its count.

    The task of a lane multiplies blocks of units (counts x values) and adds up per cell, so that it hands on one row for each
    cell and replicate, however many units it has. A replicate that draws no unit has sums of 0; a null value counts as 0.
    ``repeated``: units have rows in several cells; a lane is then sorted by unit, and the counts of a unit are made once.
    """
    cells, names = list(cells), list(values)
    rows = df.repartition(LANES, F.xxhash64(*unit))
    rows = rows.sortWithinPartitions(*unit) if repeated else rows
    rows = rows.select(
        *cells, _coefficients(seed, unit).alias("__h"), *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(n) for n, v in values.items()])
    rows = rows.select(*cells, *[F.col("__h")[f"h{i}"].alias(f"__h{i}") for i in range(4)], *names)
    kept = [f for f in rows.schema.fields if f.name in cells]
    schema = T.StructType([*kept, T.StructField("b", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        counts = UnitCounts()
        for batch in batches:
            if not batch.num_rows:
                continue
            h = np.stack([batch.column(f"__h{i}").to_numpy() for i in range(4)], axis=1)
            v = np.stack([batch.column(n).to_numpy() for n in names], axis=1)
            of: dict[tuple, list[int]] = {}
            for i, cell in enumerate(zip(*[batch.column(c).to_pylist() for c in cells]) if cells else [()] * batch.num_rows):
                of.setdefault(cell, []).append(i)
            if repeated:
                new = np.append(True, (h[1:] != h[:-1]).any(axis=1))
                h, at = h[new], np.cumsum(new) - 1  # the unit of each row
                rows_of = {cell: np.array(own) for cell, own in of.items()}
            else:
                order = np.concatenate([np.array(own) for own in of.values()])
                h, v, at = h[order], v[order], np.arange(len(h))
                ends = np.cumsum([len(own) for own in of.values()])
                rows_of = {cell: np.arange(end - len(own), end) for (cell, own), end in zip(of.items(), ends)}
            for k in range(0, len(h), BLOCK_UNITS):
                block = h[k:k + BLOCK_UNITS]
                shares = []
                for cell, own in rows_of.items():
                    a, b = np.searchsorted(at[own], [k, k + BLOCK_UNITS])
                    if a < b:
                        held = at[own[a:b]] - k
                        total = sums.setdefault(cell, np.zeros((n_boot, len(names))))
                        shares.append((slice(held[0], held[-1] + 1) if held[-1] - held[0] == b - a - 1 and (np.diff(held) == 1).all() else held, v[own[a:b]], total))
                for first in range(0, n_boot, BLOCK_BOOTS):
                    last = min(n_boot, first + BLOCK_BOOTS)
                    w = counts.of(block, first, last)
                    for held, part, total in shares:
                        total[first:last] += w[held].T @ part
        for cell, total in sums.items():
            cols = [pa.array([x] * n_boot, to_arrow_type(f.dataType)) for x, f in zip(cell, kept)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(n_boot)), *[pa.array(total[:, j].copy()) for j in range(len(names))]],
                                             names=[*cells, "b", *names])

    return rows.mapInArrow(run, schema).groupBy(*cells, "b").agg(*[F.sum(n).alias(n) for n in names])


def _interval(rates: DataFrame, cells: Sequence[str], col: str, level: float) -> DataFrame:
    alpha = 1 - level
    q = F.percentile(col, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    agg = rates.groupBy(*cells).agg(q.alias("q")) if cells else rates.agg(q.alias("q"))
    return agg.select(*cells, F.col("q")[0].alias("ci_lower"), F.col("q")[1].alias("ci_upper"))


def _flags(df: DataFrame, level: float) -> DataFrame:
    return df.withColumns({
        "ci_level": F.lit(float(level)),
        "above_100": F.coalesce(F.col("ci_lower") > 1.0, F.lit(False)),
        "above_110": F.coalesce(F.col("ci_lower") > 1.1, F.lit(False)),
    })


def bootstrap_ci(bets: DataFrame, unit: Sequence[str], cells: Sequence[str] = (), hit: str = "is_hit",
                 odds: str = "payout_odds", n_boot: int = 10_000, level: float = 0.95, seed: int = 42,
                 method: str = "poisson", repeated: bool = False) -> DataFrame:
    """Recovery per cell with its interval: point_estimate, n_bets, ci_lower, ci_upper and the two flags.

    ``unit`` names the bet; bets of one unit are drawn together (by ``draws`` each on its own). A missing price counts as a
    lost stake. ``repeated``: a unit has bets in several cells.
    """
    cells = list(cells)
    x = bets.select(*cells, *[c for c in unit if c not in cells],
                    F.coalesce(F.col(hit) * F.col(odds), F.lit(0.0)).alias("__x"))
    n = F.count(F.lit(1)).alias("n_bets")
    mean = F.avg("__x").alias("point_estimate")
    point = x.groupBy(*cells).agg(n, mean) if cells else x.agg(n, mean)
    if method == "poisson":
        r = replicate_sums(x, unit, {"s": F.col("__x"), "n": F.lit(1)}, n_boot, seed, cells, repeated)
        r = r.filter("n > 0").withColumn("rate", F.col("s") / F.col("n"))
    else:
        r = indexed_sums(x, unit, cells, n_boot, seed).withColumn("rate", F.col("s") / F.col("n"))
    ci = _interval(r, cells, "rate", level)
    joined = point.join(ci, cells, "left") if cells else point.withColumn("q", ci.select(F.struct("ci_lower", "ci_upper")).scalar()
                                                                        ).select("n_bets", "point_estimate", "q.*")
    return _flags(joined, level)


#: Returns of a cell that a task has at hand, returns that are moved together, and draws of a lane at least.
INDEX_RANGE, INDEX_BLOCK, LANE_DRAWS = 1 << 22, 1 << 15, 4096


def _hashed(prefix: str, first: int, last: int) -> np.ndarray:
    """The coefficients of ``_coefficients`` for ``prefix`` and the numbers ``first`` to ``last`` - 1, from the first 28 digits of the md5."""
    digests = b"".join(md5(f"{prefix}|{i}".encode()).digest()[:14] for i in range(first, last))
    d = np.frombuffer(digests, np.uint8).reshape(-1, 14).astype(np.int64)
    even = lambda k: d[:, k] << 20 | d[:, k + 1] << 12 | d[:, k + 2] << 4 | d[:, k + 3] >> 4
    odd = lambda k: (d[:, k] & 15) << 24 | d[:, k + 1] << 16 | d[:, k + 2] << 8 | d[:, k + 3]
    return np.stack([even(0), odd(3), even(7), odd(10)], axis=1)


def indexed_sums(x: DataFrame, unit: Sequence[str], cells: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """For each cell and replicate ``b`` the sum ``s`` of the returns ``__x`` of its ``n`` draws with replacement, by index.

    The n bets of a cell are numbered in the order of ``unit``. Draw i of replicate b takes the bet ``1 + u * n // PRIME`` with ``u`` the
    value of (cell, i) at b. A task has one lane of the draws of a cell and one range of its returns, which is bounded; the
    more ranges a cell has, the fewer lanes, so that a return moves at most ``LANES`` times.
    """
    whole = [*cells] or ["__all"]
    base = (x if cells else x.withColumn("__all", F.lit(0))).withColumn("__cell", F.struct(*whole))
    span, order = INDEX_RANGE, [*[c for c in unit if c not in whole], "__x"]
    rows = stored(dense_index(base.select("__cell", *order), ["__cell"], order, "__i"))
    sizes = rows.groupBy("__cell").agg(F.count(F.lit(1)).alias("n"))
    place = F.col("__i") - 1
    packed = rows.groupBy("__cell", F.floor(place / span).alias("range"), F.floor(place / INDEX_BLOCK).alias("block")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("__i", "__x"))), lambda v: v["__x"]).alias("xs"))
    by_ranges = F.floor(F.lit(LANES) / F.ceil(F.col("n") / span))
    lanes = F.greatest(F.lit(1), F.least(by_ranges, F.ceil(F.col("n") / LANE_DRAWS))).cast("int")
    named = [F.col("__cell")[c].alias(c) for c in whole]
    parts = packed.join(sizes.withColumn("lanes", lanes), "__cell").select(*named, "range", "block", "xs", "n", "lanes", F.explode(
        F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane")).withColumn("prefix", F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in whole]))
    kept = [base.schema[c] for c in whole]
    schema = T.StructType([*kept, T.StructField("b", T.LongType()), T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])

    def draw(group):
        import pandas as pd
        group = group.sort_values("block")
        one = group.iloc[0]
        n, lo = int(one["n"]), int(one["range"]) * span
        returns = np.concatenate([[0.0], *group["xs"], [0.0]])  # what is drawn from another range counts 0 here
        begin, end = int(one["lane"]) * n // int(one["lanes"]), (int(one["lane"]) + 1) * n // int(one["lanes"])
        total, values = np.zeros(n_boot), UnitCounts()
        for k in range(begin, end, BLOCK_UNITS):
            h = _hashed(one["prefix"], k + 1, min(k + BLOCK_UNITS, end) + 1)
            pick, drawn = np.empty(len(h), np.int64), np.empty(len(h))
            for first in range(0, n_boot, BLOCK_BOOTS):
                last = min(n_boot, first + BLOCK_BOOTS)
                for b, u in enumerate(values.uniform(h, first, last), first):  # a replicate at a time stays in a core's cache
                    np.multiply(u, n, out=pick, dtype=np.int64)
                    np.floor_divide(pick, PRIME, out=pick)
                    np.subtract(pick, lo - 1, out=pick)
                    total[b] += np.take(returns, pick, mode="clip", out=drawn).sum()
        out = pd.DataFrame({"b": np.arange(n_boot), "s": total, "n": n})
        for c in whole:
            out[c] = [one[c]] * n_boot
        return out[[*whole, "b", "s", "n"]]

    sums = parts.groupBy(*whole, "range", "lane").applyInPandas(draw, schema)
    return sums.groupBy(*whole, "b").agg(F.sum("s").alias("s"), F.max("n").alias("n")).drop("__all")


#: Replicates that are drawn at a time, and entries that one multinomial draw is split over.
DRAW_BLOCK, DRAW_WIDTH = 500, 1024


def _draw(rng: np.random.Generator, totals: np.ndarray, weights: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each of ``totals`` the sum of so many values, drawn in proportion to their integer weights."""
    if len(weights) <= DRAW_WIDTH:
        return rng.multinomial(totals, weights / weights.sum()) @ values
    cuts = np.arange(0, len(weights), -(-len(weights) // DRAW_WIDTH))
    parts = np.add.reduceat(weights, cuts)
    each = rng.multinomial(totals, parts / parts.sum())
    ends = np.append(cuts[1:], len(weights))
    return sum(_draw(rng, each[:, k], weights[a:b], values[a:b]) for k, (a, b) in enumerate(zip(cuts, ends, strict=True)))


def _generator(seed: int, *key) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(md5("|".join(map(str, (seed, *key))).encode()).digest(), "little"))


def drawn_sums(x: DataFrame, cells: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """For each cell and replicate ``b`` the sum ``s`` of the returns ``__x`` of exactly ``n`` draws with replacement from its n bets.

    Bets are counted by return first, map-side combined. A task then splits the n draws of a block of replicates over the
    lanes of returns, and the task of a lane splits its share over the lane's returns. What is drawn depends on the cell, the
    lane, the block and the seed, not on the partitions.
    """
    whole = [*cells] or ["__all"]
    base = x if cells else x.withColumn("__all", F.lit(0))
    counted = base.groupBy(*whole, "__x").agg(F.count(F.lit(1)).alias("m")).withColumn("lane", F.pmod(F.xxhash64("__x"), F.lit(LANES)).cast("int"))
    keys = [base.schema[c] for c in whole]
    sizes = counted.groupBy(*whole, "lane").agg(F.sum("m").alias("m"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // DRAW_BLOCK))).alias("block")
    split_to = T.StructType([*keys, *[T.StructField(c, T.IntegerType()) for c in ("lane", "block")], T.StructField("draws", T.ArrayType(T.LongType()))])

    def split(group):
        group = group.sort_values("lane")
        first = group.iloc[0]
        rng = _generator(seed, *[first[c] for c in whole], "block", first["block"])
        total, held = int(group["m"].sum()), min(DRAW_BLOCK, n_boot - DRAW_BLOCK * int(first["block"]))
        each = rng.multinomial(np.full(held, total), group["m"].to_numpy() / total)
        return group[[*whole, "lane", "block"]].assign(draws=list(each.T))

    draws = sizes.select(*whole, "lane", "m", blocks).groupBy(*whole, "block").applyInPandas(split, split_to)
    sum_to = T.StructType([*keys, T.StructField("b", T.LongType()), T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])

    def draw(values, shares):
        import pandas as pd
        values = values.sort_values("__x")
        weights, returns, out = values["m"].to_numpy(), values["__x"].to_numpy(), []
        key = [values.iloc[0][c] for c in whole]
        for block, own in zip(shares["block"].tolist(), shares["draws"], strict=True):
            own = np.asarray(own, dtype=np.int64)
            s = _draw(_generator(seed, *key, "lane", values.iloc[0]["lane"], block), own, weights, returns)
            out.append(pd.DataFrame({"b": block * DRAW_BLOCK + np.arange(len(own)), "s": s, "n": own}))
        done = pd.concat(out, ignore_index=True)
        for c, v in zip(whole, key, strict=True):
            done[c] = [v] * len(done)
        return done[[*whole, "b", "s", "n"]]

    by_lane = [*whole, "lane"]
    sums = counted.groupBy(*by_lane).cogroup(draws.groupBy(*by_lane)).applyInPandas(draw, sum_to)
    return sums.groupBy(*whole, "b").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).drop("__all")


GRID_AXES = {"tier": [S.ALL_TIER, *S.POP_TIERS]}


def _grid_ci(ci: DataFrame, thresholds: Sequence[float], level: float) -> DataFrame:
    full = fill_grid(ci.drop("ci_level", "above_100", "above_110"), ["threshold", "tier"], ["n_bets"],
                     threshold=[float(t) for t in thresholds], **GRID_AXES)
    return _flags(full, level)


def grid_ci(bets: DataFrame, unit: Sequence[str], thresholds: Sequence[float], cells: Sequence[str] = (), n_boot: int = 10_000,
            level: float = 0.95, seed: int = 42, repeated: bool = False) -> DataFrame:
    """Intervals for every cell of the threshold x tier grid, for each combination of ``cells``, from bets with ``ev``, ``tier`` and
    return ``x``.

    A bet takes part in at most thresholds x 2 cells; these are conditional sums over its replicates, so the bets are
    multiplied by the replicates only.
    """
    cells = list(cells)
    m = bets.filter(F.col("ev") > min(thresholds)).select(*unit, *cells, "ev", "tier", F.coalesce("x", F.lit(0.0)).alias("x"))
    ths = list(enumerate(thresholds))

    terms = {}
    for i, t in ths:
        ok = F.col("ev") > t
        terms |= {f"s{i}": F.when(ok, F.col("x")).otherwise(0.0), f"n{i}": F.when(ok, 1).otherwise(0)}

    def long(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        names = [c for i, _ in ths for c in (f"s{i}", f"n{i}")]
        both = df.withColumn("tier", F.explode(F.array(F.lit(S.ALL_TIER), F.col("tier"))))
        both = both.groupBy(*cells, "tier", *keys).agg(*[F.sum(c).alias(c) for c in names])
        each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"s{i}").alias("s"), F.col(f"n{i}").alias("n"))
                         for i, t in ths])
        return both.select(*cells, "tier", *keys, F.explode(each).alias("c")).select(*cells, "tier", *keys, "c.*").filter("n > 0")

    at = [*cells, "threshold", "tier"]
    point = long(m.groupBy(*cells, "tier").agg(*[F.sum(v).alias(n) for n, v in terms.items()]), []).select(
        *at, F.col("n").alias("n_bets"), (F.col("s") / F.col("n")).alias("point_estimate"))
    reps = replicate_sums(m, unit, terms, n_boot, seed, [*cells, "tier"], repeated)
    rates = long(reps, ["b"]).withColumn("rate", F.col("s") / F.col("n"))
    return point.join(_interval(rates, at, "rate", level), at, "left")


def ev_grid_ci(entries: DataFrame, preds: DataFrame, thresholds: Sequence[float] = tuple(S.EV_THRESHOLDS),
               n_boot: int = 10_000, level: float = 0.95, seed: int = 42, prob: str = "win_prob") -> DataFrame:
    """Intervals for every cell of the threshold x tier grid over all entries."""
    p = preds.select(RACE, ENTRY, F.col(prob).alias("win_prob"))
    m = merged(entries.select(RACE, ENTRY, "is_win", "odds", "popularity"), p).withColumn("x", F.col("is_win") * F.col("odds"))
    return _grid_ci(grid_ci(m, [RACE, ENTRY], thresholds, (), n_boot, level, seed), thresholds, level)


def pooled_grid(bets: DataFrame, names: Sequence[str], thresholds: Sequence[float], n_boot: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """The grid of each kind of bet in ``names`` (column ``bet``), over gated bets of one period or of several pooled ones, in one pass
    over the replicates."""
    rows = bets.select(RACE, "bet", "ev", F.col("tier0").alias("tier"), (F.col("pay") / 100).alias("x"))
    ci = grid_ci(rows, [RACE], thresholds, ["bet"], n_boot, level, seed, repeated=True)
    full = fill_grid(ci, ["bet", "threshold", "tier"], ["n_bets"], bet=list(names), threshold=[float(t) for t in thresholds], **GRID_AXES)
    return _flags(full, level)


def pooled_ci(records: DataFrame, thresholds: Sequence[float] = tuple(S.EV_THRESHOLDS), n_boot: int = 10_000,
              level: float = 0.95, seed: int = 42) -> DataFrame:
    """Intervals over bet records, of one period or of several pooled ones."""
    ci = bootstrap_ci(records.filter(F.col("threshold").isin([float(t) for t in thresholds])), [RACE],
                      ["threshold", "tier"], n_boot=n_boot, level=level, seed=seed, repeated=True)
    return _grid_ci(ci, thresholds, level)


def combo_ci(entries: DataFrame, preds: DataFrame, payoffs: DataFrame, bet: str,
             thresholds: Sequence[float] = tuple(S.EV_THRESHOLDS), n_boot: int = 10_000, level: float = 0.95,
             seed: int = 42) -> DataFrame:
    """Quinella, wide or trio intervals: gate on the best runner, buy the best two or three.

    Those of ``pooled_ci`` on the bet records, but a race is one row with its thresholds as conditional sums, not a row for each
    threshold and tier that it counts for.
    """
    bets = gated_bets(entries, preds, payoffs, bet)
    rows = bets.select(RACE, "ev", F.col("tier0").alias("tier"), (F.col("pay") / 100).alias("x"))
    return _grid_ci(grid_ci(rows, [RACE], thresholds, (), n_boot, level, seed), thresholds, level)


def pair_stats(entries: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Sufficient statistics of every race for both models, from one aggregation over the entries."""
    m = entries.select(RACE, ENTRY, "is_win", "is_placed", "odds")
    for tail, p in (("_a", a), ("_b", b)):
        p = p.select(RACE, ENTRY, F.col("win_prob").alias(f"w{tail}"), F.col("place_prob").alias(f"p{tail}"))
        m = m.join(p, [RACE, ENTRY])
    return flat_stats(m.groupBy(RACE).agg(*stat_exprs("w_a", "p_a", "_a"), *stat_exprs("w_b", "p_b", "_b")), ["_a", "_b"])


PAIRED = ["win_logloss", "place_logloss", "win_accuracy", "recovery_rate"]


PARTS = ["nll_win", "nll_place", "n_win", "n_place", "hit", "ret", "races"]


def _paired_metrics(side: str) -> list[Column]:
    s = lambda c: F.col(f"{c}_{side}") if c in ("nll_win", "nll_place", "hit", "ret") else F.nullif(F.col(f"{c}_{side}"), F.lit(0))
    return [(s("nll_win") / s("n_win")).alias(f"win_logloss_{side}"), (s("nll_place") / s("n_place")).alias(f"place_logloss_{side}"),
            (s("hit") / s("races")).alias(f"win_accuracy_{side}"), (s("ret") / s("races")).alias(f"recovery_rate_{side}")]


def paired_bootstrap(entries: DataFrame, a: DataFrame, b: DataFrame, n_boot: int = 10_000, level: float = 0.95,
                     seed: int = 42) -> DataFrame:
    """Difference b - a of four metrics with intervals, both models judged on the same resampled races."""
    stats = pair_stats(entries, a, b)
    stats = stats.withColumns({f"races_{x}": F.col(f"hit_{x}").isNotNull().cast("int") for x in "ab"})
    parts = {f"{c}_{x}": F.col(f"{c}_{x}") for x in "ab" for c in PARTS}

    def diffs(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_a").alias("a"), F.col(f"{m}_b").alias("b_"),
                                  (F.col(f"{m}_b") - F.col(f"{m}_a")).alias("d")) for m in PAIRED])
        both = df.select(*keys, *_paired_metrics("a"), *_paired_metrics("b"))
        return both.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")

    point = diffs(stats.agg(*[F.sum(v).alias(n) for n, v in parts.items()]), [])
    reps = replicate_sums(stats, [RACE], parts, n_boot, seed)
    ci = _interval(diffs(reps, ["b"]), ["metric"], "d", level)
    out = point.join(F.broadcast(ci), "metric")  # four rows
    return out.select("metric", "a", F.col("b_").alias("b"), F.col("d").alias("diff_b_minus_a"), "ci_lower", "ci_upper",
                      (~((F.col("ci_lower") <= 0) & (F.col("ci_upper") >= 0))).alias("significant"))
