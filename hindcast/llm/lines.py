"""Line deduplication by a segment-partition edit join.

Two lines within ``edits`` edits share one of edits + 1 segments of the shorter one, at a place that the edits left and right of
it allow (Li et al., "Pass-Join", 2011). So each line has the hashes of its own segments, and of its substrings where
a segment of a line of its length or up to ``edits`` less can stand. Hashes that only one line has are dropped by a first pass,
which counts them (the hashes of a batch of lines are made at once, in numpy); the lines of the others meet by hash, those of a frequent segment by further segments of what is left of them, and pairs are verified by a banded bit-parallel automaton:
for each number of edits one bit mask of the diagonals that are reached.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.llm.common import attach, right_small, text_slices, within
from hindcast.session import stored

#: Lines with fewer characters are near no other one: a few edits make other words of them.
MIN_CHARS = 20
#: Edits are counted, whatever the length: one replaced character of a line, or two, but not a word of three letters or more.
EDITS = 2
#: Letters whose counts are compared before a pair is verified; an edit changes these by two at most.
COUNTED = "etaoinsrhldcu"


def _lines(docs: DataFrame, min_chars: int, shorter: bool = False) -> DataFrame:
    """``id``, ``at``, ``line``, its length ``n`` and two hashes of each line that takes part; with ``shorter`` all but blank ones."""
    each = docs.select("id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    each = each.withColumn("n", F.length("line")).filter((F.col("n") >= min_chars) | (F.lit(shorter) & F.col("line").rlike(r"\S")))
    return each.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _places(edits: int) -> list[tuple[int, int, int]]:
    """Number of the segment, how many characters less a text has whose own one it can be, and how far it is moved from there."""
    k = edits + 1
    return [(i, less, shift) for less in range(k) for i in range(1, k + 1)
            for shift in range(max(1 - i, less - (k - i)), min(i - 1, less + (k - i)) + 1)]


def _cuts(edits: int, n: Column) -> list[tuple[int, int, int, Column, Column]]:
    """Where segments stand in a text of ``n`` characters: number of the segment, how many characters ``less`` a text has whose own one it can
    be, how far it is moved from there, the characters before it and its own."""
    k, out = edits + 1, []
    for i, less, shift in _places(edits):
        start, stop = F.floor((n - less) * (i - 1) / k).cast("int"), F.floor((n - less) * i / k).cast("int")
        out.append((i, less, shift, start + shift, stop - start))
    return out


def _keys(edits: int, min_chars: int, n: Column, piece) -> Column:
    """Hashes of segments: structs of the hash, whether it is one of the text's own segments, and which of ``_cuts`` it is.
    ``piece`` gives the characters of segment i from a place on."""
    out = []
    for which, (i, less, shift, before, size) in enumerate(_cuts(edits, n)):
        key = F.xxhash64(F.lit(i), n - less, piece(i, before, size))
        entry = F.struct(key.alias("key"), F.lit(less == 0 and shift == 0).alias("own"), F.lit(which).alias("which"))
        out.append(F.when((n - less >= min_chars) & (before >= 0) & (before + size <= n), entry))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _powers(base: int, n: int) -> np.ndarray:
    """``base`` to the power of 0 to ``n``, modulo 2 ** 64."""
    factors = np.full(n + 1, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


#: Base of the segments' hashes and its inverse, both modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _line_keys(lines: pa.StringArray, edits: int, min_chars: int, powers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lines without nulls the number of keys of each, and of all keys the hash, whether it is one of the line's own segments, and which of
    ``_cuts`` it is. Sums of the bytes times powers of a number up to each place give the hash of any segment by one subtraction."""
    ends = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset:lines.offset + len(lines) + 1].astype(np.int64)
    data = lines.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    if len(powers[0]) <= len(raw):
        powers[:] = [_powers(BASE, 2 * len(raw)), _powers(INVERSE, 2 * len(raw))]
    power, inverse = powers
    sums = np.append(np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)], dtype=np.uint64))
    chars = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    at = np.searchsorted(chars, ends - ends[0])
    first, n, k = at[:-1], np.diff(at), edits + 1
    keys, held, own = [], [], []
    for i, less, shift in _places(edits):
        before, size = (n - less) * (i - 1) // k + shift, (n - less) * i // k - (n - less) * (i - 1) // k
        ok = (n - less >= min_chars) & (before >= 0) & (before + size <= n)
        start = chars[np.where(ok, first + before, 0)]
        stop = chars[np.where(ok, first + before + size, 0)]
        keys.append(_mixed((sums[stop] - sums[start]) * inverse[start] + _mixed(((n - less) * (edits + 2) + i).astype(np.uint64))))
        held.append(ok)
        own.append(less == 0 and shift == 0)
    ok = np.stack(held, 1)
    _, which = np.nonzero(ok)
    return ok.sum(1), np.stack(keys, 1)[ok].view(np.int64), np.array(own)[which], which.astype(np.int32)


KEY = T.StructType([T.StructField("key", T.LongType()), T.StructField("own", T.BooleanType()), T.StructField("which", T.IntegerType())])


def _hashed(lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """A row ``key``, ``own``, ``h1`` for each key of each line, without the lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [np.zeros(0, np.uint64)] * 2
        for batch in batches:
            for part in text_slices(batch, "line"):
                counts, key, own, _ = _line_keys(part.column("line"), edits, min_chars, powers)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), pa.array(np.repeat(part.column("h1").to_numpy(), counts))], names=["key", "own", "h1"])
    return lines.select("line", "h1").mapInArrow(run, "key long, own boolean, h1 long")


def _with_keys(lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """Lines with one row for each key."""
    frame = lines.select("id", "at", "line", "n", "h1", "h2")
    kind = pa.struct([("key", pa.int64()), ("own", pa.bool_()), ("which", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [np.zeros(0, np.uint64)] * 2
        for batch in batches:
            for part in text_slices(batch, "line"):
                counts, key, own, which = _line_keys(part.column("line"), edits, min_chars, powers)
                each = pa.StructArray.from_arrays([pa.array(key), pa.array(own), pa.array(which)], fields=list(kind))
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), each)
                yield pa.RecordBatch.from_arrays([*part.columns, keys], names=[*part.schema.names, "keys"])
    keyed = frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField("keys", T.ArrayType(KEY))]))
    return keyed.select(*frame.columns, F.explode("keys").alias("k")).select(*frame.columns, "k.*")


#: Lines of one segment from which on it is not enough for a pair to be looked at.
HOT = 128
#: Times that the rest of a line is divided again.
LEVELS = 3


def _split_hot(members: DataFrame, edits: int, hot: int = HOT) -> DataFrame:
    """``members`` with longer keys where more than ``hot`` lines have a key.

    A pair within the edits has a segment in common such that what stands left and right of it is within the edits too. So the rests
    of the lines of a frequent segment are divided in turn, and only lines meet that have a segment of the rest in common as well.
    """
    done, rows = [], members
    for _ in range(LEVELS):
        often = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > hot).select("key"))
        if often.isEmpty():
            break
        done.append(within(rows, often, "key", anti=True))
        cuts = _cuts(edits, F.length("rest"))
        less = lambda which: F.get(F.array(*[F.lit(c[1]) for c in cuts]), which)
        cut = within(rows, often, "key").withColumns({"before": F.get(F.array(*[c[3] for c in cuts]), "which"),
                                                      "size": F.get(F.array(*[c[4] for c in cuts]), "which"), "less": less("which")})
        rest = F.concat(F.substring("rest", F.lit(1), F.col("before")), F.substring("rest", F.col("before") + F.col("size") + 1, F.length("rest")))
        keys = _keys(edits, 0, F.length("rest"), lambda i, before, size: F.substring("rest", before + 1, size))
        deeper = cut.withColumn("rest", rest).withColumn("k", F.explode(keys)).filter(less("k.which") == F.col("less"))
        rows = stored(deeper.select(F.xxhash64("key", "k.key").alias("key"), (F.col("own") & F.col("k.own")).alias("own"), "line", "n", "h1", "h2", "first",
                                    "rest", "k.which"))
    return reduce(DataFrame.unionByName, [*done, rows])


#: Characters after which a pair is looked at again before the rest is compared.
HEAD = 32


def _run(a: Column, b: Column, edits: int, finish) -> Column:
    """Runs the automaton over ``b``; ``finish`` makes the result of its last mask.

    Bit d of mask e stands for the diagonal d - edits: so many characters more are read of ``a`` than of ``b`` with e edits
    at most. Each character of ``b`` moves all diagonals of the band at once.
    """
    band = 2 * edits + 1
    full = (1 << band) - 1
    start = [((1 << (edits + e + 1)) - 1) & ~((1 << edits) - 1) for e in range(edits + 1)]
    init = F.struct(F.split(a, "", -1).alias("x"), F.lit(0).alias("j"), *[F.lit(m).alias(f"r{e}") for e, m in enumerate(start)])

    def step(acc: Column, c: Column) -> Column:
        same = reduce(Column.bitwiseOR, [F.when(F.get(acc["x"], acc["j"] + (d - edits)) == c, 1 << d).otherwise(0) for d in range(band)])
        masks = []
        for e in range(edits + 1):
            r = acc[f"r{e}"].bitwiseAND(same)
            if e:
                less = acc[f"r{e - 1}"]
                r = r.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(masks[-1], 1)).bitwiseAND(F.lit(full))
            masks.append(r)
        return F.struct(acc["x"].alias("x"), (acc["j"] + 1).alias("j"), *[m.alias(f"r{e}") for e, m in enumerate(masks)])

    return F.aggregate(F.split(b, "", -1), init, step, lambda acc: finish(acc[f"r{edits}"]))


def alive(a: Column, b: Column, edits: int) -> Column:
    """Whether all of ``b`` can be the start of a string within the edits of ``a`` or of a start of it."""
    return (F.length(b) == 0) | _run(a, b, edits, lambda r: r != 0)


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are at most ``edits`` edits (of one character) apart, by a banded bit-parallel automaton."""
    lead = F.length(a) - F.length(b) + edits
    end = _run(a, b, edits, lambda r: F.call_function("shiftright", r, lead).bitwiseAND(F.lit(1)) == 1)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.greatest(F.length(a), F.length(b)) <= edits).otherwise(
        (F.abs(F.length(a) - F.length(b)) <= edits) & end)


def common_start(a: Column, b: Column, most: Column) -> Column:
    """Length of the longest common start of two strings, ``most`` at most, by halving steps."""
    steps = F.transform(F.sequence(F.floor(F.log2(F.greatest(most, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(steps, F.lit(0), lambda at, x: F.when(
        (at + x <= most) & (F.substring(a, at + 1, x) == F.substring(b, at + 1, x)), at + x).otherwise(at))


def near_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, hot: int = HOT) -> DataFrame:
    """Pairs of different lines within ``edits`` edits: hashes and first places of the ``later`` and the ``earlier`` one.

    ``docs`` has ``id`` and ``text``. The first pass has one row for each hash and task; a hash of many lines is one row there. Lines
    of a segment that more than ``hot`` have meet only by further segments.
    """
    lines = _lines(docs, min_chars)
    held = _hashed(lines, edits, min_chars).groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.max("own").alias("own"))
    shared = stored(held.filter("low < high AND own").select("key"))
    counts = [F.length("line") - F.length(F.replace("line", F.lit(c), F.lit(""))) for c in COUNTED]
    members = within(_with_keys(lines, edits, min_chars), shared, "key").groupBy("key", "own", "which", "line", "n", "h1", "h2").agg(F.min(F.struct("id", "at")).alias("first"))
    members = _split_hot(stored(members.withColumn("rest", F.col("line"))), edits, hot).drop("rest", "which")
    members = stored(members.withColumn("c", F.array(*counts)))
    a = members.filter("own").drop("own").withColumnsRenamed({c: f"{c}_a" for c in ("line", "n", "h1", "h2", "first", "c")})
    apart = reduce(Column.__add__, [F.abs(F.get("c", F.lit(i)) - F.get("c_a", F.lit(i))) for i in range(len(COUNTED))])
    alike = (F.col("n_a") <= F.col("n")) & (F.col("n") <= F.col("n_a") + edits) & (
        (F.col("h1") != F.col("h1_a")) | (F.col("h2") != F.col("h2_a"))) & (apart <= 2 * edits)
    once = (F.col("n_a") < F.col("n")) | (F.col("h1") > F.col("h1_a")) | ((F.col("h1") == F.col("h1_a")) & (F.col("h2") > F.col("h2_a")))
    pairs = a.join(members, "key").filter(alike & once).dropDuplicates(["h1", "h2", "h1_a", "h2_a"])
    near = pairs.withColumn("p", common_start(F.col("line_a"), F.col("line"), F.col("n_a")))
    near = near.withColumn("q", common_start(F.reverse("line_a"), F.reverse("line"), F.col("n_a") - F.col("p")))
    inner = lambda line, n: F.substring(line, F.col("p") + 1, F.col(n) - F.col("p") - F.col("q"))
    near = near.withColumns({"inner_a": inner("line_a", "n_a"), "inner": inner("line", "n")})
    head = F.substring("inner", F.lit(1), F.lit(HEAD))
    near = near.filter(alive(F.substring("inner_a", F.lit(1), F.lit(HEAD + edits)), head, edits)).filter(
        within_edits(F.col("inner_a"), F.col("inner"), edits))
    side = lambda s: F.struct(F.col(f"first{s}").alias("first"), F.col(f"h1{s}").alias("h1"), F.col(f"h2{s}").alias("h2"))
    return near.select(F.greatest(side(""), side("_a")).alias("later"), F.least(side(""), side("_a")).alias("earlier")).distinct()


def dedup_lines(docs: DataFrame, key: str = "doc_id", text_col: str = "text", edits: int = EDITS,
                min_chars: int = MIN_CHARS, shorter: bool = False) -> DataFrame:
    """``docs`` without the lines that an earlier line repeats, with ``n_lines``, ``n_same`` and ``n_near`` of each text.

    Lines are parted by line feeds and ordered by (key, place), null keys first. A line of at least ``min_chars``
    characters goes if it equals an earlier one (``n_same``), or if the first line equal to it is within ``edits`` edits
    of another one that comes first (``n_near``), even if that one goes too; the first line of such a chain stays. Shorter lines
    stay, but with ``shorter`` those go that equal an earlier one (``n_same``), and only blank ones stay. Null texts stay null with no lines; an emptied text is the empty string. Rows that share a key are taken
    as one document given twice: the same line at the same place in both is not a repetition. Columns of ``docs``
    named like an added one are replaced. An empty table gives none.
    """
    frame = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    lines = _lines(frame, min_chars, shorter).select("id", "at", "h1", "h2")
    same = lines.groupBy("h1", "h2").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("m")).filter("m > 1")
    near = near_lines(frame, edits, min_chars).select("later.h1", "later.h2").distinct().withColumn("near", F.lit(True))
    gone = stored(same.select("h1", "h2", "first").join(near, ["h1", "h2"], "full"))
    hits = right_small(lines.withColumn("h", F.struct("h1", "h2")).drop("h1", "h2"),
                       gone.select(F.struct("h1", "h2").alias("h"), "first", F.coalesce("near", F.lit(False)).alias("near")), "h")
    here = F.struct("id", "at").eqNullSafe(F.col("first"))
    removed = hits.filter(F.col("near") | ~here).groupBy(F.col("id").alias("__id")).agg(F.collect_set(F.struct("at", "near")).alias("__gone"))
    known = [c for c in docs.columns if c not in ("n_lines", "n_same", "n_near")]
    out = attach(docs.select(*[F.col(f"`{c}`") for c in known], F.col(f"`{key}`").alias("__id")), stored(removed), ["__id"])
    parts = F.split(F.col(f"`{text_col}`"), "\n", -1)
    at = F.transform("__gone", lambda g: g["at"])
    left = F.filter(parts, lambda line, i: ~F.array_contains(at, i))
    text = F.when(F.col("__gone").isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(left, "\n")).alias(text_col)
    number = lambda flag: F.coalesce(F.size(F.filter("__gone", lambda g: g["near"] == flag)), F.lit(0)).cast("long")
    return out.select(*[text if c == text_col else F.col(f"`{c}`") for c in known],
                      F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
                      F.when(F.col("__gone").isNull(), 0).otherwise(number(False)).cast("long").alias("n_same"),
                      F.when(F.col("__gone").isNull(), 0).otherwise(number(True)).cast("long").alias("n_near"))
