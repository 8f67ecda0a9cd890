"""Removal of repeated byte strings: rank rounds over synchronised positions.

A byte goes if some string of ``length`` bytes that covers it also starts elsewhere. Prefix doubling ranks the strings at
all positions, in rounds of twice the width; one row for each byte is too much for a large corpus, so the rounds here
run on *anchors* and on ranges of positions around them:

* Round 0 ranks the ``GRAM`` bytes at each anchor. Anchors are the minima of a hash of GRAM bytes, itself built by
  doubling, over windows of ``length - GRAM + 1`` positions. The choice depends on the string alone: both occurrences
  of a repeated string have the same anchor in the same place. Positions whose anchor is unique are done.
* Round 1 ranks the whole span around an anchor, that is every byte of all strings that the anchor stands for. If
  it is repeated, so are all of these strings. This settles the inside of copies and shared passages.
* What is left are the edges. Their spans meet in groups of equal rank. A group of up to ``GROUP`` spans is settled
  in memory by the hashes of its strings. Larger groups are ranked again: a range of strings is halved, its *core* (the
  bytes that all its strings share, wider each time) is the new rank, unique cores are dropped and repeated spans
  settled, down to single strings, which are only counted.

Equal rank means equal 64-bit fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.llm.common import attach, map_texts, text_slices, within
from hindcast.llm.jaccard import mixed
from hindcast.session import stored

GRAM = 32
#: Spans of equal rank that are settled in memory.
GROUP = 20_000
#: Bytes that a worker ranks at a time.
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
LETTERS = mixed(np.arange(1, 257, dtype=np.uint64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from each position, by doubling."""
    h, width = LETTERS[data], 1
    while width < GRAM:
        h = h[:-width] * np.uint64(pow(BASE, width, 2**64)) + h[width:] if len(h) > width else h[:0]
        width *= 2
    return mixed(h)


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors and the hashes of their GRAM bytes. Ties in a window go to its first position."""
    window = length - GRAM + 1
    at, found = 0, []
    while at + length <= len(data):
        block = data[at:at + BLOCK + length]
        h = gram_hashes(block)
        low = (h & ~np.uint64(0x3FFFFF)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= window:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if window > width:
            low = np.minimum(low[:width - window], low[window - width:])
        pos = np.flatnonzero(np.diff(low, prepend=~low[:1]))
        pos = np.unique((low[pos] & np.uint64(0x3FFFFF)).astype(np.int64))
        found.append((pos + at, h[pos]))
        at += BLOCK
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pos, first = np.unique(np.concatenate([p for p, _ in found]), return_index=True)
    return pos, np.concatenate([h for _, h in found])[first]


def _spans(size: int, pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance from an anchor back to the start of a string that it can stand for."""
    return np.maximum(0, pos + length - size), np.minimum(length - GRAM, pos)


ANCHORS = T.StructType([T.StructField("size", T.LongType()), T.StructField("pos", T.ArrayType(T.IntegerType())),
                        T.StructField("gram", T.ArrayType(T.LongType())), T.StructField("span", T.ArrayType(T.LongType()))])


def _anchor_table(docs: DataFrame, length: int) -> DataFrame:
    def make():
        from xxhash import xxh3_64_intdigest as digest

        def work(_, texts):
            cols: list[list] = [[] for _ in ANCHORS.fields]
            for text in texts:
                raw = text.encode()
                pos, gram = anchors(np.frombuffer(raw, np.uint8), length)
                lo, hi = _spans(len(raw), pos, length)
                span = np.fromiter((digest(raw[p - h:p - x + length], seed=x * 1000 + h) for p, x, h in
                                    zip(pos.tolist(), lo.tolist(), hi.tolist(), strict=True)), np.uint64, len(pos))
                for c, v in zip(cols, (len(raw), pos.astype(np.int32), gram.view(np.int64), span.view(np.int64)), strict=True):
                    c.append(v)
            return cols

        return work

    return stored(map_texts(docs, "text", ["id", "th"], ANCHORS, make))


def _several(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("m")).filter("m > 1").select(col)


CONTEXT = T.StructType([T.StructField("rank", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("lo", T.IntegerType()),
                        T.StructField("hi", T.IntegerType()), T.StructField("node", T.ArrayType(T.IntegerType())),
                        T.StructField("bytes", T.BinaryType())])


def _contexts(edges: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The spans of ``edges`` with their bytes: one row for each, keyed by ``id`` and ``th``."""
    per_doc = edges.groupBy("id", "th").agg(F.collect_list(F.struct("pos", "lo", "hi", "gram")).alias("a"))
    own = within(docs, edges.select("th").distinct(), "th").join(
        per_doc.withColumnsRenamed({"id": "own_id", "th": "own_th"}), F.col("th").eqNullSafe(F.col("own_th")) & F.col("id").eqNullSafe(F.col("own_id")))
    frame = own.select("id", "th", "text", "a").dropDuplicates(["id", "th"])
    keys = [f for f in docs.schema.fields if f.name in ("id", "th")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows, out = [], []
                for k, (text, a) in enumerate(zip(part.column("text").to_pylist(), part.column("a").to_pylist(), strict=True)):
                    raw = text.encode()
                    for x in a:
                        rows.append(k)
                        out.append({"rank": x["gram"], "pos": x["pos"], "lo": x["lo"], "hi": x["hi"], "node": [0, length - GRAM],
                                    "bytes": raw[x["pos"] - x["hi"]:x["pos"] - x["lo"] + length]})
                taken = part.select(["id", "th"]).take(pa.array(rows, pa.int64()))
                made = pa.RecordBatch.from_pylist(out, schema=_arrow(CONTEXT))
                yield pa.RecordBatch.from_arrays([*taken.columns, *made.columns], names=["id", "th", *made.schema.names])

    return stored(frame.mapInArrow(run, T.StructType(keys + CONTEXT.fields)))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _halves(spans: DataFrame, length: int) -> DataFrame:
    """Each span of a group that is too large as the spans of the two halves of its range, with ``rank`` (the core) and
    ``span`` (all its bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest
        signed = lambda x: x - 2**64 if x >= 2**63 else x
        for batch in batches:
            rows, out = [], []
            for k, x in enumerate(batch.select(["pos", "lo", "hi", "node", "bytes"]).to_pylist()):
                low, high = x["node"]
                mid = (low + high) // 2
                for a, b in ((low, mid), (mid + 1, high)):
                    lo, hi = max(a, x["lo"]), min(b, x["hi"])
                    if lo > hi:
                        continue
                    raw = x["bytes"][x["hi"] - hi:x["hi"] - lo + length]
                    core = raw[hi - a:hi - b + length]
                    rows.append(k)
                    out.append({"rank": signed(digest(core, seed=a * 1000 + b)), "pos": x["pos"], "lo": lo, "hi": hi, "node": [a, b],
                                "bytes": raw, "span": signed(digest(raw, seed=(lo * 1000 + hi) * 1000 + a))})
            taken = batch.select(["id", "th"]).take(pa.array(rows, pa.int64()))
            made = pa.RecordBatch.from_pylist(out, schema=_arrow(halved))
            yield pa.RecordBatch.from_arrays([*taken.columns, *made.columns], names=["id", "th", *made.schema.names])

    halved = T.StructType(CONTEXT.fields + [T.StructField("span", T.LongType())])
    keys = [f for f in spans.schema.fields if f.name in ("id", "th")]
    return spans.select("id", "th", *CONTEXT.names).mapInArrow(run, T.StructType(keys + halved.fields))


RANGES = [T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]


def repeated_in_group(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, sizes: np.ndarray, data: np.ndarray,
                      length: int) -> np.ndarray:
    """Flags (span, distance back from the anchor): whether another span of the group holds the same string there."""
    n, reach = len(group), length - GRAM
    cols = reach - hi
    row = np.repeat(np.arange(n), sizes)
    col = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(cols, sizes)
    sums = np.zeros((n, reach + length + 1), np.uint64)
    sums[row, col + 1] = LETTERS[data]
    width = reach + length
    powers = np.array([pow(BASE, i, 2**64) for i in range(width)], np.uint64)
    sums[:, 1:] *= powers
    np.cumsum(sums, axis=1, out=sums)
    out = np.zeros((n, reach + 1), bool)
    salt = mixed(group.view(np.uint64))
    for o in range(reach + 1):
        own = np.flatnonzero((lo <= o) & (o <= hi))
        if len(own) < 2:
            continue
        at = reach - o
        h = mixed((sums[own, at + length] - sums[own, at]) * np.uint64(pow(INVERSE, at, 2**64)) + salt[own])
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        out[own[order[1:][same]], o] = True
        out[own[order[:-1][same]], o] = True
    return out


def _settled(spans: DataFrame, length: int) -> DataFrame:
    """``id``, ``th``, ``first`` and ``last`` start of the repeated strings of groups that fit in memory."""
    keys = [f for f in spans.schema.fields if f.name in ("id", "th")]

    def settle(rows: pa.Table) -> pa.RecordBatch:
        group, lo, hi, pos = (rows.column(c).to_numpy().astype(np.int64) for c in ("rank", "lo", "hi", "pos"))
        taken, first, last = [], [], []
        raw = rows.column("bytes").combine_chunks()
        start = 0
        while start < len(group):  # whole groups, some thousand spans at a time
            stop = min(len(group), start + 2000)
            stop = int(np.searchsorted(group, group[stop - 1], side="right"))
            part = raw.slice(start, stop - start)
            values = np.frombuffer(b"".join(part.to_pylist()), np.uint8)
            sizes = hi[start:stop] - lo[start:stop] + length
            flags = repeated_in_group(group[start:stop], lo[start:stop], hi[start:stop], sizes, values, length)
            edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            r, b = np.nonzero(edge == 1)
            _, e = np.nonzero(edge == -1)
            taken.append(r + start)
            first.append(pos[r + start] - (e - 1))
            last.append(pos[r + start] - b)
            start = stop
        k = np.concatenate([*taken, np.zeros(0, np.int64)])
        own = rows.select(["id", "th"]).take(pa.array(k)).combine_chunks()
        cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in own.columns]
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate([*first, np.zeros(0, np.int64)])),
                                           pa.array(np.concatenate([*last, np.zeros(0, np.int64)]))], names=["id", "th", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            rank = b.column("rank").to_numpy()
            cut = int(np.searchsorted(rank, rank[-1], side="left"))
            if cut:
                yield settle(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield settle(pa.Table.from_batches(held))

    sorted_spans = spans.select("id", "th", *CONTEXT.names).drop("node").repartition("rank").sortWithinPartitions("rank")
    return sorted_spans.mapInArrow(run, T.StructType(keys + RANGES))


def repeated_ranges(docs: DataFrame, length: int = 200, group: int = GROUP) -> DataFrame:
    """``id``, ``th``, ``first`` and ``last``: ranges of starts of repeated strings in ``docs`` (``id``, ``th``, ``text``).

    A text may have several ranges, which may meet or overlap.
    """
    table = _anchor_table(docs, length)
    lo = F.greatest(F.lit(0), F.col("a.pos") + length - F.col("size").cast("int"))
    hi = F.least(F.lit(length - GRAM), F.col("a.pos"))
    each = table.select("id", "th", "size", F.explode(F.arrays_zip("pos", "gram", "span")).alias("a")).select(
        "id", "th", F.col("a.pos").alias("pos"), lo.alias("lo"), hi.alias("hi"), F.col("a.gram").alias("gram"), F.col("a.span").alias("span"))
    shared = stored(within(each, _several(each, "gram"), "gram"))
    whole = stored(_several(shared, "span"))
    settled = within(shared, whole, "span").select("id", "th", (F.col("pos") - F.col("hi")).cast("long").alias("first"),
                                                   (F.col("pos") - F.col("lo")).cast("long").alias("last"))
    # of equal spans one goes on, since others may hold a part of its strings
    lead = shared.groupBy("gram", "span").agg(F.min(F.struct("id", "th", "pos", "lo", "hi")).alias("s"))
    lead = stored(lead.select("gram", "s.*"))
    spans = _contexts(within(lead, _several(lead, "gram"), "gram"), docs, length)
    found = [settled]
    while True:
        counts = spans.groupBy("rank").agg(F.count("*").alias("m"))
        over = counts.filter(F.col("m") > group).select("rank")
        if over.isEmpty():
            found.append(_settled(within(spans, counts.filter("m > 1").select("rank"), "rank"), length))
            break
        found.append(_settled(within(spans, counts.filter(F.col("m").between(2, group)).select("rank"), "rank"), length))
        halves = stored(_halves(within(spans, over, "rank"), length))
        again = _several(halves, "span")
        range_ = [(F.col("pos") - F.col("hi")).cast("long").alias("first"), (F.col("pos") - F.col("lo")).cast("long").alias("last")]
        found.append(within(halves, again, "span").select("id", "th", *range_))
        spans = stored(halves.filter("node[0] < node[1]").dropDuplicates(["rank", "span"]).select("id", "th", *CONTEXT.names))
    return reduce(DataFrame.unionByName, found)


def _kept(raw: bytes, ranges: list[dict], length: int) -> tuple[bytes, int, int]:
    edge = np.zeros(len(raw) + 1, np.int64)
    for r in ranges:
        edge[r["first"]] += 1
        edge[r["last"] + length] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    n_spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), n_spans


RESULT = T.StructType([*[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.BinaryType())])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text_col: str = "text", length: int = 200, group: int = GROUP) -> DataFrame:
    """One row for each row of ``docs``: ``key``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and
    ``kept``, the remaining bytes of the text's UTF-8.

    Removed is each byte in a string of ``length`` bytes that also starts anywhere else in the corpus, the same
    text included; strings never cross texts and are judged on the input. Null texts are empty; texts under ``length`` bytes
    lose nothing. Repeated rows are copies of each other and, if long enough, lose everything. Null keys are keys like
    any other. Other columns are not read; an empty table gives none.
    """
    if length < 2 * GRAM:
        raise ValueError(f"strings must have at least {2 * GRAM} bytes")
    frame = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    frame = frame.withColumn("th", F.xxhash64("text"))
    ranges = repeated_ranges(frame, length, group)
    per_doc = stored(ranges.groupBy("id", "th").agg(F.collect_list(F.struct("first", "last")).alias("ranges")))
    placed = attach(frame, per_doc, ["id", "th"])
    keys = [f for f in frame.schema.fields if f.name == "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                raws = [t.encode() for t in part.column("text").to_pylist()]
                done = [_kept(raw, r or [], length) for raw, r in zip(raws, part.column("ranges").to_pylist(), strict=True)]
                cols = [pa.array([len(r) for r in raws], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
                        pa.array([d[2] for d in done], pa.int64()), pa.array([d[0] for d in done], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("id"), *cols], names=["id", *RESULT.names])

    return placed.mapInArrow(run, T.StructType(keys + RESULT.fields)).withColumnRenamed("id", key)
