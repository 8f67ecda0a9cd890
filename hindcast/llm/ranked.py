"""Ranked lexical search over bit-sliced Bloom signatures.

A document sets the bits of its terms, and of each step of their numbers of occurrences, in its column of a bitmap; a row
of the bitmap is one bit of all documents of a block (documents with about as many bits stand together, and the rows
follow their number). The rows of a term, ANDed, hold every document with the term and a few others. So the steps
overestimate how often a term occurs, and the sum of the terms' weights over the slices, with each document's own length, is
an upper bound of its score. Three passes over the bitmaps and the texts behind them give the exact answer: the
documents with the highest bounds are scored, the k-th best of them is the threshold, and every document whose bound
reaches it is scored exactly.

The bitmaps know nothing of the queries. Queries are taken in blocks of bounded size; a block's terms are sent to the tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.llm.common import text_slices
from hindcast.session import stored

#: Bytes of query terms in a block.
QUERY_BYTES = 4 << 20
#: Bytes that may be sent to all tasks instead of being joined by a shuffle.
SENT_BYTES = 64 << 20
BITS_PER_KEY, ROWS_PER_KEY = 16, 8
#: Numbers of occurrences at which a term sets further bits; the last step has no upper end.
STEPS = (1, 2, 3, 5, 9, 17, 65)
#: Documents of a block at most, and bits (documents x rows) of a bitmap at most, unless it is one document's.
BLOCK_DOCS, BLOCK_BITS = 1024, 1 << 26

_KEEP = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP or b > 127 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Maximal stretches of ASCII letters and digits and of all characters beyond ASCII; A-Z in lower case."""
    return text.encode().translate(LOWERED).split()


def hash_of(term: bytes) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(term)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rows_of(hashes: np.ndarray, step: int | np.ndarray, n_rows: int) -> np.ndarray:
    """The ``ROWS_PER_KEY`` rows of a bitmap for terms at a step, one line for each term."""
    a = _mix(hashes + np.asarray(step, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    b = _mix(a + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    j = np.arange(ROWS_PER_KEY, dtype=np.uint64)
    return (_mix(a[:, None] + j * b[:, None]) % np.uint64(n_rows)).astype(np.int64)


@dataclass
class Column:
    """A document on its way into a block."""

    key: int
    size: int
    hashes: np.ndarray
    step: np.ndarray


def bitmap(docs: list[Column]) -> tuple[int, bytes]:
    """Number of rows, and the rows, each with a bit for every document, first document in the highest bit."""
    n_rows = max(64, max(len(d.hashes) for d in docs) * BITS_PER_KEY)
    bits = np.zeros((n_rows, -(-len(docs) // 8) * 8), dtype=bool)
    for c, d in enumerate(docs):
        if len(d.hashes):
            bits[rows_of(d.hashes, d.step, n_rows).ravel(), c] = True
    return n_rows, np.packbits(bits, axis=1).tobytes()


INDEX = T.StructType([
    T.StructField("keys", T.ArrayType(T.LongType(), False)), T.StructField("sizes", T.ArrayType(T.LongType(), False)),
    T.StructField("n_rows", T.LongType()), T.StructField("bits", T.BinaryType()),
    T.StructField("found", T.ArrayType(T.StructType([T.StructField("term", T.IntegerType()), T.StructField("n", T.LongType())]), False))])


def build_index(docs: DataFrame, id_col: str, text_col: str, terms: list[bytes]) -> DataFrame:
    """Bitmaps of all ``docs`` with a term, and from each task a row with the number of its documents that hold each of
    ``terms``. A document is known by the hash of its id and text. One pass without a shuffle."""
    frame = docs.select(_key(id_col, text_col).alias("key"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {t: i for i, t in enumerate(terms)}
        found = np.zeros(len(terms), dtype=np.int64)
        open_: dict[int, list[Column]] = {}
        hashes: dict[bytes, int] = {}

        def block(columns: list[Column]) -> pa.RecordBatch:
            n_rows, bits = bitmap(columns)
            return row([c.key for c in columns], [c.size for c in columns], n_rows, bits, [])

        for batch in batches:
            for part in text_slices(batch, "text"):
                for c, counted in zip(part.column("key").to_pylist(), _counted(part, wanted, found, hashes), strict=True):
                    size, own, times = counted
                    if not size:
                        continue
                    steps = [own[times >= s] for s in STEPS]
                    column = Column(c, size, np.concatenate(steps), np.repeat(np.arange(len(STEPS)), [len(s) for s in steps]))
                    kind = int(2 * math.log2(len(column.hashes)))
                    wait = open_.setdefault(kind, [])
                    wait.append(column)
                    if len(wait) >= BLOCK_DOCS or len(wait) * max(len(w.hashes) for w in wait) * BITS_PER_KEY >= BLOCK_BITS:
                        yield block(open_.pop(kind))
        for columns in open_.values():
            yield block(columns)
        yield row([], [], 0, b"", [{"term": i, "n": int(found[i])} for i in np.flatnonzero(found).tolist()])

    from pyspark.sql.pandas.types import to_arrow_type
    kinds = [to_arrow_type(f.dataType) for f in INDEX.fields]

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(values, kinds, strict=True)], names=INDEX.names)

    return frame.mapInArrow(run, INDEX)


def _counted(part: pa.RecordBatch, wanted: dict[bytes, int], found: np.ndarray, hashes: dict[bytes, int]):
    """Number of terms, hashes of the distinct ones and their numbers of occurrences, for each text; adds to ``found``."""
    docs = [terms_of(t) if t else [] for t in part.column("text").to_pylist()]
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    coded = pa.array(list(chain.from_iterable(docs)), pa.binary()).dictionary_encode()
    words = coded.dictionary.to_pylist()
    if len(hashes) > 1 << 18:  # a task's memory of hashes starts anew
        hashes.clear()
    for w in words:
        if w not in hashes:
            hashes[w] = hash_of(w)
    value = np.array([hashes[w] for w in words], dtype=np.uint64)
    query = np.array([wanted.get(w, -1) for w in words], dtype=np.int64)
    pair, times = np.unique(np.repeat(np.arange(len(docs)), sizes) * max(1, len(words)) + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    doc, word = pair // max(1, len(words)), pair % max(1, len(words))
    if len(word):
        np.add.at(found, query[word][query[word] >= 0], 1)
    bounds = np.searchsorted(doc, np.arange(len(docs) + 1))
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        yield int(sizes[k]), value[word[a:b]], times[a:b]


def _key(id_col: str, text_col: str):
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


@dataclass(frozen=True)
class Corpus:
    documents: int
    terms: int

    def length(self, n: np.ndarray) -> np.ndarray:
        """The m of documents with ``n`` terms."""
        return 50 + (50 * n * self.documents) // self.terms


def share(times, m):
    """The part of a term's weight that a document with ``times`` occurrences and length m gets, in millionths."""
    return (1_000_000_000 * times) // (1000 * times + 20 * m)


@dataclass
class Queries:
    """A block of queries: ids, and for each the places and weights of its terms in the block's list."""

    ids: list
    places: list[np.ndarray]
    terms: list[bytes]
    weights: np.ndarray

    def bounds(self, keys: np.ndarray, sizes: np.ndarray, n_rows: int, bits: np.ndarray, corpus: Corpus, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each query its upper bounds over the documents of a block."""
        slices = np.frombuffer(bits, dtype=np.uint8).reshape(n_rows, -1)
        level = np.zeros((len(self.terms), len(keys)), dtype=np.int8)
        live = np.arange(len(self.terms))
        held = None
        for k in range(len(STEPS)):
            rows = rows_of(hashes[live], k, n_rows)
            both = slices[rows[:, 0]]
            for j in range(1, ROWS_PER_KEY):
                both &= slices[rows[:, j]]
            held = both if held is None else held & both
            some = held.any(axis=1)
            live, held = live[some], held[some]
            if not len(live):
                break
            level[live] += np.unpackbits(held, axis=1, count=len(keys)).view(np.int8)
        m = corpus.length(sizes)
        upper = np.array([s - 1 for s in STEPS[1:]], dtype=np.int64)
        most = np.vstack([np.zeros(len(m), dtype=np.int64), share(upper[:, None], m[None, :]), np.full(len(m), 1_000_000, dtype=np.int64)])
        has = np.flatnonzero(level.any(axis=1))
        place = np.full(len(self.terms), -1, dtype=np.int64)
        place[has] = np.arange(len(has))
        part = most[level[has], np.arange(len(m))[None, :]] * self.weights[has][:, None]
        for q, own in enumerate(self.places):
            own = place[own]
            own = own[own >= 0]
            if len(own):
                yield q, part[own].sum(axis=0)


def _by_block(index: DataFrame, work, schema: str) -> DataFrame:
    """``work(keys, sizes, n_rows, bits)`` of every bitmap of the index; it yields record batches, and so does ``work.end()``."""
    def run(batches):
        do = work()
        for b in batches:
            for k in range(b.num_rows):
                yield from do.block(np.array(b.column(0)[k].as_py(), dtype=np.int64), np.array(b.column(1)[k].as_py(), dtype=np.int64),
                                    b.column(2)[k].as_py(), b.column(3)[k].as_buffer())
        yield from do.end()

    return index.filter("n_rows > 0").select("keys", "sizes", "n_rows", "bits").mapInArrow(run, schema)


class _Best:
    """The ``k`` highest bounds of each query in a task."""

    def __init__(self, queries: Queries, corpus: Corpus, k: int) -> None:
        self.queries, self.corpus, self.k = queries, corpus, k
        self.hashes = np.array([hash_of(t) for t in queries.terms], dtype=np.uint64)
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, keys, sizes, n_rows, bits):
        for q, bound in self.queries.bounds(keys, sizes, n_rows, bits, self.corpus, self.hashes):
            old = self.kept.get(q, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            own, value = np.concatenate([old[0], keys]), np.concatenate([old[1], bound])
            if len(value) > self.k:
                top = np.argpartition(-value, self.k - 1)[:self.k]
                own, value = own[top], value[top]
            self.kept[q] = own, value
        return ()

    def end(self):
        for q, (keys, bound) in self.kept.items():
            some = bound > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), q, np.int32)), pa.array(keys[some]), pa.array(bound[some])], names=["query", "key", "bound"])


class _Reaching:
    """The documents whose bound reaches their query's threshold."""

    def __init__(self, queries: Queries, corpus: Corpus, least: np.ndarray) -> None:
        self.queries, self.corpus, self.least = queries, corpus, least
        self.hashes = np.array([hash_of(t) for t in queries.terms], dtype=np.uint64)

    def block(self, keys, sizes, n_rows, bits):
        for q, bound in self.queries.bounds(keys, sizes, n_rows, bits, self.corpus, self.hashes):
            some = np.flatnonzero(bound >= self.least[q])
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), q, np.int32)), pa.array(keys[some])], names=["query", "key"])

    def end(self):
        return ()


def rescored(docs: DataFrame, id_col: str, text_col: str, pairs: DataFrame, queries: Queries, corpus: Corpus) -> DataFrame:
    """``query``, ``id`` and exact ``score`` (above 0) of the documents that ``pairs`` names; rows with equal ids and texts each count."""
    asked = stored(pairs.groupBy("key").agg(F.collect_set("query").alias("queries")))
    rows, entries = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("queries")), F.lit(0))).first()
    if 32 * rows + 8 * entries <= SENT_BYTES:
        asked = F.broadcast(asked)
    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), _key(id_col, text_col).alias("key")).join(asked, "key").select("id", "text", "queries")
    schema = T.StructType([T.StructField("query", T.IntegerType()), frame.schema["id"], T.StructField("score", T.LongType())])

    def run(batches):
        weight = dict(zip(queries.terms, queries.weights.tolist(), strict=True))
        own = [[queries.terms[p] for p in places.tolist()] for places in queries.places]
        for b in batches:
            for part in text_slices(b, "text"):
                query, row, value = [], [], []
                for k, (text, asks) in enumerate(zip(part.column("text").to_pylist(), part.column("queries").to_pylist(), strict=True)):
                    times = Counter(terms_of(text or ""))
                    m = 50 + (50 * times.total() * corpus.documents) // corpus.terms
                    part_of = {t: weight[t] * share(times[t], m) for t in times.keys() & weight.keys()}
                    for q in asks:
                        s = sum(part_of[t] for t in own[q] if t in part_of)
                        if s > 0:
                            query.append(q)
                            row.append(k)
                            value.append(s)
                if query:
                    yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), part.column("id").take(pa.array(row)), pa.array(value, pa.int64())],
                                                     names=["query", "id", "score"])

    return frame.mapInArrow(run, schema)


def _query_blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, set[bytes]]]]:
    """The queries with terms, in blocks of about ``QUERY_BYTES`` of text; a block comes to the driver."""
    rows = queries.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-total // QUERY_BYTES)
    for k in range(n):
        out: dict[object, set[bytes]] = {}
        for r in rows.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == k).toLocalIterator():
            if own := terms_of(r.text):
                out.setdefault(r.id, set()).update(own)
        if out:
            yield list(out.items())


def search(docs: DataFrame, queries: DataFrame, k: int = 50, doc_id: str = "doc_id", query_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of the ``k`` documents with the highest scores above 0 for each
    query, equal scores by ascending id (null ids last).

    Scores are integers: a query's distinct terms t add ``w_t * share(tf, m)`` with ``w_t = floor(1000 ln((2N + 2) / (2 df + 1)))``;
    N counts the documents with a term, and m relates a document's terms to the mean. Null and empty texts have no terms: such
    documents are found by nothing and such queries find nothing. Queries with the same id are one query. Repeated documents
    are ranked each. Empty tables give no rows. Extra columns take no part.
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField("rank", T.IntegerType()),
                           T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("score", T.LongType())])
    out, index = None, None
    for block in _query_blocks(queries, query_id, text_col):
        terms = sorted(set().union(*[own for _, own in block]))
        built = stored(build_index(docs, doc_id, text_col, terms)) if index is None else build_index(docs, doc_id, text_col, terms)
        index = built if index is None else index  # further blocks of queries only count their terms
        found = dict(built.filter("n_rows = 0").select(F.explode("found").alias("f")).groupBy("f.term").agg(F.sum("f.n")).collect())
        n, total = index.filter("n_rows > 0").agg(F.sum(F.size("keys")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
        if not n:
            break
        part = _search_block(spark, docs, doc_id, text_col, index, block, terms, found, Corpus(n, total), k)
        names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(block)], T.StructType([T.StructField("query", T.IntegerType()), schema[query_id]]))
        part = part.join(F.broadcast(names), "query").select(query_id, "rank", F.col("id").alias(doc_id), "score")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _search_block(spark: SparkSession, docs: DataFrame, doc_id: str, text_col: str, index: DataFrame, block: list, terms: list[bytes],
                  found: dict[int, int], corpus: Corpus, k: int) -> DataFrame:
    weights = np.array([math.floor(1000 * math.log((2 * corpus.documents + 2) / (2 * found.get(i, 0) + 1))) for i in range(len(terms))], dtype=np.int64)
    place = {t: i for i, t in enumerate(terms)}
    asked = Queries([q for q, _ in block], [np.array(sorted(place[t] for t in own)) for _, own in block], terms, weights)
    high = _by_block(index, lambda: _Best(asked, corpus, k), "query int, key long, bound long")
    high = high.withColumn("r", F.expr("row_number() OVER (PARTITION BY query ORDER BY bound DESC, key)")).filter(F.col("r") <= k).select("query", "key")
    first = rescored(docs, doc_id, text_col, high, asked, corpus)
    kth = _top(first, k).filter(F.col("rank") == k).select("query", "score").collect()  # one row for each query of the block
    least = np.ones(len(asked.ids), dtype=np.int64)
    for q, s in kth:
        least[q] = s
    reach = _by_block(index, lambda: _Reaching(asked, corpus, least), "query int, key long")
    return _top(rescored(docs, doc_id, text_col, reach, asked, corpus), k)


def _top(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query; a task keeps no more than ``k`` of its own before they are dealt out by query."""
    return scored.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query ORDER BY score DESC, id ASC NULLS LAST)")).filter(F.col("rank") <= k)
