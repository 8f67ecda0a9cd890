"""Quality scores by regularised quadratic discriminant analysis of document statistics.

Each text gives ``len(STATISTICS)`` numbers, already on a scale where they spread evenly (logarithms of sizes and rates,
log-odds of shares). The sums that a Gaussian needs (rows, sums and products by class and fold) are added up in the tasks,
so the fit takes every labelled row and the driver sees a table of fixed size. Class covariances are shrunk towards the
pooled one and its diagonal; the two weights are those with the best mean log-density of each fold under the model of the
others, which follows from the same sums. A score is the difference of two Mahalanobis log-densities, each by its cached
Cholesky factor, made a probability by a logistic curve fitted on counts of the differences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.llm.common import map_texts

STATISTICS = ("words", "word_length", "word_length_spread", "longest_word", "distinct_words", "top_word", "same_as_last", "distinct_pairs",
              "symbols", "ends", "pauses", "exclamations", "capitals", "digits", "wide", "capital_words", "symbol_words",
              "bar_words", "line_length", "repeated_lines")

#: Classes of bytes: 0 others, then space, lower case, capital, digit, end mark, pause, symbol, parts of wide characters (first, later).
CLASSES = np.zeros(256, dtype=np.int64)
for _class, _bytes in enumerate((b" \t\n\x0b\x0c\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".!?", b",;:",
                                 b"#*$%&|<>@^~=_+\\/{}[]", bytes(range(0xC0, 0x100)), bytes(range(0x80, 0xC0))), 1):
    CLASSES[list(_bytes)] = _class
SPACE, LOWER, CAPITAL, DIGIT, END, PAUSE, SYMBOL, WIDE, LATER = range(1, 10)
SYMBOLS = frozenset(b"#*$%&|<>@^~=_+\\/{}[]")


def _share(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-odds of k in n."""
    return np.log((k + 0.5) / (np.maximum(n - k, 0) + 0.5))


def _rate(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.log((k + 0.5) / (n + 1.0))


def statistics(texts: list[str]) -> np.ndarray:
    """A row of ``STATISTICS`` for each whole text."""
    raws = [t.encode() for t in texts]
    d = len(raws)
    sizes = np.array([len(r) for r in raws], dtype=np.int64)
    data = np.frombuffer(b"".join(raws), dtype=np.uint8)
    count = np.bincount(np.repeat(np.arange(d) * 10, sizes) + CLASSES[data], minlength=10 * d).reshape(d, 10)
    marks = np.bincount(np.repeat(np.arange(d), sizes)[data == ord("!")], minlength=d)
    docs = [r.split() for r in raws]
    n = np.array([len(w) for w in docs], dtype=np.int64)
    doc = np.repeat(np.arange(d), n)
    coded = pa.array(list(chain.from_iterable(docs)), pa.binary()).dictionary_encode()
    ids, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    length = np.array([len(w) for w in words], dtype=np.float64)[ids] if len(ids) else np.zeros(0)
    flags = np.array([(w[:2].isupper() and w.isupper(), w[-1] in SYMBOLS, w == b"|") for w in words], dtype=bool).reshape(len(words), 3)
    total = np.bincount(doc, length, d)
    mean = total / np.maximum(n, 1)
    spread = np.sqrt(np.bincount(doc, (length - mean[doc]) ** 2, d) / np.maximum(n, 1))
    longest = np.zeros(d)
    np.maximum.at(longest, doc, length)
    _, first, times = np.unique(doc * max(1, len(words)) + ids, return_index=True, return_counts=True)
    distinct, top = np.bincount(doc[first], minlength=d), np.zeros(d)
    np.maximum.at(top, doc[first], times)
    inside = doc[1:] == doc[:-1]
    last = np.bincount(doc[1:][inside & (ids[1:] == ids[:-1])], minlength=d)
    pairs = np.unique((ids[:-1] * max(1, len(words)) + ids[1:])[inside] ^ (doc[1:][inside] << 44))
    kinds = np.bincount(pairs >> 44, minlength=d)[:d] if len(words) < 1 << 22 else distinct
    flagged = [np.bincount(doc[flags[ids, k]], minlength=d) if len(ids) else np.zeros(d) for k in range(3)]
    lines = [[x for x in r.split(b"\n") if x.strip()] for r in raws]
    n_lines = np.array([len(x) for x in lines])
    same = n_lines - np.array([len(set(x)) for x in lines])
    letters = count[:, LOWER] + count[:, CAPITAL]
    chars = sizes - count[:, LATER]
    out = [np.log1p(n), np.log1p(mean), np.log1p(spread), np.log1p(longest), _share(distinct, n), _share(top, n), _share(last, n),
           _share(kinds, np.maximum(n - 1, 0)), _rate(count[:, SYMBOL], n), _rate(count[:, END], n), _rate(count[:, PAUSE], n), _rate(marks, n),
           _share(count[:, CAPITAL], letters), _share(count[:, DIGIT], chars), _share(count[:, WIDE], chars),
           *[_share(f, n) for f in flagged], np.log1p(n / np.maximum(n_lines, 1)), _share(same, n_lines)]
    return np.column_stack(out).astype(np.float64)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its texts, with ``statistics``: an array of doubles. Null texts count as empty, which give the statistics of
    no words. One pass without a shuffle; a column called ``statistics`` is replaced."""
    added = T.StructType([T.StructField("statistics", T.ArrayType(T.DoubleType(), False))])

    def make():
        return lambda _, texts: [pa.ListArray.from_arrays(
            np.arange(len(texts) + 1, dtype=np.int32) * len(STATISTICS), statistics(texts).ravel())]

    return map_texts(docs, text_col, [c for c in docs.columns if c != text_col], added, make)


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log-determinants of the classes 0 and 1, and the curve of the score.

    Without labels of both classes ``means`` is empty and the score is the share of label 1 (0.5 without labels)."""

    means: tuple = ()
    factors: tuple = ()
    logdets: tuple = ()
    slope: float = 0.0
    offset: float = 0.0
    weights: tuple[float, float] = (0.0, 0.0)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, on a scale that keeps its sign and order."""
        if not self.means:
            return np.zeros(len(x))
        part = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * g
                for m, f, g in zip(self.means, self.factors, self.logdets, strict=True)]
        return np.arcsinh(part[1] - part[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -60, 60)))


def _sums(rows: DataFrame) -> list:
    """For each class and fold: rows, and sums of the products of all pairs of (1, statistics). At most classes x folds x
    (statistics + 1) squared rows come from each task and, added up, to the driver."""
    schema = "label int, fold int, i int, j int, v double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([np.ones(b.num_rows), b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)])
            label, fold = b.column(0).to_numpy(), b.column(1).to_numpy()
            for key in {*zip(label.tolist(), fold.tolist(), strict=True)}:
                own = x[(label == key[0]) & (fold == key[1])]
                total[key] = total.get(key, 0) + own.T @ own
        for (label, fold), m in sorted(total.items()):
            i, j = np.indices(m.shape, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, label, np.int32)), pa.array(np.full(m.size, fold, np.int32)),
                                              pa.array(i.ravel()), pa.array(j.ravel()), pa.array(m.ravel())], names=["label", "fold", "i", "j", "v"])

    return rows.select("label", "fold", "statistics").mapInArrow(run, schema).groupBy("label", "fold", "i", "j").agg(F.sum("v").alias("v")).collect()


def _gaussian(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = m[0, 1:] / m[0, 0]
    return mean, m[1:, 1:] / m[0, 0] - np.outer(mean, mean)


def _shrunk(own: np.ndarray, pooled: np.ndarray, weights: tuple[float, float]) -> np.ndarray:
    """The class covariance, shrunk towards the pooled one and then towards its diagonal; a statistic that never varies gets
    a thousandth of the mean variance."""
    a, b = weights
    mixed = (1 - a) * own + a * pooled
    floor = 1e-3 * max(np.trace(pooled) / len(pooled), 1e-9)
    return (1 - b) * mixed + b * np.diag(np.diag(pooled)) + floor * np.eye(len(pooled))


def _log_density(held: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> float:
    """Sum of the log-densities of the rows behind ``held``."""
    factor = np.linalg.cholesky(cov)
    about = held[1:, 1:] - np.outer(held[1:, 0], mean) - np.outer(mean, held[0, 1:]) + held[0, 0] * np.outer(mean, mean)
    inverse = np.linalg.inv(factor)
    return -0.5 * np.trace(inverse @ about @ inverse.T) - held[0, 0] * np.log(np.diag(factor)).sum()


def _pooled(by: list[np.ndarray]) -> np.ndarray:
    """Covariance within the classes."""
    return sum(_gaussian(m)[1] * m[0, 0] for m in by) / sum(m[0, 0] for m in by)


WEIGHTS = tuple((a, b) for a in (0.0, 0.05, 0.2, 0.5, 0.8) for b in (0.0, 0.01, 0.1, 0.3))


def fit(rows: DataFrame) -> Model:
    """The model of ``rows`` with ``statistics``, ``label`` (0 or 1) and ``fold`` (parts for the choice of the weights).

    Rows with a null label or fold, or another label, take no part; repeated rows count each time. Every other row is used.
    """
    from hindcast.session import stored
    rows = stored(rows.filter("label IN (0, 1) AND fold IS NOT NULL")
                  .select(F.col("label").cast("int").alias("label"), F.col("fold").cast("int").alias("fold"), "statistics"))
    size = len(STATISTICS) + 1
    by: dict[tuple[int, int], np.ndarray] = {}
    for r in _sums(rows):
        by.setdefault((r.label, r.fold), np.zeros((size, size)))[r.i, r.j] = r.v
    whole = [sum(m for (k, _), m in by.items() if k == label) if any(k == label for k, _ in by) else None for label in (0, 1)]
    if whole[0] is None or whole[1] is None:
        share = 0.5 if whole[0] is None and whole[1] is None else float(whole[1] is not None)
        return Model(offset=float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    folds = sorted({f for _, f in by})
    best, weights = -np.inf, WEIGHTS[-1]
    for w in WEIGHTS if len(folds) > 1 else ():
        gained = 0.0
        for f in folds:
            rest = [whole[k] - by.get((k, f), 0) for k in (0, 1)]
            if min(m[0, 0] for m in rest) < 2:
                continue
            pooled = _pooled(rest)
            for k in (0, 1):
                if (k, f) in by:
                    mean, cov = _gaussian(rest[k])
                    gained += _log_density(by[k, f], mean, _shrunk(cov, pooled, w))
        if gained > best:
            best, weights = gained, w
    pooled = _pooled(whole)
    means, factors, logdets = [], [], []
    for m in whole:
        mean, cov = _gaussian(m)
        factor = np.linalg.cholesky(_shrunk(cov, pooled, weights))
        means.append(mean)
        factors.append(np.linalg.inv(factor))
        logdets.append(2 * float(np.log(np.diag(factor)).sum()))
    model = Model(tuple(means), tuple(factors), tuple(logdets), 1.0, 0.0, weights)
    return _curved(rows, model)


def _curved(rows: DataFrame, model: Model, steps: int = 32) -> Model:
    """The model with the logistic curve of its differences, fitted on their counts in bins of 1/``steps``."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                d = model.difference(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(d * steps).astype(np.int64))], names=["label", "bin"])

    bins = rows.select("label", "statistics").mapInArrow(run, "label int, bin long").groupBy("label", "bin").count().collect()
    x = np.array([r.bin / steps for r in bins])
    y = np.array([float(r.label) for r in bins])
    n = np.array([float(r["count"]) for r in bins])
    design = np.column_stack([x, np.ones_like(x)])
    beta, ridge = np.array([1.0, 0.0]), np.diag([1e-3, 1e-3])

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * b @ ridge @ b)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -60, 60)))
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + ridge, design.T @ (n * (p - y)) + ridge @ beta)
        size = 1.0
        while loss(beta - size * step) > loss(beta) and size > 1e-6:
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return Model(model.means, model.factors, model.logdets, max(float(beta[0]), 0.0), float(beta[1]), model.weights)


def score(measured: DataFrame, model: Model) -> DataFrame:
    """``measured`` with ``score`` instead of ``statistics``: the probability of label 1. Every row has one; a column called
    ``score`` is replaced."""
    keep = [c for c in measured.columns if c not in ("statistics", "score")]
    frame = measured.select(*[F.col(f"`{c}`") for c in keep], "statistics")
    schema = T.StructType([f for f in frame.schema.fields if f.name in keep] + [T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            x = b.column(len(keep)).flatten().to_numpy().reshape(b.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(model.score(x))], names=[*keep, "score"])

    return frame.mapInArrow(run, schema)


def fold_of(key: str, folds: int = 5):
    """Part of a row by the checksum of its key as text; null for a null key."""
    return F.pmod(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")), F.lit(folds)).cast("int")


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", text_col: str = "text",
                   folds: int = 5) -> DataFrame:
    """``key``, ``held_out`` (fold 0, which teaches nothing) and ``score`` of each row of ``docs``.

    The statistics of all texts are taken once and kept in the shared folder; labels join these small rows. A key with
    several distinct labels counts with each; null keys have no label and are not held out. Two empty tables give no rows.
    """
    from hindcast.session import stored
    measured = stored(measure(docs.select(F.col(f"`{key}`"), F.col(f"`{text_col}`").alias("__t")), "__t"))
    known = labels.select(F.col(f"`{key}`"), F.col(f"`{label}`").alias("label")).filter(f"`{key}` IS NOT NULL AND label IS NOT NULL").distinct()
    taught = measured.withColumn("fold", fold_of(key, folds)).filter("fold <> 0").join(known, key)
    return score(measured, fit(taught)).select(F.col(f"`{key}`"), F.coalesce(fold_of(key, folds) == 0, F.lit(False)).alias("held_out"), "score")
