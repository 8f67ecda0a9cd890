"""Vector tables ``(category, id, vec)``: lookup with a mean fallback, means, projection, neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast import schema as S
from hindcast.session import stored

MEAN_ID = "__mean__"
#: Categories whose matrices are sent to the tasks; more are joined.
MAX_CATEGORIES = 64


def mean_vectors(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """Mean vector per category: one average per position, no explode. The mean row itself is not averaged."""
    dim = dim or vectors.select(F.size("vec")).first()[0]
    means = [F.avg(F.col("vec")[i].cast("double")).alias(f"m{i}") for i in range(dim)]
    out = vectors.filter(F.col("id").cast("string") != MEAN_ID).groupBy("category").agg(*means)
    return out.select("category", F.array(*[F.col(f"m{i}") for i in range(dim)]).alias("vec"))


def add_vectors(df: DataFrame, vectors: DataFrame, categories: Sequence[str] = tuple(S.VECTOR_CATEGORIES)) -> DataFrame:
    """Columns ``<category>_emb_<i>``; unknown and missing ids get the mean vector of the category.

    The join side of the vectors is left to Spark's size check; the mean is one row per category, read as a scalar.
    """
    for cat in [c for c in categories if c in df.columns]:
        table = vectors.filter(F.col("category") == cat)
        dim = table.select(F.size("vec")).first()
        if dim is None:
            continue
        stored = table.filter(F.col("id").cast("string") == MEAN_ID).agg(F.first("vec")).scalar()
        mean = mean_vectors(table, dim[0]).agg(F.first("vec")).scalar()
        ids = table.filter(F.col("id").cast("string") != MEAN_ID).select(
            F.col("id").cast("string").alias("__id"), F.col("vec").cast("array<double>").alias("__vec"))
        df = (df.withColumn("__id", F.col(cat).cast("string")).join(ids, "__id", "left")
              .withColumn("__v", F.coalesce(F.col("__vec"), stored.cast("array<double>"), mean))
              .withColumns({f"{cat}_emb_{i}": F.col("__v")[i] for i in range(dim[0])})
              .drop("__id", "__vec", "__v"))
    return df


def covariances(vectors: DataFrame) -> DataFrame:
    """``category``, ``n``, ``mean`` and ``cov`` (rows of the covariance with n - 1, the mean row included) of every category.

    Each task adds up the products of the vectors' numbers per category (a Gram matrix), and the matrices are added by
    position, combined in the task: what is moved depends on categories and dimensions only. Sums are taken about the
    one vector of the category, so that vectors far from zero keep their digits. Vectors of one category have one length;
    null vectors take no part.
    """
    rows = vectors.filter("vec IS NOT NULL").select(F.col("category").cast("string").alias("category"), F.col("vec").cast("array<double>").alias("vec"))
    origin = stored(rows.groupBy(F.col("category").alias("__c")).agg(F.min_by("vec", F.xxhash64("vec")).alias("origin")))
    few = origin.limit(MAX_CATEGORIES + 1).count() <= MAX_CATEGORIES
    placed = rows.join(F.broadcast(origin) if few else origin, F.col("category").eqNullSafe(F.col("__c"))).select("category", "origin", "vec")
    schema = "category string, origin array<double>, at int, value double"

    def add_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for part in parts:
            for key, some in part.groupby("category", dropna=False, sort=False):
                origin = some["origin"].iloc[0]
                x = np.stack(some["vec"].to_numpy()) - origin
                x = np.column_stack([np.ones(len(x)), x])
                name = None if pd.isna(key) else key
                held[name] = (origin, held[name][1] + x.T @ x if name in held else x.T @ x)
        for name, (origin, gram) in held.items():
            yield pd.DataFrame({"category": name, "origin": [origin] * gram.size, "at": np.arange(gram.size, dtype=np.int32), "value": gram.ravel()})

    sums = placed.mapInPandas(add_up, schema).groupBy("category", "origin", "at").agg(F.sum("value").alias("value"))
    gram = sums.groupBy("category", "origin").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("g"))
    width = F.size("origin") + 1
    n, total = F.get("g", F.lit(0)), F.slice("g", F.lit(2), F.size("origin"))
    ready = gram.select("category", n.cast("long").alias("n"), total.alias("total"), "g", width.alias("width"), F.zip_with(
        total, "origin", lambda t, o: o + t / n).alias("mean"))
    row = lambda i: F.slice("g", i * F.col("width") + 2, F.col("width") - 1)
    cov = F.transform(F.sequence(F.lit(1), F.col("width") - 1), lambda i: F.zip_with(row(i), "total", lambda g, t: (
        g - F.get("total", i - 1) * t / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))))
    return ready.select("category", "n", "mean", cov.alias("cov"))


def principal_axes(vectors: DataFrame, k: int) -> DataFrame:
    """``category``, ``n``, ``mean``, ``axes`` (at most ``k`` unit vectors, the one of greatest variance first) and their
    ``variance``. The number of an axis that is greatest in size is positive, so axes do not depend on the run."""
    schema = "category string, n long, mean array<double>, axes array<array<double>>, variance array<double>"

    def turn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            axes, variance = [], []
            for cov in part["cov"]:
                value, vector = np.linalg.eigh(np.nan_to_num(np.stack(cov).astype(float)))
                value, vector = value[::-1][:k], vector[:, ::-1][:, :k].T
                sign = np.sign(vector[np.arange(len(vector)), np.abs(vector).argmax(axis=1)])
                axes.append((vector * sign[:, None]).tolist())
                variance.append(np.maximum(value, 0.0).tolist())
            yield pd.DataFrame({"category": part["category"], "n": part["n"], "mean": part["mean"], "axes": axes, "variance": variance})

    return covariances(vectors).mapInPandas(turn, schema)


def pca_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """Centred projection of each category to at most ``k`` dimensions; the mean row is projected alike. Null vectors stay null."""
    axes = stored(principal_axes(vectors, k).select(F.col("category").alias("__c"), "mean", "axes"))
    few = axes.limit(MAX_CATEGORIES + 1).count() <= MAX_CATEGORIES
    same = F.col("category").cast("string").eqNullSafe(F.col("__c"))
    done = vectors.join(F.broadcast(axes) if few else axes, same, "left")
    centred = F.zip_with(F.col("vec").cast("array<double>"), "mean", lambda v, m: v - m)
    return done.withColumn("__x", centred).select(
        "category", "id", F.when(F.col("__x").isNotNull(), F.transform("axes", lambda a: dot(a, F.col("__x")))).alias("vec"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_topn(vectors: DataFrame, category: str, id_value, n: int = 10) -> DataFrame:
    """The n nearest ids by cosine; the target (one vector) travels as a literal, the rest is one scan and a top-n."""
    table = vectors.filter(F.col("category") == category)
    row = table.filter(F.col("id") == F.lit(id_value)).select("vec").first()
    if row is None:
        raise KeyError(f"{category}: {id_value}")
    target = F.array(*[F.lit(float(x)) for x in row[0]])
    vec = F.col("vec")
    sim = dot(vec, target) / (F.sqrt(dot(vec, vec)) * F.sqrt(dot(target, target)))
    others = table.filter((F.col("id") != F.lit(id_value)) & (F.col("id").cast("string") != MEAN_ID))
    return others.select("id", sim.alias("similarity")).orderBy(F.desc("similarity"), "id").limit(n)
