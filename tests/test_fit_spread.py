"""The rows of a boosted fit are spread by their number, so that what one task reads does not grow with them."""

from pyspark.sql import functions as F

from hindcast.operators import learn as L


def most(df):
    return max(r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())


def test_rows_of_a_fit_are_spread(spark, monkeypatch):
    seen = []
    fit = L.fit_win
    monkeypatch.setattr(L, "FIT_ROWS", 100)
    monkeypatch.setattr(L, "fit_win", lambda rows, *a: (seen.append((most(rows), rows.count())), fit(rows, *a))[1])
    df = spark.range(1000).select(F.col("id").alias("race_id"), F.lit(1).alias("horse_number"), (F.col("id") % 7).cast("double").alias("x"),
                                  (F.col("id") % 2).cast("int").alias("is_win"), (F.col("id") % 3 == 0).cast("int").alias("is_placed"),
                                  F.to_date(F.lit("2024-01-01")).alias("date"))
    L.train(df.coalesce(2), ["x"], None, {"maxIter": 1, "maxDepth": 1})
    assert seen[0][1] == 1000 and seen[0][0] <= 150


def test_small_partitions_stay(spark):
    df = spark.range(1000).coalesce(3)
    assert L._spread(df) is df
    assert L._spread(df.limit(0)).count() == 0


def test_a_fit_of_its_own_is_spread(spark, monkeypatch):
    """``fit_place`` without ``train``."""
    asked = []
    spread = L._spread
    monkeypatch.setattr(L, "FIT_ROWS", 100)
    monkeypatch.setattr(L, "_spread", lambda rows: (asked.append(most(out := spread(rows))), out)[1])
    df = spark.range(1000).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3 == 0).cast("int").alias("is_placed"))
    L.fit_place(df.coalesce(2), ["x"], None, {"maxIter": 1, "maxDepth": 1})
    assert len(asked) == 1 and asked[0] <= 150
