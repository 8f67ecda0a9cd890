"""Permutations without a loop for each row, and their repeats spread over the partitions."""

import pytest
from pyspark.sql import functions as F

from hindcast.operators import learn as L
from hindcast.operators.permute import permuted

SAME = [9, 5, 8, 6, 2, 7, 3, 0, 1, 4]


@pytest.mark.parametrize("n", [1, 2, 7, 90, 1000])
def test_every_place_once(spark, n):
    to = spark.range(n).select("id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("r"))
    got = to.withColumn("to", permuted(F.col("id"), n, 5, F.col("r"))).groupBy("r").agg(F.collect_set("to").alias("s")).collect()
    assert len(got) == 3 and all(sorted(r.s) == list(range(n)) for r in got)


def test_same_places_as_ever(spark):
    """The permutation is a function of place, seed and repeat that saved results rest on."""
    got = [r.to for r in spark.range(10).select(permuted(F.col("id"), 10, 7, F.lit(1)).alias("to")).collect()]
    assert got == SAME


def test_indexed_rows_are_spread(spark):
    df = spark.range(2000).select(F.col("id").alias("race_id"), F.lit(1).alias("horse_number"))
    rows = L._indexed(df)
    sizes = [r["count"] for r in rows.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 500 and rows.agg(F.count_distinct("__i"), F.min("__i"), F.max("__i")).first() == (2000, 1, 2000)
