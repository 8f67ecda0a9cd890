"""Races of more runners than a card has: the queries take orders of any number of lines, and count a bet's draws once."""

import random
from datetime import datetime, timedelta

import pytest
from compare import check
from pyspark.sql import functions as F
from test_ranking import plain

from hindcast.operators import combos as G
from hindcast.operators import ranking as R


def entry_tables(spark, path, sizes, parts=40, seed=3):
    """The tables behind the entries, with one order of each of ``sizes`` lines."""
    rng = random.Random(seed)
    day = datetime(1995, 1, 1)
    orders = [(k, rng.randrange(30), rng.choice("FOP"), 1.0, day + timedelta(days=k % 60), rng.choice(["1-URGENT", "2-HIGH", "5-LOW"])) for k in range(len(sizes))]
    lines, prices = [], rng.sample(range(90_000, 10_000_000), sum(sizes))
    for k, n in enumerate(sizes):
        for i in range(n):
            lines.append((k, rng.randrange(parts), rng.randrange(8), i + 1, float(rng.randint(1, 50)), prices.pop() / 100, rng.randint(0, 10) / 100,
                          rng.randint(0, 8) / 100, rng.choice("ANR"), rng.choice("FO"), day))
    part = [(k, f"n{k}", f"Brand#{k % 5}", rng.choice(["LARGE", "SMALL"]), rng.randint(1, 50), 1.0) for k in range(parts)]
    for name, rows, schema in (
            ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
            ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                                "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
            ("part", part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


class Folder:
    """DuckDB on the folders that Spark wrote."""

    def __init__(self, path):
        import duckdb
        self.con = duckdb.connect()
        for t in ("orders", "lineitem", "part"):
            self.con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")

    def execute(self, sql):
        return self.con.execute(sql)


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    return entry_tables(spark, tmp_path_factory.mktemp("big"), [23, 40, 19, 3, 2, 1] + [5] * 120)


@pytest.mark.parametrize("name", ["pl_place", "pl_quinella", "pl_wide", "pl_trio", "recommend", "recommend_no_odds", "picks_document", "rank_gradients"])
def test_query_on_large_races(spark, big, name):
    from __spark_entry__ import oracle_sql, queries
    ok, msg = check(spark, Folder(big), big, queries()[name], oracle_sql()[name])
    assert ok, msg


def test_rank_model_on_large_races(spark, big):
    from __spark_entry__ import queries
    races = {r.race_id: r.n for r in queries()["rank_model"](spark, big).groupBy("race_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert races and set(races.values()) == {5}


def test_gradients_of_a_large_race(spark):
    rng = random.Random(5)
    race = [(i + 1, rng.randint(0, 9), rng.random()) for i in range(31)]
    df = spark.createDataFrame([(1, *r) for r in race], "race_id long, horse_number int, relevance int, s double")
    got = {r.horse_number: (r.gradient, r.curvature) for r in R.gradients(df, "relevance", "s", most=None).collect()}
    assert all(got[no] == pytest.approx((g, h), abs=1e-12) for no, g, h in plain(race)) and len(got) == 31


def test_trios_of_a_large_race(spark):
    df = spark.createDataFrame([("r", i, 1.0 + i % 3) for i in range(30)], "race_id string, horse_number int, win_prob double")
    assert G.pl_trio(df, most=None).agg(F.count("*"), F.round(F.sum("prob"), 9)).first() == (4060, 1.0)
