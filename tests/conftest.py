import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for p in (ROOT, os.path.dirname(os.path.abspath(__file__))):
    if p not in sys.path:
        sys.path.insert(0, p)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from hindcast.session import local_session
    return local_session("tests", cores="8", memory="6g")


@pytest.fixture(scope="session")
def e(spark):
    from hindcast.plans.entries import entries
    df = entries(spark, SF).cache()
    df.count()
    return df


@pytest.fixture
def hot(spark):
    """Treat every key with more than ten rows as oversized."""
    from hindcast.operators import keyed
    spark.conf.set(keyed.HOT_ROWS_CONF, "10")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield
    spark.conf.unset(keyed.HOT_ROWS_CONF)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def rows(df, *cols):
    df = df.select(*cols) if cols else df
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(norm(v) for v in r) for r in df.collect()), key=repr)
