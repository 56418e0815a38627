"""Every registered query of the engine against its SQL, on the smallest tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

from barloom import catalogue, catalogue_tables  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(columns, found):
    def plain(v):
        if v is None or v != v:
            return "null"
        return repr(v + 0.0) if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {re.sub('.parquet$', '', f)} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    found = got.collect()
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name])
        assert rows(got.columns, found) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["symbol", "bar_idx", "macd", "z", "signal"] and df.count() > 0
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) <= set(entry.queries())


def test_rounding_equals_duckdb_near_ties(spark):
    """Sums of money with eight decimals meet ties of six; both engines must round the same double alike."""
    import duckdb
    import pandas as pd

    x = pd.DataFrame({"x": [sign * (k * 7919 % 40_000_000 + 0.5) * 1e-6 * 317 for k in range(1, 20_001) for sign in (1, -1)]})
    x.loc[len(x)] = float("inf")
    got = catalogue.rounded(spark.createDataFrame(x).withColumn("y", F.col("x")), "y").toPandas()
    con = duckdb.connect()
    con.register("v", x)
    want = dict(con.sql("SELECT x, round(x, 6) FROM v").fetchall())
    assert {a: b for a, b in zip(got.x, got.y) if want[a] != b} == {}
