import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from sparklex.plans import catalogue

SF = "/root/testdata/sf0.001"


def canon(df):
    def value(x):
        if x is None or x is pd.NaT or isinstance(x, float) and math.isnan(x):
            return None
        x = x.item() if hasattr(x, "item") else x
        return round(x, 6) if isinstance(x, float) else x if isinstance(x, int | bool | str) else str(x)

    df = df[sorted(df.columns)]
    return sorted((tuple(map(value, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is not None:
        other = duck.sql(sql).df()
        assert sorted(df.columns) == sorted(other.columns) and canon(df) == canon(other)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
