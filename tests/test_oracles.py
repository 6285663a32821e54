"""Every registered query of the library against DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from loomwork import registry
from loomwork.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def shown(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return str([shown(y) for y in x])
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if not isinstance(x, (bool, str)) and hasattr(x, "as_integer_ratio"):
        return f"{float(x):.6g}"
    return str(x)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted(tuple(map(shown, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert rows(got) == rows(duck.execute(registry.oracle_sql()[name]).df())
