"""Every core query against its SQL twin on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from palimpsest.plans import catalogue


def cell(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(cell, x)) + "]"
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, float):
        return repr(round(x, 5) + 0.0)
    if isinstance(x, pd.Timestamp):
        return str(x.tz_convert("UTC").tz_localize(None) if x.tzinfo else x)
    return str(x)


def table(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    from pathlib import Path

    for p in Path(data).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, data, duck, name):
    got = catalogue.QUERIES[name](spark, data).toPandas()
    want = duck.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, data, name):
    df = catalogue.QUERIES[name](spark, data)
    assert df.columns
    df.count()
