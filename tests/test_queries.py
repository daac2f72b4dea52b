"""Every registered query with an equivalent gives DuckDB's rows, and all run."""

import duckdb
import pandas as pd
import pytest

from turnstone.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return int(v) if v == int(v) and abs(v) < 1e15 else round(v, 6)
    return v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(str(plain(x)) for x in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLE_SQL:
        want = duck.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert list(got.columns)
