"""Every query with a DuckDB twin gives the same rows."""

import numbers

import duckdb
import numpy as np
import pandas as pd
import pytest

from pagewright.plans import registry

DATA = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{DATA}/{n}.parquet'")
    return con


def plain(v):
    if v is None or pd.api.types.is_scalar(v) and pd.isna(v):
        return "~"
    if isinstance(v, numbers.Number) and not isinstance(v, bool | np.bool_):
        return f"{float(v):.6f}"  # whole numbers are floats where a column has nulls
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLE_SQL:
        assert rows(got) == rows(duck.execute(registry.ORACLE_SQL[name]).df())
