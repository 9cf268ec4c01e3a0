"""Each registered query of the graph against its SQL, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from graphloom.plans import catalogue, consolidation, ingestion, searching, sessions, vaults, walks  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings conversations".split()


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return ""
    if isinstance(v, (list, np.ndarray)):
        return "|".join(map(str, v))
    if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)):
        return repr(float(v))
    return str(v)


def rows(df):
    df = df.reindex(sorted(df.columns), axis=1)
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    assert rows(catalogue.QUERIES[name](spark, DIR).toPandas()) == rows(con.execute(catalogue.SQL[name]).df())
