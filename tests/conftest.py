import os
import sys

import duckdb
import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="session")
def spark():
    from deserta.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="deserta-tests")
    yield s


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="session")
def duck01():
    return duck(SF01)


@pytest.fixture(scope="session")
def duck001():
    return duck(SF001)


def normalize(df: pd.DataFrame) -> pd.DataFrame:
    df = df.copy()
    df = df[sorted(df.columns)]
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
    df = df.astype(str).replace({"nan": "None", "<NA>": "None", "NaT": "None"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(spark_df, oracle_df: pd.DataFrame):
    a = normalize(spark_df.toPandas() if hasattr(spark_df, "toPandas") else spark_df)
    b = normalize(oracle_df)
    assert list(a.columns) == list(b.columns), (list(a.columns), list(b.columns))
    assert len(a) == len(b), (len(a), len(b))
    diff = (a != b).any(axis=1)
    assert not diff.any(), pd.concat([a[diff].head(5), b[diff].head(5)])
