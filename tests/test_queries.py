"""Every query with SQL beside it gives the same rows at the smallest size."""

import duckdb
import pytest

from sectorflow.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype.kind == "f":
            whole = (df[c].dropna() % 1 == 0).all()  # long columns with nulls
            df[c] = df[c].astype("Int64") if whole else df[c].round(5) + 0.0
        elif str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
    out = df.astype(str).replace({"None": "nan", "<NA>": "nan", "NaT": "nan"})
    return sorted(tuple(x.removesuffix(".0") for x in r) for r in out.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, con, name):
    mine, sql = catalog.queries()[name](spark, SF).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(sql.columns)
    assert len(mine) == len(sql)
    assert norm(mine) == norm(sql)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
