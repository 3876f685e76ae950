"""Every query with a SQL form against DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from stemline.plans import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    return con


def rows(df, columns):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{float(v) + 0.0:.5g}" if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else str(v)

    return sorted(tuple(map(plain, r)) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_equals_its_sql(spark, data, duck, name):
    ours, theirs = core.QUERIES[name](spark, data).toPandas(), duck.execute(core.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    number = [c for c in columns if ours[c].dtype.kind in "if" and theirs[c].dtype.kind in "if"]
    for c in number:
        ours[c], theirs[c] = ours[c].astype(float), theirs[c].astype(float)
    for c in set(columns) - set(number):
        if ours[c].dtype.kind in "ifu" or theirs[c].dtype.kind in "ifu":
            ours[c], theirs[c] = ours[c].astype("Float64"), theirs[c].astype("Float64")
    assert rows(ours, columns) == rows(theirs, columns)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, data, name):
    assert core.QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
