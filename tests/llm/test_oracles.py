"""The training-data queries with a SQL form against DuckDB."""

import duckdb
import pytest

from stemline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    ours, theirs = queries.QUERIES[name](spark, data).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    plain = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert plain(ours) == plain(theirs)


def test_all_are_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
