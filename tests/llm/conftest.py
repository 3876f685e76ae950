import pandas as pd
import pytest

#: Null, empty, blank, short, tied, repeated and very long texts.
EDGES = [
    None, "", "   \n\t", "one", "two words", "Ünïcödé naïve 日本語 🎉", "same text here twice over", "same text here twice over",
    "x" * 20_000, "long word list " * 9000, "line a\nline b\nline a\n\nline a", "퟿\u0001 odd <|endoftext|> bytes\x00here",
]


@pytest.fixture
def edges(spark):
    rows = [(i, t, "en", "s", 0 if t is None else len(t), i, "k", "x", "y", 1) for i, t in enumerate(EDGES)]
    # extra columns whose names clash with those that operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, key string, found string, spans string, hits int")


@pytest.fixture
def nothing(edges):
    return edges.limit(0)


@pytest.fixture
def documents(spark, data):
    import pyarrow.parquet as pq

    return spark.read.parquet(f"{data}/documents.parquet"), pq.read_table(f"{data}/documents.parquet").to_pandas()


def by_id(df, key="doc_id") -> pd.DataFrame:
    return df.toPandas().sort_values(key).set_index(key)


@pytest.fixture
def frame():
    return by_id
