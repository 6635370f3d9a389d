"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from cuewright.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


def plain(pdf: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in row) for row in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", [n for n, (_, text) in QUERIES.items() if text])
def test_matches_sql(spark, duck, name):
    f, text = QUERIES[name]
    got, want = f(spark, DATA).toPandas(), duck.sql(text).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", [n for n, (_, text) in QUERIES.items() if not text])
def test_runs(spark, name):
    assert QUERIES[name][0](spark, DATA).count() > 0
