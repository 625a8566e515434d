"""Every registered query against its checking SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
CHECKS = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    frame = frame.astype({c: "float64" for c in frame.columns if str(frame[c].dtype) == "Int64"})
    return sorted(
        tuple("NULL" if pd.isna(v) else f"{v:.5f}" if isinstance(v, float) else str(v) for v in row)
        for row in frame.astype(object).itertuples(index=False)
    )


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, sql, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = sql.execute(CHECKS[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize(
    "name", ["explode_tokens", "explode_ast_nodes", "token_bigrams", "style_features"]
)
def test_unchecked_queries_return_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
