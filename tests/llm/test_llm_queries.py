"""Registered text queries next to their reference SQL on the smallest test data."""

from __future__ import annotations

import os

import duckdb
import pytest

from compare import TABLES, rows_of
from signals.llm.queries import LLM_QUERIES, LLM_SQL

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data is not here")


@pytest.mark.parametrize("name", sorted(LLM_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = LLM_QUERIES[name](spark, SF_DIR)
    expected = con.sql(LLM_SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(LLM_QUERIES) - set(LLM_SQL)))
def test_one_row_per_input_row(spark, name):
    table = "pages" if name.startswith("op5_") else "documents"
    assert LLM_QUERIES[name](spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()


def test_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))
