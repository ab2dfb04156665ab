"""Registry of the named queries, each with reference SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signals.columns import CustomerCols, FactoryCols, PurchaseCols

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# How the test tables play the roles of the business tables.
ORDERS = PurchaseCols("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
EVENTS = PurchaseCols("user_id", "event_id", "ts", "value")
# An order has many lines, so this role exercises the distinct-order paths.
ORDER_LINES = PurchaseCols("l_suppkey", "l_orderkey", "l_shipdate", "l_extendedprice")
LINES = FactoryCols("l_orderkey", "l_shipdate", "l_extendedprice")
PEOPLE = CustomerCols("c_custkey", "c_name")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round columns so that sums taken in another order compare equal."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def as_long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})
