"""Recency, frequency, monetary profiles."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signals.columns import PurchaseCols
from signals.functions.calendar import whole_days
from signals.functions.numeric import sum_or_zero
from signals.operators.tables import first_by_key


def day_after_last(purchases: DataFrame, time: str) -> Column:
    """The default reference moment, one day after the last purchase (time of day kept)."""
    return purchases.agg((F.max(time) + F.expr("interval 1 day")).alias("reference")).scalar()


def rfm(
    purchases: DataFrame,
    customers: DataFrame | None = None,
    reference: date | datetime | None = None,
    cols: PurchaseCols = PurchaseCols(),
    customer_key: str | None = None,
    dedup_customers: bool = False,
    one_row_per_order: bool = False,
) -> DataFrame:
    """A1: one row per known customer with last purchase, distinct orders, spend and recency.

    The distinct order count shuffles by (customer, order) first, so one customer with a
    large share of all purchases is spread over many tasks; ``one_row_per_order`` (tables
    keyed by order) replaces it by a plain count and saves that shuffle. The customer table
    joins on the already reduced profile (J1); duplicate customers fan out unless
    deduplicated.
    """
    orders = F.count(cols.order) if one_row_per_order else F.count_distinct(cols.order)
    ref = F.lit(reference).cast("timestamp_ntz") if reference is not None else day_after_last(purchases, cols.time)
    profile = (
        purchases.filter(F.col(cols.customer).isNotNull())
        .groupBy(cols.customer)
        .agg(
            F.max(cols.time).alias("ultima_compra"),
            orders.alias("frequency"),
            sum_or_zero(F.col(cols.value)).alias("monetary"),
        )
        .withColumn("recency", whole_days(F.col("ultima_compra"), ref))
    )
    if customers is None:
        return profile
    key = customer_key or cols.customer
    if key not in customers.columns:
        return profile
    right = first_by_key(customers, [key]) if dedup_customers else customers
    if key != cols.customer:
        right = right.withColumnRenamed(key, cols.customer)
    return profile.join(right, cols.customer, "left")
