"""Inactive customers and their return: activity islands, spells of inactivity, return rates and curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signals.columns import PurchaseCols

INACTIVE_DAYS = 90


def purchase_days(purchases: DataFrame, cols: PurchaseCols = PurchaseCols(), keep: Sequence[str] = ()) -> DataFrame:
    """Distinct (customer, ``day``) with the day's spend; a customer with a third of all rows keeps a row a day."""
    known = purchases.where(F.col(cols.customer).isNotNull() & F.col(cols.time).isNotNull())
    firsts = [F.min(c).alias(c) for c in keep]
    return known.groupBy(cols.customer, F.to_date(cols.time).alias("day")).agg(F.sum(cols.value).alias("spend"), *firsts)


def activity_islands(
    purchases: DataFrame, cols: PurchaseCols = PurchaseCols(), inactive_days: int = INACTIVE_DAYS
) -> DataFrame:
    """Runs of purchase days no further apart than ``inactive_days``: ``customer, island, first_day, last_day, days, spend``.

    Islands are numbered from 1. A day starts one if the gap before it is longer; a running count of starts names it.
    """
    order = Window.partitionBy(cols.customer).orderBy("day")
    days = purchase_days(purchases, cols)
    apart = F.date_diff("day", F.lag("day").over(order))
    starts = F.when(apart <= inactive_days, 0).otherwise(1)
    numbered = days.withColumn("_starts", starts).withColumn(
        "island", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy(cols.customer, "island").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days"), F.sum("spend").alias("spend")
    )


def inactive_spells(
    purchases: DataFrame, cols: PurchaseCols = PurchaseCols(), inactive_days: int = INACTIVE_DAYS, keep: Sequence[str] = ()
) -> DataFrame:
    """``customer, since, returned, through, length``: spells of inactivity, one row each.

    A customer is inactive ``since`` the day that lies ``inactive_days`` after a purchase without another one up to it. The
    spell ends with the next purchase day (``returned``) or is cut off by the end of the data (null there, ``through`` is that
    day). ``length`` is in days. ``keep`` names customer columns of the purchases to bring along.
    """
    end = purchases.agg(F.max(F.to_date(cols.time)).alias("hi")).scalar()
    days = purchase_days(purchases, cols, keep)
    following = F.lead("day").over(Window.partitionBy(cols.customer).orderBy("day"))
    spells = days.select(
        cols.customer, *keep, F.date_add("day", inactive_days).alias("since"), following.alias("returned")
    ).withColumn("through", F.coalesce("returned", end))
    ended = F.col("returned").isNotNull() & (F.col("since") < F.col("returned"))
    cut = F.col("returned").isNull() & (F.col("since") <= F.col("through"))
    return spells.where(ended | cut).withColumn("length", F.date_diff("through", "since"))


def reactivation_by_month(spells: DataFrame, width_days: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """``by, month, gap_days, inactive, reactivated, rate``: of those inactive when a month begins, who returns in it.

    Customers are told apart by how long they have been inactive then, in steps of ``width_days``. A spell is made into the
    months it spans, which the calendar bounds; the rest is one combining aggregate.
    """
    begin = F.trunc("since", "MM")
    first = F.when(begin == F.col("since"), begin).otherwise(F.add_months(begin, 1))
    last = F.trunc("through", "MM")
    months = F.explode(F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month"))))
    rows = spells.select(*by, "since", "returned", months.alias("month"))
    gap = F.floor(F.date_diff("month", "since") / width_days) * width_days
    back = F.coalesce(F.trunc("returned", "MM") == F.col("month"), F.lit(False))
    return (
        rows.groupBy(*by, "month", gap.cast("int").alias("gap_days"))
        .agg(F.count(F.lit(1)).alias("inactive"), F.count_if(back).alias("reactivated"))
        .withColumn("rate", F.col("reactivated") / F.col("inactive"))
    )


def return_curve(spells: DataFrame, width_days: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """``by, after_days, at_risk, returned, censored, hazard, inactive_share``: how long inactivity lasts.

    Spells that the end of the data cuts off count as long as they were seen and no further. The share still inactive is
    the running product of those who did not return in each step of ``width_days``; spells are first counted by step, so windows hold
    one row a step of the calendar.
    """
    step = F.floor(F.col("length") / width_days)
    counts = spells.groupBy(*by, step.alias("step")).agg(F.count("returned").alias("returned"), F.count(F.lit(1)).alias("n"))
    later = Window.partitionBy(*by).orderBy("step").rowsBetween(0, Window.unboundedFollowing)
    so_far = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    staying: Column = 1 - F.col("hazard")
    return (
        counts.withColumn("at_risk", F.sum("n").over(later))
        .withColumn("hazard", F.col("returned") / F.col("at_risk"))
        .withColumn("inactive_share", F.product(staying).over(so_far))
        .select(
            *by,
            (F.col("step") * width_days).cast("int").alias("after_days"),
            "at_risk",
            "returned",
            (F.col("n") - F.col("returned")).alias("censored"),
            "hazard",
            "inactive_share",
        )
    )
