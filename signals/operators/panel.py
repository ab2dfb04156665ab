"""Customer-by-week training panel and the scoring base."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signals.columns import PROPENSITY_FEATURES, SNAPSHOT, TARGET, PurchaseCols
from signals.functions.calendar import first_weekday_from, next_midnight, week_numbers
from signals.functions.numeric import ratio, ratio_or_zero, sum_or_zero


def _feature_columns(anchor: Column) -> dict[str, Column]:
    """The five features from the per-group sums."""
    return {
        "recency": F.date_diff(anchor, F.col("_last")).cast("long"),
        "frequency_lookback": F.col("_orders").cast("long"),
        "monetary_lookback": F.coalesce("_spend", F.lit(0.0)),
        "ticket_medio_lookback": ratio(F.coalesce("_spend", F.lit(0.0)), F.col("_orders")),
        "tendencia_gasto_lookback": ratio_or_zero(F.coalesce("_short", F.lit(0.0)), F.col("_spend")),
    }


def _purchase_days(purchases: DataFrame, cols: PurchaseCols, lookback: int, one_row_per_order: bool) -> DataFrame:
    """Spend and order count per customer and day, with the days the orders count for.

    A purchase on day ``_day`` is first visible at midnight ``_seen`` and stays in the
    lookback until ``_day + lookback``. So that an order bought on several days counts
    once at any snapshot, each of its days counts only until the next one is visible.
    """
    dtype = dict(purchases.dtypes)[cols.time]
    base = purchases.na.drop(subset=[cols.customer, cols.order, cols.time]).select(
        cols.customer,
        cols.order,
        F.to_date(cols.time).alias("_day"),
        next_midnight(F.col(cols.time), dtype).alias("_seen"),
        F.col(cols.value).alias("_value"),
    )
    if one_row_per_order:
        lines = base.withColumns({"_until": F.date_add("_day", lookback), "_sum": F.col("_value")})
    else:
        # Copies of an order collapse before the window, which then holds one row per day. One shuffle
        # by order serves both.
        w = Window.partitionBy(cols.customer, cols.order).orderBy("_seen", "_day")
        lines = (
            base.repartition(cols.customer, cols.order)
            .groupBy(cols.customer, cols.order, "_day", "_seen")
            .agg(F.sum("_value").alias("_sum"))
            .withColumn("_until", F.least(F.date_add("_day", lookback), F.date_sub(F.lead("_seen").over(w), 1)))
        )
    return lines.groupBy(cols.customer, "_day", "_seen", "_until").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_sum").alias("_sum")
    )


def propensity_panel(
    purchases: DataFrame,
    cols: PurchaseCols = PurchaseCols(),
    horizon_days: int = 30,
    lookback_days: int = 90,
    short_lookback_days: int = 30,
    weekday: str = "MON",
    one_row_per_order: bool = False,
    drop_censored: bool = False,
    future_value: str | None = None,
    between: tuple[date, date] | None = None,
    last_day: date | None = None,
    span_weeks: int | None = None,
) -> DataFrame:
    """A3: one row per (customer, weekly snapshot) with features and the repurchase label.

    Windows are closed: history is ``[snap - lookback, snap]`` and the label looks at
    ``(snap, snap + horizon]``. Instead of joining snapshots with purchases (J4), each
    customer-day names the few snapshots that can see it, and one aggregate with
    conditional sums produces all three windows (J3, J5).

    Purchases are first reduced to customer-days, so a customer with a large share of all
    rows keeps at most one row per day; only then are rows moved to their customer. The
    snapshot rows (about 18 per customer-day) are made and aggregated behind that shuffle
    and never shuffled themselves.

    ``one_row_per_order`` skips the repeated-order step for tables keyed by order.
    ``drop_censored`` leaves out snapshots whose label window ends after the data. ``future_value`` names a further
    column with the spend inside the label window. ``between`` limits the snapshots to a range of days, and only purchases
    that these can see are read; ``last_day`` is the data's last day where the caller knows it. ``span_weeks`` moves purchases to
    their customer and a span of so many weeks instead, once for each span that can see them: a task then makes snapshots of one
    span or two only, and its rows can be written by snapshot without being shuffled to it.
    """
    if last_day is not None:
        last = F.lit(last_day)
    else:
        last = purchases.select(F.to_date(cols.time).alias("d")).agg(F.max("d").alias("hi")).scalar()
    data_end, first = last, F.lit(None).cast("date")
    if between is not None:
        first, last = F.lit(between[0]), F.least(F.lit(between[1]), last)
        seen_by = (F.date_sub(F.lit(between[0]), lookback_days + 1), F.date_add(F.lit(between[1]), horizon_days + 2))
        kind = dict(purchases.dtypes)[cols.time]
        purchases = purchases.where(F.col(cols.time).between(*[x.cast(kind) for x in seen_by]))
    days = _purchase_days(purchases, cols, lookback_days, one_row_per_order)
    seen, snap = F.col("_seen"), F.col(SNAPSHOT)
    # A fixed count: run-time merging goes by the size before the rows multiply.
    slots = int(purchases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = F.date_add("_day", lookback_days)
    ranges = {"_from": F.greatest(F.date_sub(seen, horizon_days), first), "_to": F.least(leaves, last)}
    if span_weeks:
        start, span = F.lit(date(1970, 1, 1)), 7 * span_weeks
        number = lambda c: F.floor(F.date_diff(c, start) / span).cast("int")
        spans = F.when(F.col("_from") <= F.col("_to"), F.sequence(number(F.col("_from")), number(F.col("_to"))))
        inside = {
            "_from": F.greatest("_from", F.date_add(start, F.col("_span") * span)),
            "_to": F.least("_to", F.date_add(start, (F.col("_span") + 1) * span - 1)),
        }
        dealt = days.withColumns(ranges).withColumn("_span", F.explode(spans)).repartitionByRange(slots, "_span", cols.customer)
        near, together = dealt.withColumns(inside), ["_span"]
    else:
        near, together = days.repartition(slots, cols.customer).withColumns(ranges), []
    snapshots = (
        near.withColumn("_week", F.explode(week_numbers(F.col("_from"), F.col("_to"), weekday)))
        .withColumn(SNAPSHOT, F.date_add(first_weekday_from(F.col("_from"), weekday), F.col("_week") * 7))
        .groupBy(cols.customer, *together, SNAPSHOT)
        .agg(
            F.sum(F.when(snap.between(seen, F.col("_until")), F.col("_n"))).alias("_orders"),
            F.sum(F.when(snap.between(seen, leaves), F.col("_sum"))).alias("_spend"),
            F.sum(F.when(snap.between(seen, F.date_add("_day", short_lookback_days)), F.col("_sum"))).alias("_short"),
            F.max(F.when(snap >= seen, seen)).alias("_last"),
            F.max(F.when(snap < seen, 1).otherwise(0)).alias(TARGET),
            *([sum_or_zero(F.when(snap < seen, F.col("_sum"))).alias(future_value)] if future_value else []),
        )
        .filter(F.col("_orders") > 0)
    )
    if drop_censored:
        snapshots = snapshots.filter(F.date_add(snap, horizon_days) <= data_end)
    named = [cols.customer, SNAPSHOT, *PROPENSITY_FEATURES, TARGET, *([future_value] if future_value else [])]
    return snapshots.withColumns(_feature_columns(snap)).select(*named)


def scoring_base(
    purchases: DataFrame,
    as_of: date | datetime | None = None,
    cols: PurchaseCols = PurchaseCols(),
    lookback_days: int = 90,
    short_lookback_days: int = 30,
    one_row_per_order: bool = False,
) -> DataFrame:
    """A4: the five features of every customer active in ``[as_of - lookback, as_of]``.

    The default as-of date (A7, F10) is the day of the last purchase. The window is
    filtered on the raw time column (P8), so a literal ``as_of`` prunes partitions and row
    groups at planning time; the default is one scalar subquery, resolved before the scan.
    Purchases later on the as-of day are after midnight and therefore not yet visible.
    """
    dtype = dict(purchases.dtypes)[cols.time]
    time = F.col(cols.time)
    if as_of is not None:
        start = F.date_sub(F.lit(as_of).cast("date"), lookback_days)
    else:
        start = purchases.agg(F.date_sub(F.to_date(F.max(time)), lookback_days).alias("start")).scalar()
    anchor = F.date_add(start, lookback_days)
    short = time >= F.date_add(start, lookback_days - short_lookback_days).cast(dtype)
    orders = F.count(cols.order) if one_row_per_order else F.count_distinct(cols.order)
    return (
        purchases.filter((time >= start.cast(dtype)) & (time <= anchor.cast(dtype)) & F.col(cols.customer).isNotNull())
        .groupBy(cols.customer)
        .agg(
            orders.alias("_orders"),
            F.sum(cols.value).alias("_spend"),
            F.sum(F.when(short, F.col(cols.value))).alias("_short"),
            F.max(next_midnight(time, dtype)).alias("_last"),
        )
        .withColumns(_feature_columns(anchor))
        .select(cols.customer, *PROPENSITY_FEATURES)
    )
