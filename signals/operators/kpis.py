"""Daily business indicators and their rolling features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signals.columns import DAILY_DRIVERS, DAY, REVENUE, FactoryCols, PurchaseCols
from signals.functions.calendar import calendar_parts, day_of
from signals.functions.numeric import ratio, sum_or_zero


def daily_kpis(
    purchases: DataFrame,
    factory_orders: DataFrame | None = None,
    cols: PurchaseCols = PurchaseCols(),
    factory: FactoryCols = FactoryCols(),
    series: Sequence[str] = (),
    one_row_per_order: bool = False,
) -> DataFrame:
    """A2: revenue, orders, customers, average ticket and factory value per day.

    Both tables are reduced to one row per (series, day) before they meet (J2), so the
    join is between calendar-sized tables whatever the input size. Factory value on days
    without sales is dropped. ``series`` columns split the indicators into many series.

    Two distinct counts make Spark triple their rows, so the lines of an order are first summed;
    ``one_row_per_order`` (tables keyed by order) leaves one distinct count, whose rows combine to one per
    day and customer inside each task.
    """
    orders = F.count(cols.order) if one_row_per_order else F.count_distinct(cols.order)
    keys = [*series, DAY]
    lines = purchases.filter(F.col(cols.time).isNotNull()).withColumn(DAY, day_of(F.col(cols.time)))
    if not one_row_per_order:
        lines = lines.groupBy(*keys, cols.order, cols.customer).agg(F.sum(cols.value).alias(cols.value))
    sales = (
        lines.groupBy(*keys)
        .agg(
            sum_or_zero(F.col(cols.value)).alias(REVENUE),
            orders.alias("numero_pedidos"),
            F.count_distinct(cols.customer).alias("clientes_unicos"),
        )
        .withColumn("ticket_medio", ratio(F.col(REVENUE), F.col("numero_pedidos")))
    )
    if factory_orders is None or factory.value not in factory_orders.columns:
        return sales.withColumn("valor_pedido_fabrica", F.lit(0.0))
    supplied = (
        factory_orders.filter(F.col(factory.time).isNotNull())
        .withColumn(DAY, day_of(F.col(factory.time)))
        .groupBy(*keys)
        .agg(sum_or_zero(F.col(factory.value)).alias("valor_pedido_fabrica"))
    )
    return sales.join(supplied, keys, "left").na.fill(0.0, ["valor_pedido_fabrica"])


def fill_calendar(kpis: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Add the days without sales as zero rows, from first to last day of each series.

    The default everywhere is one row per day that had sales; this is the option for
    callers who want lags to mean calendar days.
    """
    calendar = (
        kpis.groupBy(*series)
        .agg(F.min(DAY).alias("lo"), F.max(DAY).alias("hi"))
        .select(*series, F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias(DAY))
    )
    return calendar.join(kpis, [*series, DAY], "left").na.fill(0, [REVENUE, *DAILY_DRIVERS])


def daily_features(kpis: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Calendar parts and trailing 7- and 30-row mean revenue."""
    w = Window.partitionBy(*series).orderBy(DAY)
    return kpis.withColumns(
        {
            **calendar_parts(DAY),
            "fat_rolling_7": F.avg(REVENUE).over(w.rowsBetween(-6, 0)),
            "fat_rolling_30": F.avg(REVENUE).over(w.rowsBetween(-29, 0)),
        }
    )
