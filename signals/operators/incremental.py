"""Upkeep of stored tables when new rows arrive: the training panel and the address cache."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signals.columns import SNAPSHOT, PurchaseCols
from signals.functions.calendar import first_weekday_from, next_midnight, week_numbers
from signals.operators.enrich import KEY, Provider, address_misses, repaired_cache
from signals.operators.panel import propensity_panel
from signals.operators.tables import first_by_key
from signals.sources.scratch import shuffles_dropped, write_once

# Snapshots written anew at once, and keys sent to all tasks at most.
SNAPSHOTS_AT_ONCE = 26
BROADCAST_KEYS = 500_000


def touched_snapshots(
    arrived: DataFrame, cols: PurchaseCols, last_day: date, horizon_days: int, lookback_days: int, weekday: str
) -> list[date]:
    """The snapshots whose features or labels some of the arrived purchases can change, bounded by the weeks of the calendar."""
    kind = dict(arrived.dtypes)[cols.time]
    days = arrived.na.drop(subset=[cols.customer, cols.order, cols.time]).select(
        F.date_sub(next_midnight(F.col(cols.time), kind), horizon_days).alias("a"),
        F.least(F.date_add(F.to_date(cols.time), lookback_days), F.lit(last_day)).alias("b"),
    )
    weeks = days.distinct().select("a", F.explode(week_numbers(F.col("a"), F.col("b"), weekday)).alias("w"))
    dates = weeks.select(F.date_add(first_weekday_from(F.col("a"), weekday), F.col("w") * 7).alias("d")).distinct()
    return sorted(r["d"] for r in dates.collect())


def refresh_panel(
    spark: SparkSession,
    path: str,
    purchases: DataFrame,
    arrived: DataFrame,
    cols: PurchaseCols = PurchaseCols(),
    horizon_days: int = 30,
    lookback_days: int = 90,
    short_lookback_days: int = 30,
    weekday: str = "MON",
    one_row_per_order: bool = False,
) -> list[date]:
    """Bring a panel stored by snapshot up to date with purchases that arrived; returns the snapshots written anew.

    ``purchases`` are all purchases, the arrived ones among them, late ones too. Only partitions that an arrived purchase
    can touch are rewritten, and in them only the customers who bought are computed again, from their own purchases near those
    snapshots; all other rows are copied. Snapshots after the stored ones are computed for everyone. ``SNAPSHOTS_AT_ONCE``
    are written aside together and then replace the old ones one by one, so beside the panel only these need disk, and a run
    that was cut off can be run again. The result equals a panel built from all purchases. Of all purchases one column is
    read whole, for the end of the data.
    """
    stored = spark.read.parquet(path)
    last_day = purchases.agg(F.max(F.to_date(cols.time)).alias("d")).first()["d"]
    newest = stored.agg(F.max(SNAPSHOT).alias("d")).first()["d"]
    if last_day is None or arrived.isEmpty():
        return []
    reach = (cols, last_day, horizon_days, lookback_days, weekday)
    old = [d for d in touched_snapshots(arrived, *reach) if newest is not None and d <= newest]
    ahead = purchases if newest is None else purchases.where(F.to_date(cols.time) >= F.date_sub(F.lit(newest), lookback_days))
    new = [d for d in touched_snapshots(ahead, *reach) if newest is None or d > newest]
    sizes = {
        "horizon_days": horizon_days,
        "lookback_days": lookback_days,
        "short_lookback_days": short_lookback_days,
        "weekday": weekday,
        "one_row_per_order": one_row_per_order,
        "last_day": last_day,
    }
    if old:
        buyers = write_once(arrived.select(cols.customer).where(F.col(cols.customer).isNotNull()).distinct())
        buyers = F.broadcast(buyers) if buyers.count() <= BROADCAST_KEYS else buyers
        own = write_once(purchases.join(buyers, cols.customer, "left_semi"))
    for i in range(0, len(old), SNAPSHOTS_AT_ONCE):
        some = old[i : i + SNAPSHOTS_AT_ONCE]
        again = propensity_panel(own, cols, between=(some[0], some[-1]), **sizes).where(F.col(SNAPSHOT).isin(some))
        copied = stored.where(F.col(SNAPSHOT).isin(some)).join(buyers, cols.customer, "left_anti")
        replace_snapshots(path, again.unionByName(copied.select(*again.columns)))
    for i in range(0, len(new), SNAPSHOTS_AT_ONCE):
        some = new[i : i + SNAPSHOTS_AT_ONCE]
        replace_snapshots(path, propensity_panel(purchases, cols, between=(some[0], some[-1]), **sizes))
    if not old and not new:
        return []
    written = spark.read.schema(stored.schema).parquet(path).where(F.col(SNAPSHOT).isin(old + new))
    return sorted(r[SNAPSHOT] for r in written.select(SNAPSHOT).distinct().collect())


def replace_snapshots(path: str, rows: DataFrame) -> None:
    """Replace the partitions that have rows here; the rows may come from the same table, as nothing is replaced before all are written."""
    with shuffles_dropped(rows.sparkSession):
        writer = rows.hint("rebalance", SNAPSHOT).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(SNAPSHOT).parquet(path)


def append_to_cache(
    spark: SparkSession, path: str, df: DataFrame, provider: Provider, address: str = "endereco", city: str = ""
) -> DataFrame:
    """Look up the addresses a stored cache does not know and append those found; returns the appended rows.

    Nothing already stored is read but the keys, and nothing is written again. Failed lookups are not kept.
    """
    cache = repaired_cache(spark.read.parquet(path), address)
    found = first_by_key(provider(address_misses(df, cache, address, city)), [KEY])
    fresh = write_once(found.select(KEY, "lat", "lon"))
    fresh.write.mode("append").parquet(path)
    return fresh
