"""Address enrichment from a lookup cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signals.functions.text import address_key
from signals.operators.tables import first_by_key, require_columns

KEY = "endereco_norm"
CACHE_SCHEMA = f"{KEY} string, lat double, lon double"
DEFAULT_CITY = "Recife, Pernambuco, Brasil"

# A provider turns (key, query) rows into (key, lat, lon) rows; misses are simply absent.
Provider = Callable[[DataFrame], DataFrame]


def repaired_cache(cache: DataFrame, address: str) -> DataFrame:
    """Give an old cache without keys its key column."""
    if KEY in cache.columns:
        return cache.withColumn(KEY, address_key(F.col(KEY)))
    if address in cache.columns:
        return cache.withColumn(KEY, address_key(F.col(address)))
    return cache.withColumn(KEY, F.lit(""))


def address_misses(
    df: DataFrame, cache: DataFrame, address: str = "endereco", city: str = DEFAULT_CITY
) -> DataFrame:
    """Each distinct address the cache does not know, with its query text.

    Addresses are reduced to distinct keys before the anti-join, so a widely shared
    address costs one row; empty keys are never looked up.
    """
    require_columns(df, [address])
    keyed = df.select(address_key(F.col(address)).alias(KEY), F.col(address).cast("string").alias(address))
    known = keyed.filter((F.col(KEY) != "") & F.col(address).isNotNull()).distinct()
    fresh = first_by_key(known, [KEY]).join(repaired_cache(cache, address).select(KEY), KEY, "left_anti")
    return fresh.select(KEY, F.concat_ws(", ", F.col(address), F.lit(city)).alias("consulta"))


def gazetteer_provider(gazetteer: DataFrame) -> Provider:
    """G1: the default provider is a join with a table of known places, no network."""
    return lambda wanted: wanted.join(gazetteer.select(KEY, "lat", "lon"), KEY).select(KEY, "lat", "lon")


def batch_provider(lookup: Callable) -> Provider:
    """G1: a provider from a function on Arrow-backed pandas batches (key, consulta) that
    returns frames of key, lat and lon for the addresses it found."""

    def run(batches):
        for pdf in batches:
            found = lookup(pdf)
            if len(found):
                yield found[[KEY, "lat", "lon"]]

    return lambda wanted: wanted.mapInPandas(run, CACHE_SCHEMA)


def updated_cache(
    df: DataFrame, cache: DataFrame, provider: Provider, address: str = "endereco", city: str = DEFAULT_CITY
) -> DataFrame:
    """The cache with the newly found addresses; failed lookups are not kept, so
    the next run tries them again."""
    known = repaired_cache(cache, address).select(KEY, "lat", "lon").withColumn("_new", F.lit(0))
    found = provider(address_misses(df, cache, address, city)).withColumn("_new", F.lit(1))
    return first_by_key(known.unionByName(found), [KEY], ["_new"]).drop("_new")


def enrich_addresses(df: DataFrame, cache: DataFrame, address: str = "endereco") -> DataFrame:
    """Latitude and longitude per row, null when unknown.

    The cache may be of any size: Spark broadcasts it only when its measured size is under
    the session threshold, and otherwise splits the rows of a heavily shared address at
    run time.
    """
    require_columns(df, [address])
    places = first_by_key(repaired_cache(cache, address).select(KEY, "lat", "lon"), [KEY])
    return df.withColumn(KEY, address_key(F.col(address))).join(places, KEY, "left").drop(KEY)
