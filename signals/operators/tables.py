"""Small table operators shared by the others."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signals.functions.text import column_name


def normalise_names(df: DataFrame) -> DataFrame:
    """Rename every column by the header rule."""
    return df.toDF(*[column_name(c) for c in df.columns])


def rename_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename the columns that exist."""
    return df.withColumnsRenamed(names)


def present(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """The wanted columns the frame has, in the wanted order."""
    return [c for c in columns if c in df.columns]


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Raise before any job when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise when the frame has no rows (reads at most one)."""
    if df.isEmpty():
        raise RuntimeError(f"{what} is empty")
    return df


def first_by_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """One whole row per key, the first in ``order_by`` order.

    Ties, and the case without an order, fall back to the remaining columns, so the choice
    never depends on partitioning; null comes after every value, so a copy with a name wins over one
    without. For the first by arrival, name an ingest order. ``min_by`` combines before the shuffle: a key with many
    copies costs one partial row per task, unlike a ranking window that sorts them all.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    order = list(order_by) + [c for c in rest if c not in order_by]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])).alias("_row")
    )
    return picked.select(*keys, "_row.*").select(*df.columns)
