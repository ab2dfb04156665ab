"""Time-ordered train/test splits and walk-forward folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLIT = "split"


def cutoff_date(df: DataFrame, date_col: str, train_ratio: float = 0.8) -> Column:
    """The last training date: the ``max(1, int(n * ratio))``-th distinct date, as a scalar.

    Only DATE columns are accepted, so the distinct values are bounded by the calendar and
    their sorted array is small however many rows there are.
    """
    if dict(df.dtypes)[date_col] != "date":
        raise TypeError(f"{date_col} must be a date; truncate it first")
    dates = df.agg(F.array_sort(F.collect_set(date_col)).alias("dates"))
    position = F.greatest(F.lit(1), F.floor(F.size("dates") * F.lit(train_ratio)).cast("int"))
    return dates.select(F.try_element_at("dates", position).alias("cutoff")).scalar()


def split_by_date(
    df: DataFrame, date_col: str = "snapshot_date", train_ratio: float = 0.8, embargo_days: int = 0
) -> DataFrame:
    """Add ``split`` = train up to the cutoff date, test after it.

    ``embargo_days`` drops training dates whose label window reaches past the cutoff.
    """
    cutoff = cutoff_date(df, date_col, train_ratio)
    out = df.withColumn(SPLIT, F.when(F.col(date_col) <= cutoff, "train").otherwise("test"))
    if embargo_days:
        out = out.filter((F.col(SPLIT) == "test") | (F.date_add(date_col, embargo_days) <= cutoff))
    return out


def split_by_rows(
    df: DataFrame, order_col: str, series: Sequence[str] = (), train_ratio: float = 0.8, at_least: int = 1
) -> DataFrame:
    """Add ``split`` by row position within each (calendar-sized) series."""
    w = Window.partitionBy(*series)
    n_train = F.greatest(F.lit(at_least), F.floor(F.count(F.lit(1)).over(w) * F.lit(train_ratio)))
    position = F.row_number().over(w.orderBy(order_col))
    return df.withColumn(SPLIT, F.when(position <= n_train, "train").otherwise("test"))


def training_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(SPLIT) == "train").drop(SPLIT)


def held_out_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(SPLIT) == "test").drop(SPLIT)


def walk_forward_folds(
    df: DataFrame,
    series: Sequence[str] = (),
    initial_ratio: float = 0.6,
    test_size: int = 30,
    step: int = 30,
) -> DataFrame:
    """Expanding-window folds of every series as row ranges ``[start, end)``.

    The first test range starts at ``int(n * initial_ratio)``; an incomplete last fold is
    dropped.
    """
    sizes = df.groupBy(*series).agg(F.count(F.lit(1)).cast("int").alias("n"))
    initial = F.floor(F.col("n") * F.lit(initial_ratio)).cast("int")
    last = F.col("n") - F.lit(test_size)
    starts = F.when(initial <= last, F.sequence(initial, last, F.lit(step)))
    return sizes.select(*series, F.posexplode(starts).alias("fold", "start")).select(
        *series,
        (F.col("fold") + 1).alias("fold"),
        F.lit(0).alias("train_start"),
        F.col("start").alias("train_end"),
        F.col("start").alias("test_start"),
        (F.col("start") + test_size).alias("test_end"),
    )


def with_positions(df: DataFrame, order_col: str, series: Sequence[str] = ()) -> DataFrame:
    """Zero-based row position and row count of each (calendar-sized) series."""
    w = Window.partitionBy(*series)
    return df.withColumns(
        {
            "_pos": F.row_number().over(w.orderBy(order_col)) - 1,
            "_n": F.count(F.lit(1)).over(w).cast("int"),
        }
    )


def fold_start(fold: Column | int, initial_ratio: float, step: int) -> Column:
    """First test position of a fold, for rows that carry their series size ``_n``."""
    initial = F.floor(F.col("_n") * F.lit(initial_ratio)).cast("int")
    return initial + (F.lit(fold) - 1) * step if isinstance(fold, int) else initial + (fold - 1) * step


def fold_rows(
    positioned: DataFrame, initial_ratio: float = 0.6, test_size: int = 30, step: int = 30
) -> DataFrame:
    """Every row once per fold that tests it.

    The fold numbers follow from the row position, so no join between folds and rows is
    needed: fold ``f`` tests positions ``[s, s + test_size)`` with ``s = initial + (f-1) * step``.
    """
    initial = F.floor(F.col("_n") * F.lit(initial_ratio)).cast("int")
    offset = F.col("_pos") - initial
    newest = F.floor(offset / step).cast("int") + 1
    oldest = F.greatest(F.lit(1), F.floor((offset - test_size) / step).cast("int") + 2)
    complete = F.floor((F.col("_n") - test_size - initial) / step).cast("int") + 1
    last = F.least(newest, complete)
    folds = F.when((offset >= 0) & (oldest <= last), F.sequence(oldest, last))
    return positioned.withColumn("fold", F.explode(folds))
