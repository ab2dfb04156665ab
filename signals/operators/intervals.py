"""Forecast intervals from the errors of walk-forward forecasts (split-conformal bounds).

A forecast is repeated from the origin of every fold on the rows before it, and its errors are kept by horizon
day. The bound of a horizon is a rank among the absolute errors of the earlier folds; the later folds tell how often it holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signals.columns import DAY, REVENUE
from signals.operators.forecast import HISTORY_ROWS, NAIVE_MODELS, PREDICTION, naive_forecast
from signals.operators.splits import with_positions

# A forecast of all series given, by these key columns: (rows, keys) to (keys, day, prediction).
Forecaster = Callable[[DataFrame, Sequence[str]], DataFrame]


def naive_forecasters(horizon_days: int = 30) -> dict[str, Forecaster]:
    """The recursive naive models as forecasters."""
    return {kind: lambda rows, keys, kind=kind: naive_forecast(rows, kind, horizon_days, keys) for kind in NAIVE_MODELS}


def fold_histories(
    kpis: DataFrame,
    series: Sequence[str] = (),
    initial_ratio: float = 0.6,
    test_size: int = 30,
    step: int = 30,
    history_rows: int = HISTORY_ROWS,
) -> DataFrame:
    """Each row once per walk-forward fold whose forecast looks back on it, numbered in ``fold``.

    Fold f starts at row ``initial + (f - 1) * step`` of its series; only the last ``history_rows`` rows before are kept, so
    the rows are multiplied by at most ``history_rows / step`` and one more. Folds follow from row positions, without a join.
    """
    placed = with_positions(kpis, DAY, series)
    initial = F.floor(F.col("_n") * F.lit(initial_ratio)).cast("int")
    folds = F.floor((F.col("_n") - test_size - initial) / step).cast("int") + 1
    after = F.greatest(F.lit(1), F.floor((F.col("_pos") - initial) / step).cast("int") + 2)
    until = F.least(folds, F.floor((F.col("_pos") + history_rows - initial) / step).cast("int") + 1)
    numbers = F.when(after <= until, F.sequence(after, until))
    return placed.withColumn("fold", F.explode(numbers)).drop("_pos", "_n")


def horizon_errors(
    kpis: DataFrame,
    forecasters: dict[str, Forecaster],
    series: Sequence[str] = (),
    initial_ratio: float = 0.6,
    test_size: int = 30,
    step: int = 30,
    history_rows: int = HISTORY_ROWS,
) -> DataFrame:
    """``series, model, fold, horizon, actual, pred`` of every forecast day that had sales.

    Folds are further series to a forecaster, so all of them are forecast in one pass.
    """
    keys = [*series, "fold"]
    histories = fold_histories(kpis, series, initial_ratio, test_size, step, history_rows)
    first = F.min(DAY).over(Window.partitionBy(*keys))
    actual = kpis.select(*series, DAY, F.col(REVENUE).alias("actual"))
    every = None
    for name, forecast in forecasters.items():
        rows = forecast(histories, keys).withColumn("horizon", F.date_diff(DAY, first) + 1)
        found = rows.join(actual, [*series, DAY]).select(
            *series, F.lit(name).alias("model"), "fold", "horizon", "actual", F.col(PREDICTION).alias("pred")
        )
        every = found if every is None else every.unionByName(found)
    return every


def conformal_bounds(
    errors: DataFrame, by: Sequence[str], alpha: float = 0.1, calibration: float = 0.7
) -> DataFrame:
    """``by, bound, n, tested, coverage``: half widths that hold with the chance ``1 - alpha``, and how often they did.

    The bound is the ``ceil((n + 1) * (1 - alpha))``-th smallest absolute error of the first ``calibration`` part of a
    group's folds, null if there are too few; ``coverage`` is the share of the ``tested`` later errors within it. A group has one
    error a fold, which the calendar bounds, so exact ranks need no more than one short array.
    """
    error = F.struct("fold", F.abs(F.col("actual") - F.col("pred")).alias("e"))
    grouped = errors.groupBy(*by).agg(F.collect_list(error).alias("es"), F.max("fold").alias("folds"))
    cut = F.floor(F.col("folds") * F.lit(calibration))
    sizes = lambda keep: F.transform(F.filter("es", keep), lambda x: x["e"])
    ranked = grouped.select(
        *by,
        F.array_sort(sizes(lambda x: x["fold"] <= cut)).alias("known"),
        sizes(lambda x: x["fold"] > cut).alias("later"),
    )
    rank = F.ceil((F.size("known") + 1) * F.lit(1 - alpha)).cast("int")
    bounded = ranked.withColumn("bound", F.when(rank <= F.size("known"), F.try_element_at("known", rank)))
    within = F.size(F.filter("later", lambda e: e <= F.col("bound")))
    return bounded.select(
        *by,
        "bound",
        F.size("known").alias("n"),
        F.size("later").alias("tested"),
        F.when(F.col("bound").isNotNull(), F.try_divide(within, F.size("later"))).alias("coverage"),
    )


def pooled_bounds(errors: DataFrame, by: Sequence[str], alpha: float = 0.1, accuracy: int = 10_000) -> DataFrame:
    """``by, bound, n``: relative half widths from the errors of all series together.

    For many short series, none of which has enough folds of its own. Errors are divided by the forecast; the quantile is a
    sketch that tasks merge, so a group may hold any number of series.
    """
    relative = errors.select(*by, F.try_divide(F.abs(F.col("actual") - F.col("pred")), F.abs(F.col("pred"))).alias("e"))
    quantile = F.percentile_approx("e", 1 - alpha, accuracy)
    return relative.where(F.col("e").isNotNull()).groupBy(*by).agg(quantile.alias("bound"), F.count("e").alias("n"))


def with_bounds(forecast: DataFrame, bounds: DataFrame, by: Sequence[str], half: Column | None = None) -> DataFrame:
    """Adds ``lower`` (not below zero) and ``upper`` to forecast rows that carry the columns ``by``."""
    width = half if half is not None else F.col("bound")
    return forecast.join(bounds, list(by), "left").withColumns(
        {
            "lower": F.when(width.isNotNull(), F.greatest(F.lit(0.0), F.col(PREDICTION) - width)),
            "upper": F.col(PREDICTION) + width,
        }
    )


def with_horizon(forecast: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Adds ``horizon``, the number of the forecast day, from 1."""
    first = F.min(DAY).over(Window.partitionBy(*series))
    return forecast.withColumn("horizon", F.date_diff(DAY, first) + 1)


def forecast_interval(
    kpis: DataFrame,
    forecasters: dict[str, Forecaster],
    series: Sequence[str] = (),
    alpha: float = 0.1,
    calibration: float = 0.7,
    initial_ratio: float = 0.6,
    test_size: int = 30,
    step: int = 30,
    pooled: bool = False,
    history_rows: int = HISTORY_ROWS,
) -> DataFrame:
    """The forecast of every series and model with ``lower`` and ``upper`` bounds by horizon day.

    Forecasters see ``history_rows`` rows before an origin, the recursive ones need no more than the default. ``n`` errors stand behind a bound; ``tested`` later ones were within it with the share ``coverage``. ``pooled``
    takes one relative bound a model and horizon for all series instead, from all folds. Days without sales
    have no error; a series too short for enough folds gets null bounds.
    """
    errors = horizon_errors(kpis, forecasters, series, initial_ratio, test_size, step, history_rows)
    by = ["model", "horizon"] if pooled else [*series, "model", "horizon"]
    bounds = pooled_bounds(errors, by, alpha) if pooled else conformal_bounds(errors, by, alpha, calibration)
    out = None
    for name, forecast in forecasters.items():
        rows = with_horizon(forecast(kpis, series), series).withColumn("model", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    half = F.col("bound") * F.abs(F.col(PREDICTION)) if pooled else None
    return with_bounds(out, bounds, by, half)
