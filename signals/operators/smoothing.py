"""Exponential smoothing with a weekly season as one native fold over a series' array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signals.columns import DAY, REVENUE
from signals.operators.forecast import PREDICTION

SEASON_DAYS = 7


def _step(state: Column, x: Column, alpha: float, beta: float, gamma: float) -> Column:
    """The state after one more day: level, trend, season by weekday, and the days so far with what was expected of them."""
    at = x["w"] + 1
    season = F.element_at(state["season"], at)
    expected = state["level"] + state["trend"] + season
    level = F.lit(alpha) * (x["y"] - season) + F.lit(1 - alpha) * (state["level"] + state["trend"])
    trend = F.lit(beta) * (level - state["level"]) + F.lit(1 - beta) * state["trend"]
    new = F.lit(gamma) * (x["y"] - level) + F.lit(1 - gamma) * season
    day = F.struct(x["d"].alias("d"), expected.alias("expected"), state["level"].alias("level"), season.alias("season"))
    return F.struct(
        level.alias("level"),
        trend.alias("trend"),
        F.transform(state["season"], lambda s, i: F.when(i == x["w"], new).otherwise(s)).alias("season"),
        F.concat(state["days"], F.array(day)).alias("days"),
    )


def smoothed_state(
    kpis: DataFrame, series: Sequence[str] = (), alpha: float = 0.3, beta: float = 0.05, gamma: float = 0.2
) -> DataFrame:
    """One row per series: the last ``day``, and ``state`` (level, trend, season by weekday, days).

    Additive smoothing: the first seven rows give the starting level (their mean) and season (mean distance from it by
    weekday, zero for a weekday they lack); every later row is first expected and then learned from. Series shorter than that
    are left out. A series is an array of its days, bounded by the calendar; the fold is one pass over it.
    """
    row = F.struct(F.col(DAY).alias("d"), F.col(REVENUE).cast("double").alias("y"), F.weekday(DAY).alias("w"))
    arrays = kpis.groupBy(*series).agg(F.array_sort(F.collect_list(row)).alias("h")).where(F.size("h") >= SEASON_DAYS)
    first = F.slice("h", 1, SEASON_DAYS)
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    started = arrays.withColumn("level", total(F.transform(first, lambda x: x["y"])) / F.lit(float(SEASON_DAYS)))

    def of_weekday(d: Column) -> Column:
        apart = F.transform(F.filter(first, lambda x: x["w"] == d), lambda x: x["y"] - F.col("level"))
        return F.coalesce(F.try_divide(total(apart), F.size(apart)), F.lit(0.0))

    day_type = "array<struct<d:date,expected:double,level:double,season:double>>"
    begin = F.struct(
        "level",
        F.lit(0.0).alias("trend"),
        F.transform(F.sequence(F.lit(0), F.lit(SEASON_DAYS - 1)), of_weekday).alias("season"),
        F.array().cast(day_type).alias("days"),
    )
    rest = F.slice("h", SEASON_DAYS + 1, F.greatest(F.size("h") - SEASON_DAYS, F.lit(0)))
    folded = F.aggregate(rest, F.col("begin"), lambda a, x: _step(a, x, alpha, beta, gamma))
    return started.withColumn("begin", begin).select(
        *series, F.element_at("h", -1)["d"].alias("day"), folded.alias("state")
    )


def smoothing_features(kpis: DataFrame, series: Sequence[str] = (), **weights: float) -> DataFrame:
    """``series, day, hw_expected, hw_level, hw_season`` of every row after the first seven.

    All three are known before the day's sales, so they can stand beside the lag features of a forecast.
    """
    return smoothed_state(kpis, series, **weights).select(*series, F.inline("state.days")).select(
        *series,
        F.col("d").alias(DAY),
        F.col("expected").alias("hw_expected"),
        F.col("level").alias("hw_level"),
        F.col("season").alias("hw_season"),
    )


def smoothing_forecast(kpis: DataFrame, horizon_days: int = 30, series: Sequence[str] = (), **weights: float) -> DataFrame:
    """``series, day, prediction`` for the days after each series' last: level, trend and the weekday's season."""
    ahead = smoothed_state(kpis, series, **weights).select(
        *series, "day", "state", F.explode(F.sequence(F.lit(1), F.lit(horizon_days))).alias("h")
    )
    day = F.date_add("day", F.col("h"))
    season = F.element_at("state.season", F.weekday(day) + 1)
    return ahead.select(
        *series, day.alias(DAY), (F.col("state.level") + F.col("h") * F.col("state.trend") + season).alias(PREDICTION)
    )
