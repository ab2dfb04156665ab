"""Direct forecasts four to eight weeks ahead, and their split into days.

A recursive forecast feeds on its own predictions; a direct one learns each distance by itself: a training row is an
(origin week, weeks ahead) pair, and all pairs of a series come from one pass over its array of weekly totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signals.columns import DAY, REVENUE
from signals.operators.forecast import mae, wape

WEEKS_AHEAD = 8
#: Weeks of the averages, and weeks of a year.
SHORT_WEEKS, LONG_WEEKS, YEAR_WEEKS = 4, 12, 52
FEATURES = ("horizon", "lag_0", "lag_1", "lag_2", "lag_3", "mean_4", "mean_12", "last_year", "week_of_year")
#: Naive direct models and the feature each one is.
NAIVE_DIRECT = {"naive_mean4": "mean_4", "naive_last_year": "last_year"}


def weekly_totals(kpis: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """``series, first_week, totals``: revenue of every whole week (Monday to Sunday) in order, zero without sales."""
    spans = kpis.groupBy(*series).agg(F.min(DAY).alias("lo"), F.max(DAY).alias("hi"))
    monday = F.next_day(F.date_sub("lo", 1), "MON")
    weeks = F.floor(F.date_diff(F.date_add("hi", 1), monday) / 7).cast("int")
    whole = spans.select(*series, monday.alias("first_week"), weeks.alias("weeks")).where(F.col("weeks") > 0)
    sums = kpis.groupBy(*series, F.date_trunc("week", DAY).cast("date").alias("week")).agg(F.sum(REVENUE).alias("v"))
    held = sums.groupBy(*series).agg(F.map_from_entries(F.collect_list(F.struct("week", "v"))).alias("by_week"))
    total = lambda i: F.coalesce(F.try_element_at("by_week", F.date_add("first_week", i * 7)), F.lit(0.0))
    every = F.transform(F.sequence(F.lit(0), F.col("weeks") - 1), total)
    joined = whole.join(held, list(series)) if series else whole.crossJoin(held)  # one row each without series
    return joined.select(*series, "first_week", every.alias("totals"))


def _mean(values: Column, count: int) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.lit(float(count))


def direct_rows(totals: DataFrame, series: Sequence[str] = (), weeks_ahead: int = WEEKS_AHEAD) -> DataFrame:
    """``series, origin, week, horizon``, the features, and ``target`` (null in the future) for each origin and distance.

    An origin is a week with ``LONG_WEEKS`` weeks up to and with it; features see nothing later. ``last_year`` is the week
    52 before the one forecast, the short mean where there is none.
    """
    n = F.size("totals")
    at = F.explode(F.when(n >= LONG_WEEKS, F.sequence(F.lit(LONG_WEEKS), n))).alias("at")
    origins = totals.select(*series, "first_week", "totals", at)
    lags = {f"lag_{k}": F.element_at("totals", F.col("at") - k) for k in range(SHORT_WEEKS)}
    means = {
        f"mean_{k}": _mean(F.slice("totals", F.col("at") - (k - 1), F.lit(k)), k) for k in (SHORT_WEEKS, LONG_WEEKS)
    }
    ahead = origins.withColumns({**lags, **means}).withColumn(
        "horizon", F.explode(F.sequence(F.lit(1), F.lit(weeks_ahead)))
    )
    place = F.col("at") + F.col("horizon")
    year_ago = F.when(place > YEAR_WEEKS, F.try_element_at("totals", F.greatest(F.lit(1), place - YEAR_WEEKS)))
    week = F.date_add("first_week", (place - 1) * 7)
    return ahead.select(
        *series,
        F.date_add("first_week", (F.col("at") - 1) * 7).alias("origin"),
        week.alias("week"),
        "horizon",
        *lags,
        *means,
        F.coalesce(year_ago, F.col(f"mean_{SHORT_WEEKS}")).alias("last_year"),
        F.weekofyear(week).alias("week_of_year"),
        F.try_element_at("totals", place).alias("target"),
        (F.col("at") / n).alias("age"),
    )


def naive_direct(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The naive direct models as rows (model, pred)."""
    pairs = [F.struct(F.lit(m).alias("model"), F.col(c).alias("pred")) for m, c in NAIVE_DIRECT.items()]
    return rows.select(*keep, F.inline(F.array(*pairs)))


def direct_backtest(predictions: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Errors by series, model and weeks ahead of rows (model, horizon, target, pred)."""
    known = predictions.where(F.col("target").isNotNull())
    y, p = F.col("target"), F.col("pred")
    return known.groupBy(*series, "model", "horizon").agg(
        F.count(F.lit(1)).alias("origins"), mae(y, p).alias("mae"), wape(y, p).alias("wape")
    )


def fit_direct(rows: DataFrame, regressor) -> PipelineModel:
    """Fit any MLlib regressor (features ``_features``, label ``target``) on the rows whose target is known."""
    stages = [VectorAssembler(inputCols=list(FEATURES), outputCol="_features"), regressor]
    return Pipeline(stages=stages).fit(rows.where(F.col("target").isNotNull()).select(*FEATURES, "target"))


def predict_direct(model: PipelineModel, rows: DataFrame, keep: Sequence[str], name: str) -> DataFrame:
    return model.transform(rows).select(*keep, F.lit(name).alias("model"), F.col("prediction").alias("pred"))


def latest_origin(rows: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """The rows of each series' last origin, whose targets are all still to come."""
    return rows.where(F.col("age") == 1.0)


def weekday_shares(kpis: DataFrame, series: Sequence[str] = (), weeks: int = LONG_WEEKS) -> DataFrame:
    """``series, shares``: the part of each weekday (Monday first) in the revenue of the last weeks; even shares without any."""
    last = F.max(DAY).over(Window.partitionBy(*series))
    recent = kpis.withColumn("_last", last).where(F.date_diff("_last", DAY) < 7 * weeks)
    day = [F.sum(F.when(F.weekday(DAY) == d, F.col(REVENUE)).otherwise(0.0)) for d in range(7)]
    total = F.sum(REVENUE)
    share = [F.coalesce(F.try_divide(x, total), F.lit(1 / 7)) for x in day]
    return recent.groupBy(*series).agg(F.array(*share).alias("shares"))


def reconciled_days(weekly: DataFrame, shares: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Each forecast week as seven days by weekday share; Sunday takes what is left, so days add up to their week exactly."""
    joined = weekly.join(shares, list(series)) if series else weekly.crossJoin(shares)
    part = F.transform(F.slice("shares", 1, 6), lambda s: s * F.col("pred"))
    rest = F.col("pred") - F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
    days = F.concat(part, F.array(rest))
    return joined.select(*weekly.columns, F.posexplode(days).alias("_day", "pred_day")).select(
        *weekly.columns, F.date_add("week", F.col("_day")).alias(DAY), "pred_day"
    )
