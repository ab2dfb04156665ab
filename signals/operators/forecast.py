"""Revenue forecasting over many daily series.

A series is one row per day that had sales, so every window and array below is bounded by
the calendar; parallelism comes from the number of series. ``series=()`` is one series.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signals.columns import DAILY_DRIVERS, DAY, REVENUE
from signals.functions.calendar import calendar_features
from signals.functions.numeric import ratio_or_zero
from signals.operators.splits import SPLIT, fold_rows, fold_start, split_by_rows, with_positions
from signals.sources.scratch import write_once

# Windows of the forecast features.
LAGS = (1, 7, 14, 21, 28)
WINDOWS = (7, 14, 30)
HISTORY_ROWS = 30
DRIVER_ROWS = 7
CALENDAR_FEATURES = (
    "dia_semana",
    "mes",
    "ano",
    "semana_ano",
    "is_weekend",
    "is_month_start",
    "is_month_end",
)
HISTORY_FEATURES = (
    *[f"fat_lag_{k}" for k in LAGS],
    *[f"fat_roll_mean_{w}" for w in WINDOWS],
    *[f"fat_roll_std_{w}" for w in WINDOWS],
)
# The drivers of the same day nearly determine its revenue, so scores with them look far
# better than any real forecast; the second list leaves them out.
FORECAST_FEATURES = (*CALENDAR_FEATURES, *DAILY_DRIVERS, *HISTORY_FEATURES)
LEAK_FREE_FEATURES = (*CALENDAR_FEATURES, *HISTORY_FEATURES)
NAIVE_MODELS = {"naive_lag7": "fat_lag_7", "naive_rolling7": "fat_roll_mean_7"}
LEARNED_MODELS = ("random_forest", "gbt")
PREDICTION = "pred_faturamento"
SELECTION_CRITERIA = "min_wape_mean_backtest_ml_only"


def forecast_features(kpis: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Calendar, lags and prior-row rolling features; warm-up rows dropped."""
    w = Window.partitionBy(*series).orderBy(DAY)
    columns = calendar_features(DAY)
    for k in LAGS:
        columns[f"fat_lag_{k}"] = F.lag(REVENUE, k).over(w)
    for n in WINDOWS:
        prior = w.rowsBetween(-n, -1)
        columns[f"fat_roll_mean_{n}"] = F.avg(REVENUE).over(prior)
        columns[f"fat_roll_std_{n}"] = F.coalesce(F.stddev_pop(REVENUE).over(prior), F.lit(0.0))
    return kpis.withColumns(columns).na.drop("any")


# --- errors -----------------------------------------------------------------------------


def mae(y: Column, p: Column) -> Column:
    """E1."""
    return F.avg(F.abs(y - p))


def mape(y: Column, p: Column) -> Column:
    """Rows with a zero actual are left out."""
    return F.avg(F.try_divide(F.abs(y - p), F.abs(y)))


def wape(y: Column, p: Column) -> Column:
    """0 when the actuals sum to zero."""
    return ratio_or_zero(F.sum(F.abs(y - p)), F.sum(F.abs(y)))


def error_table(predictions: DataFrame, by: Sequence[str], actual: str = REVENUE, pred: str = PREDICTION) -> DataFrame:
    """E1-E3 per group."""
    y, p = F.col(actual), F.col(pred)
    return predictions.groupBy(*by).agg(mae(y, p).alias("mae"), mape(y, p).alias("mape"), wape(y, p).alias("wape"))


def _is_naive(model: str = "model") -> Column:
    """P12."""
    return F.col(model).startswith("naive_")


def _gain_over_naive(df: DataFrame, value: str, name: str, series: Sequence[str]) -> DataFrame:
    """Best naive error of the series minus the row's error (a handful of rows per series)."""
    best = F.min(F.when(_is_naive(), F.col(value))).over(Window.partitionBy(*series))
    return df.withColumn(name, best - F.col(value))


# --- models -----------------------------------------------------------------------------


def naive_predictions(features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """M9: the two naive forecasts as rows; they are columns of the feature table already."""
    pairs = [F.struct(F.lit(m).alias("model"), F.col(c).alias(PREDICTION)) for m, c in NAIVE_MODELS.items()]
    return features.select(*keep, DAY, REVENUE, F.inline(F.array(*pairs)))


def regressors(
    forest_trees: int = 500, forest_depth: int = 12, boost_rounds: int = 600, boost_depth: int = 6, seed: int = 42
) -> dict[str, Callable[[], RandomForestRegressor | GBTRegressor]]:
    """The learned models; sizes are parameters."""
    return {
        "random_forest": lambda: RandomForestRegressor(
            featuresCol="_features",
            labelCol=REVENUE,
            numTrees=forest_trees,
            maxDepth=forest_depth,
            featureSubsetStrategy="all",
            seed=seed,
        ),
        "gbt": lambda: GBTRegressor(
            featuresCol="_features",
            labelCol=REVENUE,
            maxIter=boost_rounds,
            maxDepth=boost_depth,
            stepSize=0.03,
            subsamplingRate=0.9,
            featureSubsetStrategy="0.9",
            seed=seed,
        ),
    }


def fit_regressor(train: DataFrame, regressor, features: Sequence[str] = FORECAST_FEATURES) -> PipelineModel:
    stages = [VectorAssembler(inputCols=list(features), outputCol="_features"), regressor]
    return Pipeline(stages=stages).fit(train.select(*features, REVENUE))


def predict_with(model: PipelineModel, df: DataFrame, name: str = PREDICTION) -> DataFrame:
    return model.transform(df).select(*df.columns, F.col("prediction").alias(name))


def train_candidates(
    train: DataFrame, models: Mapping[str, Callable], features: Sequence[str] = FORECAST_FEATURES
) -> dict[str, PipelineModel]:
    """Fit each model on the training rows of all series; fits are submitted together."""
    with ThreadPoolExecutor(max_workers=max(1, len(models))) as pool:
        jobs = {name: pool.submit(fit_regressor, train, make(), features) for name, make in models.items()}
        return {name: job.result() for name, job in jobs.items()}


def holdout_predictions(
    test: DataFrame, fitted: Mapping[str, PipelineModel], series: Sequence[str] = ()
) -> DataFrame:
    """Naive and learned predictions of the held-out rows in long form."""
    out = naive_predictions(test, series)
    for name, model in fitted.items():
        rows = predict_with(model, test).withColumn("model", F.lit(name))
        out = out.unionByName(rows.select(*out.columns))
    return out


def comparison(predictions: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Errors per model with the gain over the best naive model."""
    table = error_table(predictions, [*series, "model"])
    return _gain_over_naive(table, "wape", "wape_uplift_vs_baseline", series)


def best_by(table: DataFrame, value: str, candidates: Sequence[str] | None = None, series: Sequence[str] = ()) -> DataFrame:
    """The model with the least error per series, ties by name."""
    eligible = table.filter(F.col("model").isin(*candidates)) if candidates is not None else table
    best = F.min_by("model", F.struct(value, "model")).alias("model")
    return eligible.groupBy(*series).agg(best).filter(F.col("model").isNotNull())


def production_metrics(
    table: DataFrame,
    split: DataFrame,
    candidates: Sequence[str] | None = LEARNED_MODELS,
    series: Sequence[str] = (),
) -> DataFrame:
    """The best candidate's errors with split sizes and date bounds (one row per series)."""
    train, test = F.col(SPLIT) == "train", F.col(SPLIT) == "test"

    def day(agg: Callable, part: Column) -> Column:
        return agg(F.when(part, F.col(DAY)))

    sides = [
        F.count_if(train).alias("train_rows"),
        F.count_if(test).alias("test_rows"),
        day(F.min, train).alias("train_start"),
        day(F.max, train).alias("train_end"),
        day(F.min, test).alias("test_start"),
        day(F.max, test).alias("test_end"),
    ]
    eligible = table.filter(F.col("model").isin(*candidates)) if candidates is not None else table
    place = F.row_number().over(Window.partitionBy(*series).orderBy("wape", "model"))
    best = (
        eligible.withColumn("_place", place)
        .filter(F.col("_place") == 1)
        .drop("_place")
        .withColumnRenamed("wape_uplift_vs_baseline", "wape_uplift_vs_best_baseline")
    )
    if series:
        return best.join(split.groupBy(*series).agg(*sides), list(series))
    whole = split.agg(F.struct(*sides).alias("s")).scalar()
    return best.withColumn("_s", whole).select(*best.columns, "_s.*")


# --- backtest ---------------------------------------------------------------------------


def naive_backtest(
    features: DataFrame,
    series: Sequence[str] = (),
    initial_ratio: float = 0.6,
    test_size: int = 30,
    step: int = 30,
) -> DataFrame:
    """Errors of the naive models for all folds of all series in one aggregate."""
    tested = fold_rows(with_positions(features, DAY, series), initial_ratio, test_size, step)
    return error_table(naive_predictions(tested, [*series, "fold"]), [*series, "model", "fold"])


def learned_backtest(
    features: DataFrame,
    models: Mapping[str, Callable],
    series: Sequence[str] = (),
    feature_cols: Sequence[str] = FORECAST_FEATURES,
    initial_ratio: float = 0.6,
    test_size: int = 30,
    step: int = 30,
    parallel_fits: int = 4,
) -> DataFrame:
    """Errors of the learned models, one fit per (model, fold) on all series pooled.

    Series differ in length and start, so a fold trains on the days before the earliest day that any
    series tests in it: no row of one series is later than a tested day of another. Rows with their positions and
    folds are written once, and a fold reads its part. Fits run from a small driver pool; every fit is
    itself a distributed job.
    """
    rows = write_once(with_positions(features, DAY, series))
    tested = write_once(fold_rows(rows, initial_ratio, test_size, step))
    first_days = tested.groupBy("fold").agg(F.min(DAY).alias("d"))
    begins = {r["fold"]: r["d"] for r in first_days.collect()}  # one row per fold
    keep = [*series, "fold", DAY, REVENUE, "model", PREDICTION]

    def run(name: str, make: Callable, fold: int) -> DataFrame | None:
        train = rows.filter(F.col(DAY) < F.lit(begins[fold]))
        if train.isEmpty():
            return None
        model = fit_regressor(train, make(), feature_cols)
        out = predict_with(model, tested.filter(F.col("fold") == fold))
        return out.withColumn("model", F.lit(name)).select(*keep)

    with ThreadPoolExecutor(max_workers=parallel_fits) as pool:
        jobs = [pool.submit(run, n, m, f) for n, m in models.items() for f in sorted(begins)]
        parts = [part for part in (job.result() for job in jobs) if part is not None]
    if not parts:
        none = rows.withColumns({"fold": F.lit(0), "model": F.lit(""), PREDICTION: F.lit(0.0)})
        return error_table(none.select(*keep).limit(0), [*series, "model", "fold"])
    predictions = parts[0]
    for part in parts[1:]:
        predictions = predictions.unionByName(part)
    return error_table(predictions, [*series, "model", "fold"])


def backtest_summary(detail: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Mean and sample deviation over folds, gain over the best naive model."""
    spread = [
        stat(m).alias(f"{m}_{suffix}")
        for m in ("mae", "mape", "wape")
        for suffix, stat in (("mean", F.avg), ("std", F.stddev_samp))
    ]
    table = detail.groupBy(*series, "model").agg(F.count("fold").alias("folds"), *spread)
    return _gain_over_naive(table, "wape_mean", "wape_uplift_vs_best_baseline", series)


def model_selection(
    summary: DataFrame,
    candidates: Sequence[str] = LEARNED_MODELS,
    artifact_root: str = "models",
    series: Sequence[str] = (),
    criteria: str = SELECTION_CRITERIA,
) -> DataFrame:
    """The production model of each series and where its file is."""
    return best_by(summary, "wape_mean", candidates, series).select(
        *series,
        F.col("model").alias("selected_model"),
        F.lit(criteria).alias("criteria"),
        F.concat(F.lit(artifact_root.rstrip("/") + "/"), F.col("model")).alias("artifact"),
    )


# --- recursive forecast -----------------------------------------------------------------
# These expressions are SQL text: a step has dozens of them, and text is one call each.


def _tail(values: str, n: int) -> str:
    """The last n elements, or all of them."""
    return f"slice({values}, greatest(size({values}) - {n - 1}, 1), {n})"


def _mean(values: str) -> str:
    """Mean of the values that are there; null without any."""
    start, add = "named_struct('s', 0D, 'n', 0)", "named_struct('s', a.s + coalesce(x, 0D), 'n', a.n + int(x IS NOT NULL))"
    return f"aggregate({values}, {start}, (a, x) -> {add}, a -> a.s / nullif(a.n, 0))"


def _spread(values: str, mean: str) -> str:
    """Population standard deviation; 0 for a single value."""
    return f"sqrt(aggregate({values}, 0D, (a, x) -> a + pow(x - {mean}, 2), a -> a / size({values})))"


def _from_end(values: str, k: int) -> str:
    """The k-th value from the end, or the last one in a shorter history."""
    return f"coalesce(try_element_at({values}, -{k}), try_element_at({values}, -1))"


def _field(rows: str, name: str) -> Column:
    """One field of an array of rows, as an array."""
    return F.transform(rows, lambda r: r[name])


def series_state(kpis: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """One row per series: its last day, last 30 revenues and last 7 values of each driver."""
    newest = Window.partitionBy(*series).orderBy(F.col(DAY).desc())
    recent = kpis.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= HISTORY_ROWS)
    row = F.struct(DAY, *[F.col(c).cast("double").alias(c) for c in (REVENUE, *DAILY_DRIVERS)])
    rows = recent.groupBy(*series).agg(F.array_sort(F.collect_list(row)).alias("h"))
    full = rows.filter(F.size("h") > 0).select(
        *series,
        F.element_at("h", -1)[DAY].alias(DAY),
        _field("h", REVENUE).alias("history"),
        *[_field("h", d).alias(f"h_{d}") for d in DAILY_DRIVERS],
    )
    return full.withColumns({f"h_{d}": F.expr(_tail(f"h_{d}", DRIVER_ROWS)) for d in DAILY_DRIVERS})


def next_day_features(state: DataFrame) -> DataFrame:
    """Move the state one day ahead and add that day's feature row."""
    ahead = state.withColumn(DAY, F.date_add(DAY, 1))
    lags = [f"{_from_end('history', k)} AS fat_lag_{k}" for k in LAGS]
    means = [f"{_mean(_tail('history', n))} AS fat_roll_mean_{n}" for n in WINDOWS]
    drivers = [f"{_mean(f'h_{d}')} AS {d}" for d in DAILY_DRIVERS]
    calendar = [
        f"weekday({DAY}) AS dia_semana",
        f"month({DAY}) AS mes",
        f"year({DAY}) AS ano",
        f"weekofyear({DAY}) AS semana_ano",
        f"int(weekday({DAY}) >= 5) AS is_weekend",
        f"int(day({DAY}) = 1) AS is_month_start",
        f"int(last_day({DAY}) = {DAY}) AS is_month_end",
    ]
    first = ahead.selectExpr("*", *calendar, *drivers, *lags, *means)
    spreads = [f"{_spread(_tail('history', n), f'fat_roll_mean_{n}')} AS fat_roll_std_{n}" for n in WINDOWS]
    return first.selectExpr("*", *spreads)


def recursive_forecast(
    kpis: DataFrame,
    model: PipelineModel,
    horizon_days: int = 30,
    series: Sequence[str] = (),
    write_every: int = 10,
) -> DataFrame:
    """Predict a day, append it to the history, repeat.

    The state is one row per series holding short arrays, so each step is a narrow
    projection: no shuffle after the state is built. The growing plan is cut every
    ``write_every`` steps by writing the state.
    """
    nothing = F.array().cast(f"array<struct<{DAY}:date,{PREDICTION}:double>>")
    state = series_state(kpis, series).withColumn("path", nothing)
    appended = [
        f"{_tail('concat(history, array(prediction))', HISTORY_ROWS)} AS history",
        *[f"{_tail(f'concat(h_{d}, array({d}))', DRIVER_ROWS)} AS h_{d}" for d in DAILY_DRIVERS],
        f"concat(path, array(named_struct('{DAY}', {DAY}, '{PREDICTION}', prediction))) AS path",
    ]
    for step in range(1, horizon_days + 1):
        state = model.transform(next_day_features(state)).selectExpr(*series, DAY, *appended)
        if step % write_every == 0 and step < horizon_days:
            state = write_once(state)
    return state.select(*series, F.inline("path"))


def naive_forecast(
    kpis: DataFrame, kind: str = "naive_rolling7", horizon_days: int = 30, series: Sequence[str] = ()
) -> DataFrame:
    """M15 for a naive model: the whole recursion is one fold over the history array."""
    rules = {"naive_rolling7": _mean(_tail("h", 7)), "naive_lag7": _from_end("h", 7)}
    grown = f"""aggregate(sequence(1, {horizon_days}), cast(history AS array<double>),
        (h, _) -> concat(h, array({rules[kind]})), h -> slice(h, -{horizon_days}, {horizon_days}))"""
    return (
        series_state(kpis, series)
        .select(*series, DAY, F.posexplode(F.expr(grown)).alias("_step", PREDICTION))
        .select(*series, F.date_add(DAY, F.col("_step") + 1).alias(DAY), PREDICTION)
    )


def holdout_split(features: DataFrame, series: Sequence[str] = (), train_ratio: float = 0.8) -> DataFrame:
    """W7 on the feature table."""
    return split_by_rows(features, DAY, series, train_ratio)
