"""Steps 3-6: train, backtest, select and run the revenue forecast."""

from __future__ import annotations

from pyspark.sql import functions as F

from signals.columns import DAY, REVENUE
from signals.operators.forecast import (
    FORECAST_FEATURES,
    LEAK_FREE_FEATURES,
    LEARNED_MODELS,
    PREDICTION,
    backtest_summary,
    best_by,
    comparison,
    forecast_features,
    holdout_predictions,
    holdout_split,
    learned_backtest,
    model_selection,
    naive_backtest,
    production_metrics,
    recursive_forecast,
    regressors,
    train_candidates,
)
from signals.operators.intervals import forecast_interval
from signals.operators.splits import held_out_rows, training_rows
from signals.operators.tables import require_rows
from signals.plans.workspace import Workspace
from signals.sources.models import load_model, save_model
from signals.sources.scratch import write_once
from signals.sources.tables import read_report

SUMMARY_SCHEMA = (
    "model string, folds long, mae_mean double, mae_std double, mape_mean double, mape_std double, "
    "wape_mean double, wape_std double, wape_uplift_vs_best_baseline double"
)
SELECTION_SCHEMA = "selected_model string, criteria string, artifact string"


def _with_series(schema: str, keys: list[str]) -> str:
    return ", ".join([*[f"`{k}` string" for k in keys], schema])


def _models(ws: Workspace):
    s = ws.sizes
    return regressors(s.forest_trees, s.forest_depth, s.boost_rounds, s.boost_depth, s.seed)


def _features(ws: Workspace) -> tuple[str, ...]:
    """``leak_free`` leaves out the same-day drivers, which no real forecast can know."""
    return LEAK_FREE_FEATURES if ws.sizes.leak_free else FORECAST_FEATURES


def _candidate(name: str) -> str:
    return f"forecast_model_{name}"


def train(ws: Workspace) -> None:
    """Naive and learned models on the first part of the days of every series, compared on the rest.

    The learned models are fitted on all series together; the experimental one is the best over all of them.
    """
    keys = list(ws.series)
    features = write_once(forecast_features(ws.table("kpis_diarios"), keys))
    split = holdout_split(features, keys, ws.sizes.train_ratio)
    fitted = train_candidates(training_rows(split), _models(ws), _features(ws))
    for name, model in fitted.items():
        save_model(model, ws.path(_candidate(name)))
    predictions = write_once(holdout_predictions(held_out_rows(split), fitted, keys))
    table = write_once(comparison(predictions, keys))
    ws.report(table.orderBy(*keys, "model"), "forecast_model_comparison", small=not keys)
    ws.report(production_metrics(table, split, tuple(fitted), keys), "forecast_metrics", small=not keys)
    overall = best_by(comparison(predictions), "wape", tuple(fitted)).first()["model"]
    save_model(fitted[overall], ws.path("forecast_model_experimental"))
    winner = best_by(table, "wape", tuple(fitted), keys)
    best = predictions.join(winner, [*keys, "model"], "left_semi")
    ws.report(best.select(*keys, DAY, REVENUE, PREDICTION).orderBy(*keys, DAY), "forecast_predictions_test", small=not keys)


def backtest(ws: Workspace) -> None:
    s, keys = ws.sizes, list(ws.series)
    folds = {"initial_ratio": s.first_train_ratio, "test_size": s.fold_days, "step": s.fold_days}
    features = write_once(forecast_features(ws.table("kpis_diarios"), keys))
    learned = learned_backtest(
        features, _models(ws), keys, feature_cols=_features(ws), parallel_fits=s.parallel_fits, **folds
    )
    detail = write_once(naive_backtest(features, keys, **folds).unionByName(learned))
    ws.report(detail.orderBy(*keys, "model", "fold"), "forecast_backtest_detail", small=not keys)
    ws.report(backtest_summary(detail, keys).orderBy(*keys, "wape_mean"), "forecast_backtest_summary", small=not keys)


def select(ws: Workspace) -> None:
    """Record the learned model with the least mean error as the production model of each series."""
    keys = list(ws.series)
    if not ws.has("forecast_backtest_summary"):
        raise FileNotFoundError(ws.path("forecast_backtest_summary"))
    summary = read_report(ws.spark, ws.path("forecast_backtest_summary"), _with_series(SUMMARY_SCHEMA, keys))
    chosen = require_rows(model_selection(summary, LEARNED_MODELS, ws.root, keys), "the list of eligible models")
    names = [r["selected_model"] for r in chosen.select("selected_model").distinct().collect()]  # two at most
    for name in names:
        if not ws.has(_candidate(name)):
            raise FileNotFoundError(ws.path(_candidate(name)))
    if not keys:
        save_model(load_model(ws.path(_candidate(names[0]))), ws.path("forecast_model"))
        artifact = F.lit(ws.path("forecast_model"))
    else:
        artifact = F.concat(F.lit(ws.path(_candidate(""))), F.col("selected_model"))
    ws.report(chosen.withColumn("artifact", artifact), "forecast_model_selection", small=not keys)


def predict(ws: Workspace, artifact: str | None = None) -> None:
    """The forecast of every series by its production model (or one given), with bounds by horizon day.

    The bounds are ranks of the model's own errors when it forecasts from origins in the part of the days it was
    not fitted on, so the candidates of the hold-out are what is measured. Many series share relative bounds, as most are
    too short for their own.
    """
    s, keys = ws.sizes, list(ws.series)
    kpis = ws.table("kpis_diarios")
    parts = {"all": (artifact or "forecast_model", kpis)}
    if keys and artifact is None:
        chosen = read_report(ws.spark, ws.path("forecast_model_selection"), _with_series(SELECTION_SCHEMA, keys))
        names = [r["selected_model"] for r in chosen.select("selected_model").distinct().collect()]  # two at most
        of = lambda name: chosen.where(F.col("selected_model") == name).select(*[F.coalesce(k, F.lit("")).alias(k) for k in keys])
        parts = {name: (_candidate(name), kpis.join(of(name), keys, "left_semi")) for name in names}
    out = None
    for name, (place, rows) in parts.items():
        model = load_model(ws.path(place))
        forecaster = {name: lambda days, by, model=model: recursive_forecast(days, model, s.forecast_days, by)}
        bounded = forecast_interval(
            write_once(rows), forecaster, keys, s.interval_alpha, 1.0, s.train_ratio, s.forecast_days, s.interval_step, bool(keys)
        )
        out = bounded if out is None else out.unionByName(bounded)
    future = out.select(*keys, DAY, PREDICTION, "lower", "upper")
    ws.report(future.orderBy(*keys, DAY), "forecast_future_30d", small=not keys)


def train_and_predict(ws: Workspace) -> None:
    """Forecast with the hold-out winner, without a backtest."""
    train(ws)
    predict(ws, "forecast_model_experimental")


def run_forecast_step(ws: Workspace) -> None:
    train(ws)
    backtest(ws)
    select(ws)
    predict(ws)
