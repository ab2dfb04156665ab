from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from signals.columns import DAILY_DRIVERS, DAY, REVENUE
from signals.operators.forecast import (
    FORECAST_FEATURES,
    HISTORY_FEATURES,
    LEAK_FREE_FEATURES,
    PREDICTION,
    backtest_summary,
    best_by,
    comparison,
    error_table,
    fit_regressor,
    forecast_features,
    holdout_predictions,
    holdout_split,
    learned_backtest,
    model_selection,
    naive_backtest,
    naive_forecast,
    next_day_features,
    predict_with,
    production_metrics,
    recursive_forecast,
    regressors,
    series_state,
    train_candidates,
)
from signals.operators.splits import held_out_rows, training_rows

KPI_SCHEMA = (
    "loja string, data date, faturamento_total double, numero_pedidos long, clientes_unicos long,"
    " ticket_medio double, valor_pedido_fabrica double"
)


def kpi_rows(series, n, seed, gap=False):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        day = date(2024, 1, 1) + timedelta(days=i)
        if gap and day.day % 7 == 3:
            continue
        orders = int(rng.integers(1, 9))
        value = float(100 + 30 * np.sin(i / 3) + rng.uniform(0, 20))
        out.append((series, day, value, orders, orders, value / orders, float(rng.uniform(0, 5))))
    return out


@pytest.fixture(scope="module")
def kpis(spark):
    return spark.createDataFrame(kpi_rows("a", 120, 1) + kpi_rows("b", 90, 2, gap=True), KPI_SCHEMA).cache()


def one(kpis, name):
    return kpis.filter(F.col("loja") == name).drop("loja")


@pytest.mark.parametrize("name", ["a", "b"])
def test_features_match_pandas(kpis, name):
    pdf = one(kpis, name).toPandas().sort_values(DAY).reset_index(drop=True)
    v = pdf[REVENUE]
    expected = pd.DataFrame({"data": pdf[DAY]})
    for k in (1, 7, 14, 21, 28):
        expected[f"fat_lag_{k}"] = v.shift(k)
    for w in (7, 14, 30):
        expected[f"fat_roll_mean_{w}"] = v.rolling(w, min_periods=1).mean().shift(1)
        expected[f"fat_roll_std_{w}"] = v.rolling(w, min_periods=2).std(ddof=0).shift(1).fillna(0.0)
    expected = expected.dropna().reset_index(drop=True)
    got = forecast_features(kpis, ["loja"]).filter(F.col("loja") == name).toPandas().sort_values(DAY).reset_index(drop=True)
    assert list(got[DAY]) == list(expected[DAY])
    for c in HISTORY_FEATURES:
        np.testing.assert_allclose(got[c], expected[c], rtol=1e-9, atol=1e-7)


@pytest.mark.parametrize(
    "y, p, mae, mape, wape",
    [
        ([100, 200, 300], [100, 200, 300], 0.0, 0.0, 0.0),
        ([100, 100], [50, 100], 25.0, 0.25, 0.25),
        ([0, 0], [1, 1], 1.0, None, 0.0),
        ([0, 100], [10, 110], 10.0, 0.10, 0.2),
    ],
)
def test_errors(spark, y, p, mae, mape, wape):
    df = spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(y, p)], f"model string, {REVENUE} double, {PREDICTION} double")
    r = error_table(df, ["model"]).first()
    assert r["mae"] == pytest.approx(mae) and r["wape"] == pytest.approx(wape)
    assert r["mape"] is None if mape is None else r["mape"] == pytest.approx(mape)


def test_next_day_features_short_history(spark):
    df = spark.createDataFrame(kpi_rows("a", 3, 1), KPI_SCHEMA)
    v = [r[REVENUE] for r in df.orderBy(DAY).collect()]
    r = next_day_features(series_state(df, ["loja"])).first()
    assert r[DAY] == date(2024, 1, 4) and r["fat_lag_1"] == v[-1] and r["fat_lag_7"] == v[-1]
    assert r["fat_roll_mean_30"] == pytest.approx(np.mean(v)) and r["fat_roll_std_7"] == pytest.approx(np.std(v))


def recursion(values, rule, days):
    values = list(values)
    for _ in range(days):
        values.append(rule(values))
    return values[-days:]


def test_naive_forecast(kpis):
    out = naive_forecast(kpis, "naive_rolling7", 10, ["loja"]).filter("loja = 'b'").orderBy(DAY).collect()
    history = [r[REVENUE] for r in one(kpis, "b").orderBy(DAY).collect()]
    assert [r[PREDICTION] for r in out] == pytest.approx(recursion(history, lambda h: np.mean(h[-7:]), 10))
    last = one(kpis, "b").agg(F.max(DAY)).first()[0]
    assert [r[DAY] for r in out] == [last + timedelta(days=i) for i in range(1, 11)]
    lag = naive_forecast(kpis, "naive_lag7", 10, ["loja"]).filter("loja = 'a'").orderBy(DAY).collect()
    history = [r[REVENUE] for r in one(kpis, "a").orderBy(DAY).collect()]
    assert [r[PREDICTION] for r in lag] == pytest.approx(recursion(history, lambda h: h[-7], 10))


def test_learned_models_end_to_end(spark, kpis):
    single = one(kpis, "a")
    features = forecast_features(single).cache()
    split = holdout_split(features)
    models = regressors(forest_trees=5, forest_depth=4, boost_rounds=2, boost_depth=3)
    fitted = train_candidates(training_rows(split), models)
    predictions = holdout_predictions(held_out_rows(split), fitted).cache()
    table = comparison(predictions)
    assert {r["model"] for r in table.collect()} == {"naive_lag7", "naive_rolling7", "random_forest", "gbt"}
    naive = table.filter("model like 'naive%'").agg(F.min("wape")).first()[0]
    for r in table.collect():
        assert r["wape_uplift_vs_baseline"] == pytest.approx(naive - r["wape"])
    production = production_metrics(table, split).first()
    assert production["model"] in fitted and production["train_rows"] + production["test_rows"] == features.count()
    assert production["train_end"] < production["test_start"]

    model = fitted["random_forest"]
    future = recursive_forecast(single, model, 5, write_every=2).orderBy(DAY).collect()
    work = single.toPandas().sort_values(DAY)
    for step in future:
        row = next_row(work, step[DAY])
        x = spark.createDataFrame([tuple(float(row[c]) for c in FORECAST_FEATURES)], list(FORECAST_FEATURES))
        expected = predict_with(model, x).first()[PREDICTION]
        assert step[PREDICTION] == pytest.approx(expected)
        extra = {DAY: step[DAY], REVENUE: expected, **{d: row[d] for d in DAILY_DRIVERS}}
        work = pd.concat([work, pd.DataFrame([extra])], ignore_index=True)


def next_row(work, day):
    stamp, v = pd.Timestamp(day), work[REVENUE]
    row = {
        "dia_semana": stamp.dayofweek,
        "mes": stamp.month,
        "ano": stamp.year,
        "semana_ano": stamp.isocalendar().week,
        "is_weekend": int(stamp.dayofweek >= 5),
        "is_month_start": int(stamp.is_month_start),
        "is_month_end": int(stamp.is_month_end),
    }
    row.update({d: work[d].tail(7).mean() for d in DAILY_DRIVERS})
    row.update({f"fat_lag_{k}": v.iloc[-k] for k in (1, 7, 14, 21, 28)})
    for w in (7, 14, 30):
        row[f"fat_roll_mean_{w}"], row[f"fat_roll_std_{w}"] = v.tail(w).mean(), v.tail(w).std(ddof=0)
    return row


def test_backtest_and_selection(kpis):
    features = forecast_features(kpis, ["loja"]).cache()
    folds = {"test_size": 10, "step": 10}
    naive = naive_backtest(features, ["loja"], **folds)
    pdf = features.filter("loja = 'a'").toPandas().sort_values(DAY).reset_index(drop=True)
    start = int(len(pdf) * 0.6)
    first = pdf.iloc[start : start + 10]
    got = naive.filter("loja = 'a' and fold = 1 and model = 'naive_lag7'").first()
    assert got["mae"] == pytest.approx((first[REVENUE] - first.fat_lag_7).abs().mean())
    models = {"random_forest": regressors(forest_trees=3, forest_depth=3)["random_forest"]}
    learned = learned_backtest(features, models, ["loja"], LEAK_FREE_FEATURES, **folds)
    detail = naive.unionByName(learned).cache()
    counts = {(r["loja"], r["model"]): r["count"] for r in detail.groupBy("loja", "model").count().collect()}
    assert counts["a", "random_forest"] == counts["a", "naive_lag7"] > 1
    assert counts["b", "random_forest"] == counts["b", "naive_lag7"]
    summary = backtest_summary(detail, ["loja"])
    chosen = model_selection(summary, artifact_root="m/", series=["loja"]).collect()
    assert {(r["loja"], r["selected_model"], r["artifact"]) for r in chosen} == {
        ("a", "random_forest", "m/random_forest"),
        ("b", "random_forest", "m/random_forest"),
    }
    assert model_selection(summary, ["unknown"]).count() == 0


def test_best_by_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "model string, wape double")
    assert best_by(df, "wape").first()["model"] == "a"
    assert best_by(df, "wape", ["b", "c"]).first()["model"] == "b"


def test_fits_are_repeatable(kpis):
    features = forecast_features(one(kpis, "a")).cache()
    make = regressors(forest_trees=3, forest_depth=3)["random_forest"]
    a, b = (predict_with(fit_regressor(features, make()), features).agg(F.sum(PREDICTION)).first()[0] for _ in range(2))
    assert a == b


def test_pooled_folds_never_learn_from_later_days(spark, monkeypatch):
    """Two series a year apart: no training row is later than the first day tested in its fold."""
    import signals.operators.forecast as m

    late = [(("b", d[1] + timedelta(days=365), *d[2:])) for d in kpi_rows("b", 200, 4)]
    kpis = spark.createDataFrame(kpi_rows("a", 200, 3) + late, KPI_SCHEMA)
    features = forecast_features(kpis, ["loja"]).cache()
    seen = []
    fit = m.fit_regressor
    monkeypatch.setattr(m, "fit_regressor", lambda train, *rest: seen.append(train.agg({"data": "max"}).first()[0]) or fit(train, *rest))
    models = {"random_forest": regressors(forest_trees=2, forest_depth=2)["random_forest"]}
    detail = learned_backtest(features, models, ["loja"], LEAK_FREE_FEATURES, parallel_fits=1)
    tested = m.fold_rows(m.with_positions(features, "data", ["loja"])).groupBy("fold").agg({"data": "min"}).collect()
    begins = [r[1] for r in sorted(tested)]
    assert len(seen) == len(begins) > 1 and all(a < b for a, b in zip(seen, begins))
    assert {r["loja"] for r in detail.collect()} == {"a", "b"}
