"""The whole batch on small text tables, and every output read back."""

from __future__ import annotations

import os
from dataclasses import replace
from datetime import date

import pytest

from signals.__main__ import main
from signals.catalog.cleaning import raw_customers, raw_factory_orders, raw_purchases
from signals.operators.reports import drift_view, forecast_view, model_tiles, propensity_view, uplift_tiles
from signals.plans.data_step import run_data_step
from signals.plans.forecast_step import run_forecast_step, select, train_and_predict
from signals.plans.weekly import run_weekly
from signals.plans.workspace import Sizes, Workspace
from signals.sources.models import feature_list, load_model

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data is not here")


def csv(ws, name):
    return ws.spark.read.csv(ws.path(name), header=True, inferSchema=True)


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    sizes = Sizes(
        propensity_trees=5, propensity_depth=4, forest_trees=4, forest_depth=4, boost_rounds=2, boost_depth=2,
        fold_days=100, campaign_size=10,
    )
    w = Workspace(spark, str(tmp_path_factory.mktemp("weekly")), sizes=sizes)
    run_weekly(w, raw_purchases(spark, SF_DIR), raw_customers(spark, SF_DIR), raw_factory_orders(spark, SF_DIR))
    return w


def test_tables(ws):
    assert ws.table("compras_clientes_clean").filter("data_compra is null or id_cliente is null").count() == 0
    assert ws.table("rfm_clientes").filter("nome_cliente is not null").count() > 0
    assert ws.table("kpis_diarios_features").filter("fat_rolling_30 is null").count() == 0
    panel = ws.table("propensity_dataset")
    assert dict(panel.dtypes)["snapshot_date"] == "date" and panel.count() > 0
    weeks = panel.select("snapshot_date").distinct().count()
    assert len([f for f in panel.inputFiles()]) <= 4 * weeks


def test_reports(ws):
    assert csv(ws, "quality_report").filter("severity = 'error'").count() == 0
    top = csv(ws, "campanha_top100").orderBy("rank").collect()
    assert [r["rank"] for r in top] == list(range(1, 11))
    assert csv(ws, "propensity_scoring").count() >= 10
    assert csv(ws, "propensity_recall_at_k_by_snapshot").count() == 4
    assert csv(ws, "campaign_uplift_summary").count() == 6
    assert csv(ws, "campaign_uplift_detail").count() > 6
    metrics = csv(ws, "propensity_metrics")
    assert propensity_view(metrics).count() == 2 and model_tiles(metrics).first()["delta_pr_auc"].endswith("p.p.")
    assert uplift_tiles(csv(ws, "campaign_uplift_vs_baseline")).count() == 1
    assert csv(ws, "forecast_model_comparison").count() == 4
    assert forecast_view(csv(ws, "forecast_metrics")).count() == 1
    assert csv(ws, "forecast_predictions_test").count() > 0
    future = csv(ws, "forecast_future_30d").orderBy("data").collect()
    last = ws.table("kpis_diarios").selectExpr("max(data)").first()[0]
    assert len(future) == 30 and (future[0]["data"] - last).days == 1 and isinstance(future[0]["data"], date)
    chosen = csv(ws, "forecast_model_selection").first()
    assert chosen["selected_model"] in ("random_forest", "gbt") and chosen["artifact"] == ws.path("forecast_model")
    assert drift_view(csv(ws, "monitoring_report")).count() == 6
    assert csv(ws, "monitoring_summary").first()["n_features"] == 6


def test_models(ws):
    assert len(feature_list(load_model(ws.path("propensity_model")))) == 5
    assert len(feature_list(load_model(ws.path("forecast_model")))) == 22


def test_quick_forecast_without_same_day_drivers(ws):
    quick = Workspace(ws.spark, ws.root, sizes=replace(ws.sizes, leak_free=True, forecast_days=3))
    train_and_predict(quick)
    model = load_model(ws.path("forecast_model_experimental"))
    assert len(feature_list(model)) == 18
    assert csv(ws, "forecast_future_30d").count() == 3


def test_many_series(spark, tmp_path):
    """Every master's revenue is a series of its own, from the daily table to the forecast with its bounds."""
    sizes = Sizes(forest_trees=4, forest_depth=4, boost_rounds=2, boost_depth=2, fold_days=60, forecast_days=5)
    w = Workspace(spark, str(tmp_path), sizes=sizes, series=("nome_master",))
    run_data_step(w, raw_purchases(spark, SF_DIR), raw_customers(spark, SF_DIR), raw_factory_orders(spark, SF_DIR))
    run_forecast_step(w)
    days = w.table("kpis_diarios")
    masters = {r[0] for r in days.select("nome_master").distinct().collect()}
    total = w.table("compras_clientes_clean").selectExpr("sum(valor_total)").first()[0]
    assert len(masters) >= 5 and days.selectExpr("sum(faturamento_total)").first()[0] == pytest.approx(total)
    rejected = w.table("compras_clientes_rejected")
    assert rejected.count() + w.table("compras_clientes_clean").count() == raw_purchases(spark, SF_DIR).count()
    chosen = csv(w, "forecast_model_selection").collect()
    assert {r["nome_master"] for r in chosen} <= masters and all(r["artifact"].endswith(r["selected_model"]) for r in chosen)
    future = csv(w, "forecast_future_30d").collect()
    assert len(future) == 5 * len(chosen) and all(r["lower"] <= r["pred_faturamento"] <= r["upper"] for r in future if r["upper"])
    assert sum(r["upper"] is not None for r in future) > 0


def test_masking_sheets_from_the_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Relatorio,\nCod. Cliente,Nome\n1,Ana\n")
    main(["mask", "--customers", str(tmp_path / "in" / "*.csv"), "--out", str(tmp_path / "out"), "--salt", "s"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "out" / "customers")).collect()]
    assert "Cod. Cliente,Nome" in lines and len(lines) == 3 and not any("Ana" in x for x in lines)


def test_missing_columns_stop_the_batch(spark, tmp_path):
    w = Workspace(spark, str(tmp_path))
    with pytest.raises(RuntimeError, match="quality"):
        run_data_step(w, raw_purchases(spark, SF_DIR), raw_customers(spark, SF_DIR).drop("Nome"), raw_factory_orders(spark, SF_DIR))
    assert csv(w, "quality_report").where("severity = 'error'").count() == 1 and not w.has("compras_clientes")


def test_command_line(spark, tmp_path):
    path = str(tmp_path / "people")
    raw_customers(spark, SF_DIR).write.parquet(path)
    main(["mask", "--customers", path, "--purchases", str(tmp_path / "none"), "--out", str(tmp_path / "out"), "--salt", "s"])
    masked = spark.read.parquet(str(tmp_path / "out" / "customers"))
    assert masked.count() == raw_customers(spark, SF_DIR).count()
    assert masked.filter("Codigo not like 'ID%'").count() == 0
    with pytest.raises(SystemExit):
        main(["all", "--out", str(tmp_path)])


def test_selection_needs_its_inputs(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        select(Workspace(spark, str(tmp_path)))
