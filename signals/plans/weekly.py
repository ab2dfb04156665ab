"""The whole weekly batch in one Spark application."""

from __future__ import annotations

from pyspark.sql import DataFrame

from signals.plans.data_step import run_data_step
from signals.plans.forecast_step import run_forecast_step
from signals.plans.monitoring_step import run_monitoring_step
from signals.plans.propensity_step import run_propensity_step
from signals.plans.workspace import Workspace
from signals.sources.scratch import drop_scratch, scratch_run


def run_weekly(ws: Workspace, purchases: DataFrame, customers: DataFrame, factory_orders: DataFrame) -> None:
    """Data, propensity, forecast (train, backtest, select, predict), monitoring."""
    with scratch_run() as run:
        try:
            run_data_step(ws, purchases, customers, factory_orders)
            run_propensity_step(ws)
            run_forecast_step(ws)
            run_monitoring_step(ws)
        finally:
            drop_scratch(ws.spark, run)
