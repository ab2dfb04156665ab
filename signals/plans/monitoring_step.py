"""Step 7: drift of features and revenue."""

from __future__ import annotations

from pyspark.sql import functions as F

from signals.columns import DAY, REVENUE
from signals.operators.drift import drift_summary, panel_drift, revenue_drift
from signals.plans.workspace import Workspace
from signals.sources.scratch import write_once


def run_monitoring_step(ws: Workspace) -> None:
    """Revenue drift is left out when the daily table is absent."""
    s = ws.sizes
    panel = ws.table("propensity_dataset")
    report = panel_drift(panel, s.recent_days, s.train_ratio)
    if ws.has("kpis_diarios"):
        days = ws.table("kpis_diarios").groupBy(DAY).agg(F.sum(REVENUE).alias(REVENUE))
        report = report.unionByName(revenue_drift(write_once(days), s.train_ratio))
    report = write_once(report)
    ws.report(report, "monitoring_report")
    ws.report(drift_summary(report, panel, s.recent_days, s.train_ratio), "monitoring_summary")
