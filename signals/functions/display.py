"""Display names and number formats for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names shown in the business reports.
MODEL_LABELS = {
    "random_forest": "Random Forest",
    "xgboost": "XGBoost",
    "gbt": "Gradient Boosting",
    "naive_lag7": "Baseline lag-7",
    "naive_rolling7": "Baseline media movel 7d",
}
PROPENSITY_LABELS = {
    "random_forest": "Modelo IA (Random Forest)",
    "baseline_recency": "Baseline (recencia)",
}
STRATEGY_LABELS = {"model": "Modelo IA", "baseline_recency": "Baseline recencia"}
STATUS_LABELS = {"OK": "OK", "WARNING": "Aviso", "ALERT": "Alerta"}


def relabel(c: Column, labels: dict[str, str]) -> Column:
    """Replace known names and keep the others."""
    out = None
    for name, label in labels.items():
        out = F.when(c == name, label) if out is None else out.when(c == name, label)
    return out.otherwise(c)


def _formatted(pattern: str, c: Column) -> Column:
    """Null stays null (a format would spell it out)."""
    return F.when(c.isNotNull(), F.format_string(pattern, c))


def percent(c: Column, decimals: int = 1) -> Column:
    return _formatted(f"%.{decimals}f%%", F.bround(c * 100, decimals))


def points(c: Column, decimals: int = 1) -> Column:
    """Signed percentage points; a small loss still reads -0.0."""
    rounded = F.bround(c, decimals)
    return _formatted(f"%+.{decimals}f p.p.", F.when((c < 0) & (rounded == 0), F.lit(-0.0)).otherwise(rounded))


def currency(c: Column) -> Column:
    return F.concat(F.lit("R$ "), F.format_number(c, 2))


def decimals(c: Column, n: int = 4) -> Column:
    return _formatted(f"%.{n}f", F.bround(c, n))
