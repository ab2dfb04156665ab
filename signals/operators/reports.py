"""Report tiles and labelled report views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signals.columns import DAY, REVENUE, SCORE
from signals.functions.display import (
    MODEL_LABELS,
    PROPENSITY_LABELS,
    STATUS_LABELS,
    STRATEGY_LABELS,
    currency,
    decimals,
    percent,
    points,
    relabel,
)
from signals.operators.forecast import PREDICTION


def business_tiles(kpis: DataFrame) -> DataFrame:
    """Total revenue, mean ticket and mean daily customers."""
    return kpis.agg(
        F.sum(REVENUE).alias("faturamento_historico"),
        F.avg("ticket_medio").alias("ticket_medio"),
        F.avg("clientes_unicos").alias("clientes_unicos_dia"),
    )


def model_tiles(metrics: DataFrame, model: str = "random_forest", baseline: str = "baseline_recency") -> DataFrame:
    """PR-AUC of the model, its gain over the baseline, and precision and recall at 50."""

    def of(name: str, c: str) -> Column:
        return F.max(F.when(F.col("model") == name, F.col(c)))

    return metrics.agg(
        of(model, "pr_auc").alias("pr_auc"),
        points((of(model, "pr_auc") - of(baseline, "pr_auc")) * 100).alias("delta_pr_auc"),
        percent(of(model, "precision_at_50")).alias("precisao_top_50"),
        percent(of(model, "recall_at_50")).alias("recall_top_50"),
    )


def only_priorities(campaign: DataFrame, selected: Sequence[str]) -> DataFrame:
    """The chosen priorities; an empty choice keeps the list whole."""
    return campaign.filter(F.col("prioridade").isin(*selected)) if selected else campaign


def campaign_tiles(campaign: DataFrame, score: str = SCORE, name: str = "nome_cliente") -> DataFrame:
    """List size, mean score and share of customers without a name."""
    return campaign.agg(
        F.count(F.lit(1)).alias("clientes_na_lista"),
        F.avg(score).alias("score_medio"),
        F.avg(F.col(name).isNull().cast("double")).alias("sem_nome"),
    )


def forecast_total(forecast: DataFrame) -> DataFrame:
    return forecast.agg(F.sum(PREDICTION).alias("faturamento_previsto"))


def uplift_tiles(versus: DataFrame, k: int = 50) -> DataFrame:
    return versus.filter(F.col("k") == k).select(
        points(F.col("recall_uplift_pp")).alias("recall_ganho"),
        points(F.col("precision_uplift_pp")).alias("precisao_ganho"),
        F.format_string("%.2fx", F.bround("lift_model", 2)).alias("lift_modelo"),
    )


def real_and_predicted(predictions: DataFrame) -> DataFrame:
    return predictions.select(DAY, F.col(REVENUE).alias("Real"), F.col(PREDICTION).alias("Previsto"))


def propensity_view(metrics: DataFrame) -> DataFrame:
    """propensity metrics under display names."""
    return metrics.select(
        relabel(F.col("model"), PROPENSITY_LABELS).alias("Estrategia"),
        decimals(F.col("pr_auc")).alias("Qualidade do ranking (PR-AUC)"),
        decimals(F.col("roc_auc")).alias("ROC-AUC"),
        decimals(F.col("recall_at_50")).alias("Recall Top 50"),
        decimals(F.col("precision_at_50")).alias("Precisao Top 50"),
        F.col("uplift_pr_auc_vs_baseline").alias("Ganho PR-AUC vs baseline"),
        F.col("train_rows").alias("Linhas treino"),
        F.col("test_rows").alias("Linhas teste"),
        F.col("train_start").alias("Inicio treino"),
        F.col("train_end").alias("Fim treino"),
        F.col("test_start").alias("Inicio teste"),
        F.col("test_end").alias("Fim teste"),
    )


def forecast_view(metrics: DataFrame) -> DataFrame:
    """production forecast metrics under display names."""
    return metrics.select(
        relabel(F.col("model"), MODEL_LABELS).alias("Modelo"),
        currency(F.col("mae")).alias("Erro medio (R$/dia)"),
        percent(F.col("mape")).alias("MAPE"),
        percent(F.col("wape")).alias("Erro de previsao (WAPE)"),
        F.col("wape_uplift_vs_best_baseline").alias("Ganho WAPE vs baseline"),
        F.col("train_rows").alias("Dias treino"),
        F.col("test_rows").alias("Dias teste"),
    )


def backtest_view(summary: DataFrame) -> DataFrame:
    return summary.select(
        relabel(F.col("model"), MODEL_LABELS).alias("Modelo"),
        F.col("folds").alias("Folds"),
        percent(F.col("wape_mean")).alias("WAPE medio"),
        currency(F.col("mae_mean")).alias("MAE medio (R$)"),
    )


def uplift_view(summary: DataFrame) -> DataFrame:
    return summary.withColumn("strategy", relabel(F.col("strategy"), STRATEGY_LABELS))


def drift_view(report: DataFrame) -> DataFrame:
    return report.select(
        F.col("feature").alias("Feature"),
        F.col("ref_mean").alias("Media treino"),
        F.col("current_mean").alias("Media recente"),
        F.col("psi").alias("PSI"),
        F.col("mean_shift_normalized").alias("Desvio (sigma)"),
        relabel(F.col("status"), STATUS_LABELS).alias("Status"),
    )
