"""Campaign ranking metrics at K and uplift over a baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signals.columns import SNAPSHOT, TARGET
from signals.functions.numeric import ratio_or_zero
from signals.operators.ranking import rank_areas, top_rows

K_VALUES = (10, 30, 50)


def _hits(k: int, label: str) -> Column:
    """Positives among the first k rows."""
    return F.coalesce(F.sum(F.when(F.col("_rn") <= k, F.col(label))), F.lit(0)).alias(f"hits_{k}")


def metrics_at_k(
    scored: DataFrame,
    by: Sequence[str],
    key: Sequence[str],
    label: str = TARGET,
    score: str = "score",
    ks: Sequence[int] = K_VALUES,
) -> DataFrame:
    """One row per (group, k) with recall, precision, lift and base rate.

    Group totals come from a combining aggregate over all rows and hits from the top rows
    only; the two meet as one small row per group, and all k share one pass. Without ``by``
    the whole input is one group.
    """
    if not by:
        single = metrics_at_k(scored.withColumn("_all", F.lit(1)), ["_all"], key, label, score, ks)
        return single.drop("_all")
    totals = scored.groupBy(*by).agg(
        F.sum(F.col(label).cast("long")).alias("positives"), F.count(F.lit(1)).alias("n")
    )
    hits = (
        top_rows(scored.select(*by, *key, score, label), by, score, key, max(ks))
        .groupBy(*by)
        .agg(*[_hits(k, label) for k in ks])
    )
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hits_{k}").alias("hits")) for k in ks])
    rows = totals.join(hits, list(by)).select(*by, "positives", "n", F.inline(pairs))
    precision = ratio_or_zero(F.col("hits"), F.least(F.col("k"), F.col("n")))
    base = ratio_or_zero(F.col("positives"), F.col("n"))
    return rows.withColumns(
        {
            "recall_at_k": ratio_or_zero(F.col("hits"), F.col("positives")),
            "precision_at_k": precision,
            "lift_at_k": ratio_or_zero(precision, base),
            "base_rate": base,
        }
    ).select(*by, "k", "recall_at_k", "precision_at_k", "lift_at_k", "base_rate", "positives", "n")


def recall_by_snapshot(
    scored: DataFrame, key: str, score: str = "score", label: str = TARGET, ks: Sequence[int] = (10, 30, 50, 100)
) -> DataFrame:
    """Mean over snapshots of recall at k; snapshots without positives count as 0."""
    per_snapshot = metrics_at_k(scored, [SNAPSHOT], [key], label, score, ks)
    return per_snapshot.groupBy("k").agg(F.avg("recall_at_k").alias("recall_at_k_mean_by_snapshot"))


def uplift_detail(
    scored: DataFrame, key: str, label: str = TARGET, score: str = "score", ks: Sequence[int] = K_VALUES
) -> DataFrame:
    """Metrics per snapshot, strategy and k, from long scores with a strategy column."""
    return metrics_at_k(scored, [SNAPSHOT, "strategy"], [key], label, score, ks)


def uplift_summary(detail: DataFrame) -> DataFrame:
    """Means over snapshots per strategy and k (sample standard deviation of recall)."""
    return detail.groupBy("strategy", "k").agg(
        F.count(SNAPSHOT).alias("snapshots"),
        F.avg("recall_at_k").alias("recall_mean"),
        F.stddev_samp("recall_at_k").alias("recall_std"),
        F.avg("precision_at_k").alias("precision_mean"),
        F.avg("lift_at_k").alias("lift_mean"),
        F.avg("base_rate").alias("base_rate_mean"),
    )


def uplift_vs_baseline(summary: DataFrame, model: str = "model", baseline: str = "baseline_recency") -> DataFrame:
    """Model minus baseline per k in percentage points; k without both is skipped."""

    def of(strategy: str, column: str) -> Column:
        return F.max(F.when(F.col("strategy") == strategy, F.col(column)))

    return (
        summary.groupBy("k")
        .agg(
            ((of(model, "recall_mean") - of(baseline, "recall_mean")) * 100).alias("recall_uplift_pp"),
            ((of(model, "precision_mean") - of(baseline, "precision_mean")) * 100).alias("precision_uplift_pp"),
            of(model, "lift_mean").alias("lift_model"),
            of(baseline, "lift_mean").alias("lift_baseline"),
        )
        .na.drop(subset=["recall_uplift_pp"])
    )


def propensity_metrics(
    train: DataFrame,
    scored: DataFrame,
    key: str,
    baseline: str = "baseline_recency",
    label: str = TARGET,
    score: str = "score",
    ks: Sequence[int] = K_VALUES,
) -> DataFrame:
    """One row per strategy over all test snapshots pooled.

    ``scored`` holds the test rows in long form (strategy, score); ``train`` only
    contributes its row count and date bounds.
    """
    areas = rank_areas(scored, label, score)
    pooled = metrics_at_k(scored, ["strategy"], [SNAPSHOT, key], label, score, ks)
    at_k = pooled.groupBy("strategy").agg(
        *[
            F.max(F.when(F.col("k") == k, F.col(f"{m}_at_k"))).alias(f"{m}_at_{k}")
            for k in ks
            for m in ("recall", "precision")
        ]
    )
    tests = scored.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("test_rows"),
        F.min(SNAPSHOT).alias("test_start"),
        F.max(SNAPSHOT).alias("test_end"),
    )
    bounds = train.agg(
        F.struct(
            F.count(F.lit(1)).alias("train_rows"),
            F.min(SNAPSHOT).alias("train_start"),
            F.max(SNAPSHOT).alias("train_end"),
        ).alias("b")
    ).scalar()
    base = F.max(F.when(F.col("strategy") == baseline, F.col("pr_auc"))).over(Window.partitionBy())
    return (
        areas.join(tests, "strategy")
        .join(at_k, "strategy")
        .withColumn("_b", bounds)
        .select(
            F.col("strategy").alias("model"),
            "pr_auc",
            "roc_auc",
            F.col("_b.train_rows").alias("train_rows"),
            "test_rows",
            F.col("_b.train_start").alias("train_start"),
            F.col("_b.train_end").alias("train_end"),
            "test_start",
            "test_end",
            *[f"{m}_at_{k}" for k in ks for m in ("recall", "precision")],
            (F.col("pr_auc") - base).alias("uplift_pr_auc_vs_baseline"),
        )
    )
