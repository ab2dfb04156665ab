"""Feature and revenue drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signals.columns import DAY, PROPENSITY_FEATURES, REVENUE, SNAPSHOT
from signals.functions.numeric import equal_width_bin, round4
from signals.operators.splits import SPLIT, cutoff_date, split_by_rows
from signals.operators.tables import present

# Status limits.
PSI_ALERT, PSI_WARNING = 0.2, 0.1
SHIFT_ALERT, SHIFT_WARNING = 0.30, 0.15
BINS = 10
REPORT_COLUMNS = (
    "feature",
    "ref_mean",
    "ref_std",
    "current_mean",
    "current_std",
    "mean_shift_normalized",
    "psi",
    "status",
)


def drift_status(psi: Column, shift: Column) -> Column:
    """D3: an unknown (null) value never raises the status."""
    return (
        F.when((psi > PSI_ALERT) | (shift > SHIFT_ALERT), "ALERT")
        .when((psi > PSI_WARNING) | (shift > SHIFT_WARNING), "WARNING")
        .otherwise("OK")
    )


def mean_shift(ref_mean: Column, ref_std: Column, cur_mean: Column) -> Column:
    """Distance of the means in reference standard deviations; 0 without spread."""
    return F.when(ref_std == 0, 0.0).otherwise(F.abs(cur_mean - ref_mean) / F.nullif(ref_std, F.lit(0.0)))


def drift_report(
    df: DataFrame,
    features: Sequence[str],
    is_reference: Column,
    is_current: Column,
    bins: int = BINS,
    epsilon: float | None = None,
) -> DataFrame:
    """Mean shift, population stability index and status per feature.

    One pass computes means, spreads and pooled bounds of all features side by side; a
    second counts (feature, bin) pairs, which combine to ``features * bins`` rows inside
    every task before the shuffle. The statistics broadcast to the second pass have one
    row per feature.

    ``epsilon`` fills empty bins instead of skipping them.
    """
    flagged = df.select(
        *[F.col(f).cast("double").alias(f) for f in features],
        F.coalesce(is_reference, F.lit(False)).alias("_ref"),
        F.coalesce(is_current, F.lit(False)).alias("_cur"),
    ).filter("_ref or _cur")

    def side(flag: str, f: str) -> Column:
        return F.when(F.col(flag), F.col(f))

    per_feature = [
        F.struct(
            F.lit(f).alias("feature"),
            F.avg(side("_ref", f)).alias("rm"),
            F.stddev_samp(side("_ref", f)).alias("rs"),
            F.avg(side("_cur", f)).alias("cm"),
            F.stddev_samp(side("_cur", f)).alias("cs"),
            F.min(f).alias("lo"),
            F.max(f).alias("hi"),
        )
        for f in features
    ]
    stats = flagged.agg(F.array(*per_feature).alias("s")).select(F.inline("s"))
    # A feature without values on either side has nothing to compare.
    stats = stats.filter(F.col("rm").isNotNull() & F.col("cm").isNotNull())

    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features])
    counts = (
        flagged.select("_ref", "_cur", F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .join(F.broadcast(stats.select("feature", "lo", "hi")), "feature")
        .filter(F.col("lo") < F.col("hi"))
        .withColumn("bin", equal_width_bin(F.col("value"), F.col("lo"), F.col("hi"), bins))
        .filter(F.col("bin").isNotNull())
        .groupBy("feature", "bin")
        .agg(F.count_if("_ref").cast("double").alias("r"), F.count_if("_cur").cast("double").alias("c"))
    )
    # At most `bins` counts per feature, so the per-feature totals are tiny lists.
    cells = counts.groupBy("feature").agg(
        F.sum("r").alias("r_all"), F.sum("c").alias("c_all"), F.collect_list(F.struct("r", "c")).alias("cells")
    )
    p, q = F.try_divide(F.col("r"), F.col("r_all")), F.try_divide(F.col("c"), F.col("c_all"))
    if epsilon is not None:
        p, q = (F.when(x > 0, x).otherwise(F.lit(epsilon)) for x in (p, q))
    index = (
        cells.select("feature", "r_all", "c_all", F.inline("cells"))
        .groupBy("feature")
        .agg(F.sum(F.when((p > 0) & (q > 0), (q - p) * F.ln(q / p))).alias("psi"))
    )
    shift = mean_shift(F.col("rm"), F.col("rs"), F.col("cm"))
    # The left join keeps features whose pooled values are all equal: their index is 0.
    out = stats.join(index, "feature", "left").withColumns({"psi": F.coalesce("psi", F.lit(0.0)), "shift": shift})
    return out.select(
        "feature",
        round4(F.col("rm")).alias("ref_mean"),
        round4(F.col("rs")).alias("ref_std"),
        round4(F.col("cm")).alias("current_mean"),
        round4(F.col("cs")).alias("current_std"),
        round4(F.col("shift")).alias("mean_shift_normalized"),
        round4(F.col("psi")).alias("psi"),
        drift_status(F.col("psi"), F.col("shift")).alias("status"),
    )


def monitoring_flags(panel: DataFrame, recent_days: int = 30, train_ratio: float = 0.8) -> tuple[Column, Column]:
    """P10: the training part of the panel and its last ``recent_days`` days."""
    newest = panel.agg(F.date_sub(F.max(SNAPSHOT), recent_days).alias("since")).scalar()
    return F.col(SNAPSHOT) <= cutoff_date(panel, SNAPSHOT, train_ratio), F.col(SNAPSHOT) >= newest


def panel_drift(
    panel: DataFrame,
    recent_days: int = 30,
    train_ratio: float = 0.8,
    features: Sequence[str] = PROPENSITY_FEATURES,
    **options,
) -> DataFrame:
    """Drift of the customer features, training part against recent window."""
    reference, current = monitoring_flags(panel, recent_days, train_ratio)
    return drift_report(panel, present(panel, features), reference, current, **options)


def revenue_drift(kpis: DataFrame, train_ratio: float = 0.8, **options) -> DataFrame:
    """Drift of daily revenue, first part of the days against the rest."""
    split = split_by_rows(kpis.select(DAY, REVENUE), DAY, train_ratio=train_ratio, at_least=0)
    return drift_report(split, [REVENUE], F.col(SPLIT) == "train", F.col(SPLIT) == "test", **options)


def drift_summary(report: DataFrame, panel: DataFrame, recent_days: int = 30, train_ratio: float = 0.8) -> DataFrame:
    """The worst status, counts by status and the compared row counts."""
    reference, current = monitoring_flags(panel, recent_days, train_ratio)
    sizes = panel.agg(
        F.struct(F.count_if(reference).alias("reference_rows"), F.count_if(current).alias("current_rows")).alias("s")
    ).scalar()

    def status(name: str) -> Column:
        return F.count_if(F.col("status") == name)

    return (
        report.agg(
            F.when(status("ALERT") > 0, "ALERT")
            .when(status("WARNING") > 0, "WARNING")
            .otherwise("OK")
            .alias("overall_status"),
            F.count(F.lit(1)).alias("n_features"),
            status("OK").alias("n_ok"),
            status("WARNING").alias("n_warning"),
            status("ALERT").alias("n_alert"),
        )
        .withColumns({"recent_days": F.lit(recent_days), "_s": sizes})
        .select("overall_status", "n_features", "n_ok", "n_warning", "n_alert", "recent_days", "_s.*")
    )
