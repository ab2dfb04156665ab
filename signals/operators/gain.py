"""What a ranked list is worth: revenue captured by its top, and the gain curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signals.columns import SNAPSHOT
from signals.functions.numeric import ratio_or_zero, sum_or_zero
from signals.operators.evaluation import K_VALUES
from signals.operators.ranking import ordered_blocks, top_rows

FUTURE_VALUE = "receita_futura"


def captured_by_snapshot(
    scored: DataFrame, key: str, value: str = FUTURE_VALUE, score: str = "score", ks: Sequence[int] = K_VALUES
) -> DataFrame:
    """``snapshot, strategy, k, captured, total, share``: future revenue of the k best against that of all."""
    by = [SNAPSHOT, "strategy"]
    totals = scored.groupBy(*by).agg(sum_or_zero(F.col(value)).alias("total"))
    top = top_rows(scored.select(*by, key, score, value), by, score, [key], max(ks))
    sums = [sum_or_zero(F.when(F.col("_rn") <= k, F.col(value))).alias(f"top_{k}") for k in ks]
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"top_{k}").alias("captured")) for k in ks])
    rows = totals.join(top.groupBy(*by).agg(*sums), by).select(*by, "total", F.inline(pairs))
    return rows.select(*by, "k", "captured", "total", ratio_or_zero(F.col("captured"), F.col("total")).alias("share"))


def captured_revenue(detail: DataFrame) -> DataFrame:
    """``strategy, k, snapshots, captured, total, share, share_mean``: over all snapshots, pooled and as a mean."""
    return detail.groupBy("strategy", "k").agg(
        F.count(SNAPSHOT).alias("snapshots"),
        F.sum("captured").alias("captured"),
        F.sum("total").alias("total"),
        ratio_or_zero(F.sum("captured"), F.sum("total")).alias("share"),
        F.avg("share").alias("share_mean"),
    )


def captured_versus(summary: DataFrame, model: str = "model", baseline: str = "baseline_recency") -> DataFrame:
    """``k, model_share, baseline_share, gain_pp, extra_revenue``: what the model's list captures beyond the baseline's."""
    of = lambda strategy, c: F.max(F.when(F.col("strategy") == strategy, F.col(c)))
    rows = summary.groupBy("k").agg(
        of(model, "share").alias("model_share"),
        of(baseline, "share").alias("baseline_share"),
        (of(model, "captured") - of(baseline, "captured")).alias("extra_revenue"),
    )
    gain = (F.col("model_share") - F.col("baseline_share")) * 100
    return rows.withColumn("gain_pp", gain).na.drop(subset=["gain_pp"])


def gain_curve(
    scored: DataFrame, key: Sequence[str], value: str = FUTURE_VALUE, score: str = "score", by: str = "strategy", steps: int = 20
) -> DataFrame:
    """``strategy, part, rows, captured, share``: revenue of the best ``part / steps`` of all rows, for every part.

    Rows are sorted into blocks by strategy and score. The place of a row and the revenue up to it are its block's
    offset, a sum over one row per block before, plus the running count and sum inside; only rows on a cut are kept.
    """
    blocks = ordered_blocks(
        scored.select(by, *key, score, F.coalesce(F.col(value), F.lit(0.0)).alias("_value")),
        [F.col(by).asc(), F.col(score).desc(), *[F.col(c).asc() for c in key]],
    )
    before = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(by)
    offsets = (
        blocks.groupBy(by, "_block")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_value").alias("v"))
        .select(
            by,
            "_block",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
            F.coalesce(F.sum("v").over(before), F.lit(0.0)).alias("v_before"),
            F.sum("n").over(whole).alias("n_all"),
            F.sum("v").over(whole).alias("v_all"),
        )
    )
    inside = Window.partitionBy(by, "_block").orderBy("_position").rowsBetween(Window.unboundedPreceding, 0)
    running = blocks.select(
        by, "_block", F.row_number().over(Window.partitionBy(by, "_block").orderBy("_position")).alias("n_in"), F.sum("_value").over(inside).alias("v_in")
    ).join(offsets, [by, "_block"])
    place = F.col("n_before") + F.col("n_in")
    # Part p ends at row ceil(p * n / steps); a row may end several parts of a short list.
    first = F.floor((place - 1) * steps / F.col("n_all")).cast("int") + 1
    last = F.floor(place * steps / F.col("n_all")).cast("int")
    parts = F.explode(F.when(first <= last, F.sequence(first, last)))
    cuts = running.select(by, parts.alias("part"), place.alias("rows"), (F.col("v_before") + F.col("v_in")).alias("captured"), "v_all")
    return cuts.select(by, "part", "rows", "captured", ratio_or_zero(F.col("captured"), F.col("v_all")).alias("share"))
