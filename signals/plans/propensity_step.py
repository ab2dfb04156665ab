"""Step 2: propensity dataset, model, campaign list and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame

from signals.columns import SNAPSHOT
from signals.operators.campaign import campaign_list, fit_propensity, score_with, scored_list
from signals.operators.evaluation import (
    propensity_metrics,
    recall_by_snapshot,
    uplift_detail,
    uplift_summary,
    uplift_vs_baseline,
)
from signals.operators.panel import propensity_panel, scoring_base
from signals.operators.ranking import long_scores, recency_score
from signals.operators.splits import held_out_rows, split_by_date, training_rows
from signals.operators.tables import require_rows
from signals.plans.workspace import Workspace
from signals.sources.models import load_model, save_model
from signals.sources.scratch import write_once

BASELINE = "baseline_recency"


def scored_test_rows(ws: Workspace) -> DataFrame:
    """Test rows with model and baseline score, written once for the three evaluations."""
    split = split_by_date(ws.table("propensity_dataset"), SNAPSHOT, ws.sizes.train_ratio)
    test = recency_score(held_out_rows(split))
    return write_once(score_with(load_model(ws.path("propensity_model")), test, "score_model"))


def train(ws: Workspace) -> None:
    """The panel is written once, partitioned by snapshot; later steps prune on it."""
    s = ws.sizes
    panel = ws.save(
        propensity_panel(
            ws.table("compras_clientes_clean"),
            ws.cols,
            s.label_days,
            s.lookback_days,
            s.short_lookback_days,
            one_row_per_order=s.one_row_per_order,
        ),
        "propensity_dataset",
        SNAPSHOT,
    )
    require_rows(panel, "the propensity dataset")
    split = split_by_date(panel, SNAPSHOT, s.train_ratio)
    require_rows(held_out_rows(split), "the test part")
    model = fit_propensity(
        training_rows(split),
        trees=s.propensity_trees,
        depth=s.propensity_depth,
        seed=s.seed,
    )
    save_model(model, ws.path("propensity_model"))


def score(ws: Workspace) -> None:
    """The weekly list: every customer scored, and the top of the list."""
    s = ws.sizes
    base = scoring_base(
        ws.table("compras_clientes_clean"),
        cols=ws.cols,
        lookback_days=s.lookback_days,
        short_lookback_days=s.short_lookback_days,
        one_row_per_order=s.one_row_per_order,
    )
    scored = write_once(score_with(load_model(ws.path("propensity_model")), base))
    require_rows(scored, "the scoring base")
    customers = ws.table("clientes_clean")
    ws.report(scored_list(scored, customers, ws.cols.customer), "propensity_scoring", small=False)
    top = campaign_list(scored, customers, s.campaign_size, ws.cols.customer)
    ws.report(top.orderBy("rank"), "campanha_top100")


def evaluate(ws: Workspace) -> None:
    key = ws.cols.customer
    split = split_by_date(ws.table("propensity_dataset"), SNAPSHOT, ws.sizes.train_ratio)
    test = scored_test_rows(ws)
    keep = [key, SNAPSHOT, "target_recompra_30d"]

    pooled = long_scores(test, {BASELINE: "score_baseline", "random_forest": "score_model"}, keep)
    ws.report(propensity_metrics(training_rows(split), pooled, key, BASELINE), "propensity_metrics")
    ws.report(recall_by_snapshot(test, key, "score_model").orderBy("k"), "propensity_recall_at_k_by_snapshot")

    strategies = long_scores(test, {"model": "score_model", BASELINE: "score_baseline"}, keep)
    detail = write_once(uplift_detail(strategies, key))
    summary = uplift_summary(detail)
    ws.report(detail, "campaign_uplift_detail")
    ws.report(summary.orderBy("k", "strategy"), "campaign_uplift_summary")
    ws.report(uplift_vs_baseline(summary).orderBy("k"), "campaign_uplift_vs_baseline")


def run_propensity_step(ws: Workspace) -> None:
    train(ws)
    score(ws)
    evaluate(ws)
