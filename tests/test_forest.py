"""The forest grown on counted cells of binned features."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from signals.catalog import QUERIES
from signals.columns import SCORE, TARGET
from signals.operators import campaign, forest
from signals.operators.campaign import fit_propensity, score_with
from signals.sources.models import feature_list, load_model, save_model

SF_DIR = "/root/testdata/sf0.001"
NAMES = ["recency", "frequency_lookback"]


@pytest.fixture
def rows(spark):
    """Eight copies of 400 rows; recency under 10 buys, six times in seven."""
    label = f"CAST(id % 40 < 10 AND id % 7 <> 0 AS INT) AS {TARGET}"
    return spark.range(3200).selectExpr("id", "(id % 40) / 3 AS recency", "id % 3 AS frequency_lookback", label)


def scores(model, rows):
    return {(r["recency"], r["frequency_lookback"]): r[SCORE] for r in score_with(model, rows).collect()}


def test_many_rows_are_grown_from_cells(rows, monkeypatch, tmp_path):
    """Over the limit no row reaches MLlib, only cells; the forest tells buyers as the one grown from rows does, and can be stored."""
    of_rows = scores(fit_propensity(rows, NAMES, trees=20, depth=4), rows)
    monkeypatch.setattr(campaign, "COUNTS_OF_ROWS", 3200 * 20 - 1)
    sizes = []
    fit = RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, df: sizes.append(df.count()) or fit(self, df))
    model = fit_propensity(rows, NAMES, trees=20, depth=4)
    assert len(sizes) == 20 and max(sizes) <= 160 and model.stages[-1].getNumTrees == len(model.stages[-1].trees) == 20
    got = scores(model, rows)
    assert all(abs(got[k] - of_rows[k]) < 0.15 for k in got) and all((got[k] > 0.5) == (k[0] < 10 / 3) for k in got)
    save_model(model, str(tmp_path / "model"))
    again = load_model(str(tmp_path / "model"))
    assert feature_list(model) == feature_list(again) == NAMES and scores(again, rows) == got


def test_cells_give_the_same_forest_in_any_order(rows, monkeypatch):
    """Samples follow from the cells and not from where the rows lie."""
    monkeypatch.setattr(campaign, "COUNTS_OF_ROWS", 0)
    one = scores(fit_propensity(rows.coalesce(1), NAMES, trees=4, depth=4), rows)
    assert one == scores(fit_propensity(rows.orderBy(F.rand(1)).repartition(7), NAMES, trees=4, depth=4), rows)


def test_every_row_is_in_a_cell(rows):
    """The cells' counts in a tree's sample add up to about the rows, and differ between trees; odd values keep a bin."""
    odd = rows.withColumn("recency", F.when(F.col("id") % 400 == 1, 1e9).when(F.col("id") % 400 == 2, -0.0).otherwise(F.col("recency")))
    binner = forest.fit_binner(odd, 3200, NAMES, TARGET, F.lit(1.0))
    cells = forest.counted_cells(odd, binner, TARGET, 30, 1)
    sums = np.array(cells.agg(*[F.sum(f"_n{t}") for t in range(30)]).first())
    assert abs(sums.mean() - 3200) < 60 and 20 < sums.std() < 120
    assert [len(x) for x in binner.getSplitsArray()] == [33, 4]


@pytest.mark.parametrize("values, edges", [([5, 5], [5]), ([1, 3, 3], [2]), ([1, 2, 4, 8], [1.5, 3, 6])])
def test_edges_of_few_values(values, edges):
    assert forest.bin_edges(np.array(values, float), np.ones(len(values))) == edges


def test_edges_of_many_values_are_weighted_quantiles():
    values = np.arange(1000.0)
    edges = forest.bin_edges(values, np.where(values < 500, 3.0, 1.0))
    assert len(edges) == 31 and sum(e < 500 for e in edges) == pytest.approx(24, abs=1)
    assert forest.bin_edges(np.array([0.0] * 1000 + [*range(1, 100)]), np.ones(1099))[0] == 0.5


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data is not here")
def test_campaign_of_many_rows(spark, monkeypatch):
    """The registered list, its forest grown from cells: the same customers as by rows where all are listed, ranked by score."""
    of_rows = QUERIES["campaign_rf"](spark, SF_DIR, trees=4).collect()
    monkeypatch.setattr(campaign, "COUNTS_OF_ROWS", 0)
    got = sorted(QUERIES["campaign_rf"](spark, SF_DIR, trees=4).collect())
    assert [r["rank"] for r in got] == list(range(1, len(of_rows) + 1)) and len({r[SCORE] for r in got}) > 5
    assert [-r[SCORE] for r in got] == sorted(-r[SCORE] for r in got) and all(0 <= r[SCORE] <= 1 for r in got)
    if len(got) < 100:
        plain = lambda rows: sorted((r["o_custkey"], r["c_name"], r["recency"], r["monetary_lookback"]) for r in rows)
        assert plain(got) == plain(of_rows)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data is not here")
def test_metrics_of_many_rows(spark, monkeypatch):
    """The registered metrics, the forest grown from cells: counts, dates and the baseline stay, and the forest is about as good."""
    of_rows = {r["model"]: r.asDict() for r in QUERIES["propensity_rf"](spark, SF_DIR, trees=10).collect()}
    monkeypatch.setattr(campaign, "COUNTS_OF_ROWS", 0)
    got = {r["model"]: r.asDict() for r in QUERIES["propensity_rf"](spark, SF_DIR, trees=10).collect()}
    assert got["baseline_recency"] == of_rows["baseline_recency"]
    forests = [x["random_forest"] for x in (got, of_rows)]
    assert all(forests[0][c] == forests[1][c] for c in ("train_rows", "test_rows", "train_end", "test_start"))
    assert forests[0]["pr_auc"] == pytest.approx(forests[1]["pr_auc"], rel=0.2) and forests[0]["pr_auc"] != forests[1]["pr_auc"]
