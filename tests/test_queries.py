"""Every registered query next to its reference SQL on the smallest test data."""

from __future__ import annotations

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import TABLES, rows_of
from signals.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data is not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, con, name):
    df = queries()[name](spark, SF_DIR)
    expected = con.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(expected.columns, expected.fetchall())


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_propensity_rf(spark, con):
    """Rows, counts and the baseline equal the reference SQL of the formula's metrics; the forest is held against the baseline."""
    got = {r["model"]: r.asDict() for r in QUERIES["propensity_rf"](spark, SF_DIR, trees=20).collect()}
    expected = {r["model"]: r for r in con.sql(oracle_sql()["propensity_metrics"]).df().to_dict("records")}
    assert set(got) == {"random_forest", "baseline_recency"}
    for name, row in got.items():
        other = expected["baseline_recency" if name == "baseline_recency" else "model"]
        assert (row["train_rows"], row["test_rows"]) == (other["train_rows"], other["test_rows"])
        assert row["train_end"] < row["test_start"] and 0 < row["pr_auc"] <= 1 and 0 <= row["recall_at_50"] <= 1
    assert got["baseline_recency"]["pr_auc"] == pytest.approx(expected["baseline_recency"]["pr_auc"])
    assert got["random_forest"]["pr_auc"] > 0.9 * got["baseline_recency"]["pr_auc"]


def test_campaign_rf(spark):
    rows = sorted(QUERIES["campaign_rf"](spark, SF_DIR, trees=20).collect(), key=lambda r: r["rank"])
    known = {r["c_custkey"]: r["c_name"] for r in spark.read.parquet(f"{SF_DIR}/customer.parquet").collect()}
    scores = [r["score_recompra_30d"] for r in rows]
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and 0 < len(rows) <= 100
    assert scores == sorted(scores, reverse=True) and all(0 <= s <= 1 for s in scores) and len(set(scores)) > 5
    assert all(known[r["o_custkey"]] == r["c_name"] for r in rows)


SMALL = {"forest_trees": 10, "forest_depth": 5, "boost_rounds": 5, "boost_depth": 3}


def test_forecast_rf_backtest(spark, con):
    got = {(r["c_mktsegment"], r["model"]): r for r in QUERIES["forecast_rf_backtest"](spark, SF_DIR, sizes=SMALL).collect()}
    naive = con.sql(oracle_sql()["naive_backtest_by_segment"]).df().groupby(["c_mktsegment", "model"])["mae"].mean()
    segments = {s for s, _ in got}
    assert {m for _, m in got} == {"naive_lag7", "naive_rolling7", "random_forest"}
    for (segment, model), mae in naive.items():
        assert got[segment, model]["mae_mean"] == pytest.approx(mae, rel=1e-4)
    # Same-day drivers tell the forest much of the answer, so it must beat both naive models by far.
    assert all(got[s, "random_forest"]["mae_mean"] < 0.7 * naive[s].min() for s in segments)


@pytest.mark.parametrize("name", ["forecast_rf_30d", "forecast_boosted_30d"])
def test_learned_forecasts(spark, con, name):
    rows = QUERIES[name](spark, SF_DIR, sizes=SMALL).collect()
    last = {r["c_mktsegment"]: r for r in con.sql(
        "SELECT c_mktsegment, max(o_orderdate)::DATE AS hi FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"
    ).df().to_dict("records")}
    seen = con.sql(
        "SELECT min(v) lo, max(v) hi FROM (SELECT c_mktsegment, o_orderdate, sum(o_totalprice) v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"
    ).fetchall()[0]
    slack = 0 if name == "forecast_rf_30d" else seen[1] - seen[0]
    assert len(rows) == 30 * len(last)
    for segment, row in last.items():
        own = sorted((r["data"], r["pred_faturamento"]) for r in rows if r["c_mktsegment"] == segment)
        assert [(d - row["hi"].date()).days for d, _ in own] == list(range(1, 31))
        assert all(seen[0] - slack <= p <= seen[1] + slack for _, p in own) and len({p for _, p in own}) > 1


def test_interval_of_smoothing(spark):
    rows = QUERIES["forecast_interval_smoothing"](spark, "/root/testdata/sf0.01").collect()
    assert rows and all(r["lower"] <= r["upper"] and r["lower"] >= 0 for r in rows if r["bound"] is not None)
    held = [r for r in rows if r["coverage"] is not None]
    assert len(held) > len(rows) / 2 and 0.6 < sum(r["coverage"] * r["tested"] for r in held) / sum(r["tested"] for r in held) <= 1
