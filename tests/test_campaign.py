"""The learned score in a session that has observed a table."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from signals.catalog import QUERIES
from signals.catalog.customers import BASE_CTE
from signals.columns import PROPENSITY_FEATURES, SCORE, TARGET, CustomerCols
from signals.operators.campaign import campaign_list, fit_propensity, score_with, training_parts

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def observed(spark):
    """The checked tables observe what they write; from then on the session itself cannot be sent to a task."""
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("rows")).collect()
    assert seen.get["rows"] == 5
    return spark


def test_fitted_forest_scores_rows(observed, tmp_path):
    """Rows scored by a forest just fitted can be shuffled and written, and have the forest's own probabilities."""
    rows = observed.range(400).selectExpr("id", "id % 40 AS recency", f"CAST(id % 40 < 10 AND id % 7 <> 0 AS INT) AS {TARGET}")
    model = fit_propensity(rows, ["recency"], trees=5, depth=3)
    path = str(tmp_path / "scored")
    score_with(model, rows).repartition("recency").write.parquet(path)
    got = {r["id"]: r[SCORE] for r in observed.read.parquet(path).collect()}
    assert len(got) == 400 and min(got[i] for i in range(400) if i % 40 < 10) > max(got[i] for i in range(400) if i % 40 >= 10)
    own = observed.range(40).selectExpr("id", "id AS recency").coalesce(1)
    fitted = model.stages[-1]
    few = [(r["id"], r["_features"]) for r in model.stages[0].transform(own).collect()]
    assert {i: got[i] for i, _ in few} == {i: pytest.approx(fitted.predictProbability(v)[1]) for i, v in few}


def test_list_of_a_fitted_forest(observed):
    """The weekly list ranks, floors and names scores of a forest just fitted: all passes over the scores leave the driver."""
    features = [f"CAST((id * {7 + i}) % 40 AS DOUBLE) AS {c}" for i, c in enumerate(PROPENSITY_FEATURES)]
    rows = observed.range(400).selectExpr("id AS id_cliente", *features, f"CAST((id * 7) % 40 < 10 AS INT) AS {TARGET}")
    people = observed.range(0, 400, 2).selectExpr("id AS id_cliente", "concat('name ', id) AS nome_cliente")
    model = fit_propensity(rows, trees=5, depth=3)
    scored = score_with(model, rows.drop(TARGET))
    got = sorted(campaign_list(scored, people, 30, cols=CustomerCols("id_cliente", "nome_cliente")).collect())
    best = sorted(((-r[SCORE], r["id_cliente"]) for r in scored.collect()))[:30]
    assert [(r["rank"], -r[SCORE], r["id_cliente"]) for r in got] == [(i, *b) for i, b in enumerate(best, 1)]
    assert all(r["nome_cliente"] == (None if r["id_cliente"] % 2 else f"name {r['id_cliente']}") for r in got)


@pytest.mark.parametrize("rows, trees, parts", [(1, 50, 32), (1_300_000, 50, 32), (76_100_000, 50, 254), (76_100_000, 300, 1522)])
def test_training_parts_follow_rows_and_trees(rows, trees, parts):
    """Few trees make small rows and get few parts: each part sends the sums of all nodes at every level."""
    assert training_parts(rows, trees) == parts


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data is not here")
def test_query_after_the_observed_report(spark):
    """The registered query in the session of the report that observes: everyone who can be on the list, with SQL's features."""
    assert QUERIES["quality_report_observed"](spark, SF_DIR).count() > 0
    rows = QUERIES["campaign_rf"](spark, SF_DIR, trees=5).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{SF_DIR}/orders.parquet'")
    base = {r[0]: r[1:] for r in con.sql(f"WITH {BASE_CTE} SELECT o_custkey, {', '.join(PROPENSITY_FEATURES)} FROM base").fetchall()}
    assert len(rows) == len({r["o_custkey"] for r in rows}) == min(100, len(base))
    assert all([r[c] for c in PROPENSITY_FEATURES] == pytest.approx(base[r["o_custkey"]]) for r in rows)
    best = sorted((-r[SCORE], r["o_custkey"]) for r in rows)
    assert [(r["rank"], -r[SCORE], r["o_custkey"]) for r in sorted(rows)] == [(i, *b) for i, b in enumerate(best, 1)]
