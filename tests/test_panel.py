from __future__ import annotations

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from signals.columns import PROPENSITY_FEATURES, PurchaseCols
from signals.operators.customers import rfm
from signals.operators.kpis import daily_features, daily_kpis, fill_calendar
from signals.operators.panel import propensity_panel, scoring_base

SCHEMA = "id_cliente string, id_pedido string, data_compra timestamp_ntz, valor_total double"


def synthetic(spark):
    rng = np.random.default_rng(42)
    data = [
        (
            f"C{rng.integers(1, 11):02d}",
            f"P{i:04d}",
            datetime(2024, 1, 1) + timedelta(days=int(rng.integers(0, 200))),
            float(rng.uniform(50, 500)),
        )
        for i in range(100)
    ]
    return spark.createDataFrame(data, SCHEMA)


def messy(spark):
    """Sub-day times, repeated orders on several days, null values and a hot customer."""
    rng = np.random.default_rng(7)
    data = []
    for i in range(400):
        customer = "hot" if i % 3 == 0 else f"C{rng.integers(0, 12)}"
        moment = datetime(2024, 1, 1) + timedelta(hours=int(rng.integers(0, 24 * 120)))
        if i % 5 == 0:
            moment = datetime(moment.year, moment.month, moment.day)
        data.append((customer, f"{customer}-{rng.integers(0, 25)}", moment, None if i % 31 == 0 else float(i % 17)))
    return data


def brute_force(data, horizon, look, short):
    df = pd.DataFrame(data, columns=["c", "o", "t", "v"])
    lo, hi = df.t.min().normalize(), df.t.max().normalize()
    out = {}
    for s in pd.date_range(lo, hi, freq="W-MON"):
        hist = df[(df.t >= s - pd.Timedelta(days=look)) & (df.t <= s)]
        buyers = set(df[(df.t > s) & (df.t <= s + pd.Timedelta(days=horizon))].c)
        for c, g in hist.groupby("c"):
            spend = g.v.sum()
            recent = g[g.t >= s - pd.Timedelta(days=short)].v.sum()
            n = g.o.nunique()
            out[(c, s.date())] = (
                (s - g.t.max()).days,
                n,
                round(spend, 6),
                round(spend / n, 6),
                round(recent / spend, 6) if spend else 0.0,
                int(c in buyers),
            )
    return out


@pytest.mark.parametrize("windows", [(30, 90, 30), (7, 7, 3), (10, 28, 14)])
def test_panel_matches_brute_force(spark, windows):
    data = messy(spark)
    panel = propensity_panel(spark.createDataFrame(data, SCHEMA), PurchaseCols(), *windows)
    got = {
        (r["id_cliente"], r["snapshot_date"]): (
            r["recency"],
            r["frequency_lookback"],
            round(r["monetary_lookback"], 6),
            round(r["ticket_medio_lookback"], 6),
            round(r["tendencia_gasto_lookback"], 6),
            r["target_recompra_30d"],
        )
        for r in panel.collect()
    }
    assert got == brute_force(data, *windows)


def test_panel_paths_agree_when_orders_are_unique(spark, rows):
    df = synthetic(spark)
    columns = ["id_cliente", "snapshot_date", "recency", "frequency_lookback", "target_recompra_30d"]
    assert rows(propensity_panel(df), *columns) == rows(propensity_panel(df, one_row_per_order=True), *columns)


def test_panel_invariants(spark):
    panel = propensity_panel(synthetic(spark)).toPandas()
    assert set(panel.target_recompra_30d) <= {0, 1}
    assert (panel.recency >= 0).all() and (panel.frequency_lookback >= 1).all() and (panel.monetary_lookback >= 0).all()
    assert panel.tendencia_gasto_lookback.between(0, 1).all()
    assert not panel.isna().any().any()
    assert all(d.weekday() == 0 for d in panel.snapshot_date)


def test_panel_does_not_shuffle_snapshot_rows(spark):
    plan = propensity_panel(synthetic(spark), one_row_per_order=True)._jdf.queryExecution().executedPlan().toString()
    before_explode = plan.split("Generate explode")[0]
    assert "Exchange" not in before_explode
    assert plan.count("Exchange hashpartitioning") == 2


def test_empty_panel_keeps_schema(spark):
    panel = propensity_panel(spark.createDataFrame([], SCHEMA))
    assert panel.count() == 0
    assert panel.columns == ["id_cliente", "snapshot_date", *PROPENSITY_FEATURES, "target_recompra_30d"]
    assert scoring_base(spark.createDataFrame([], SCHEMA)).count() == 0


def test_censored_snapshots_can_be_dropped(spark):
    df = synthetic(spark)
    last = df.agg(F.to_date(F.max("data_compra"))).first()[0]
    kept = propensity_panel(df, drop_censored=True).agg(F.max("snapshot_date")).first()[0]
    assert kept + timedelta(days=30) <= last


def test_snapshot_is_midnight(spark):
    """A purchase later on the snapshot day belongs to the label window."""
    data = [
        ("a", "1", datetime(2024, 1, 1), 10.0),
        ("a", "2", datetime(2024, 1, 8, 9), 20.0),
        ("b", "3", datetime(2024, 1, 15), 5.0),
    ]
    panel = propensity_panel(spark.createDataFrame(data, SCHEMA), horizon_days=2)
    r = {(x["id_cliente"], str(x["snapshot_date"])): x for x in panel.collect()}
    assert r["a", "2024-01-08"]["frequency_lookback"] == 1 and r["a", "2024-01-08"]["target_recompra_30d"] == 1
    assert r["a", "2024-01-15"]["recency"] == 6 and r["a", "2024-01-15"]["frequency_lookback"] == 2


def test_scoring_base_skips_last_day_times(spark):
    data = [("a", "1", datetime(2024, 1, 1), 10.0), ("a", "2", datetime(2024, 1, 3, 9), 20.0), ("b", "3", datetime(2023, 9, 1), 1.0)]
    df = spark.createDataFrame(data, SCHEMA)
    got = [tuple(r) for r in scoring_base(df).collect()]
    assert got == [("a", 2, 1, 10.0, 10.0, 1.0)]
    assert [tuple(r) for r in scoring_base(df, date(2024, 1, 3)).collect()] == got
    assert {r["id_cliente"] for r in scoring_base(df, date(2023, 9, 5)).collect()} == {"b"}


def test_rfm(spark, rows):
    data = [
        ("a", "1", datetime(2024, 1, 1, 18), 10.0),
        ("a", "1", datetime(2024, 1, 2, 12), None),
        ("b", "2", datetime(2024, 1, 3, 6), None),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(rfm(df), "id_cliente", "frequency", "monetary", "recency") == [("a", 1, 10.0, 1), ("b", 1, 0.0, 1)]
    people = spark.createDataFrame([("a", "Ana"), ("a", "Ana B")], "id_cliente string, nome_cliente string")
    assert rfm(df, people).count() == 3
    assert rfm(df, people, dedup_customers=True).count() == 2
    fixed = rfm(df, reference=datetime(2024, 1, 10))
    assert rows(fixed, "id_cliente", "recency") == [("a", 7), ("b", 6)]


def test_daily_kpis(spark, rows):
    data = [
        ("a", "1", datetime(2024, 1, 1, 18), 10.0),
        ("a", "1", datetime(2024, 1, 1, 19), 30.0),
        ("b", "2", datetime(2024, 1, 4), 6.0),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    supplies = spark.sql(
        "select * from values ('x', timestamp_ntz'2024-01-01 08:00:00', 5.0D), ('y', timestamp_ntz'2024-01-02', 9.0D)"
        " t(id_pedido, data_pedido, valor_pedido)"
    )
    kpis = daily_kpis(df, supplies)
    assert rows(kpis) == [
        (date(2024, 1, 1), 40.0, 1, 1, 40.0, 5.0),
        (date(2024, 1, 4), 6.0, 1, 1, 6.0, 0.0),
    ]
    assert [r["valor_pedido_fabrica"] for r in daily_kpis(df, supplies.drop("valor_pedido")).collect()] == [0.0, 0.0]
    trailing = daily_features(kpis).orderBy("data").collect()
    assert [r["fat_rolling_7"] for r in trailing] == [40.0, 23.0]
    assert fill_calendar(kpis).count() == 4
