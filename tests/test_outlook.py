from __future__ import annotations

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from signals.operators.horizon import (
    direct_rows, fit_direct, latest_origin, naive_direct, predict_direct, reconciled_days, weekday_shares, weekly_totals,
)
from signals.operators.intervals import (
    conformal_bounds, fold_histories, forecast_interval, horizon_errors, naive_forecasters, pooled_bounds,
)
from signals.operators.smoothing import smoothed_state, smoothing_features, smoothing_forecast

START = date(2023, 1, 4)
SERIES = ["s"]


def revenue(i, s):
    return 100 + 10 * s + 20 * ((i + s) % 7) + random.Random(1000 * s + i).gauss(0, 5)


@pytest.fixture(scope="module")
def values():
    return {s: [revenue(i, s) for i in range(260 if s < 3 else 6)] for s in (1, 2, 3)}


@pytest.fixture(scope="module")
def kpis(spark, values):
    rows = [(str(s), START + timedelta(i), v, 1, 1, 0.0, v) for s, vs in values.items() for i, v in enumerate(vs)]
    schema = "s string, data date, faturamento_total double, numero_pedidos int, clientes_unicos int, valor_pedido_fabrica double, ticket_medio double"
    return spark.createDataFrame(rows, schema)


def test_histories_hold_the_rows_before_each_origin(kpis):
    got = {}
    for r in fold_histories(kpis, SERIES, 0.6, 20, 15).collect():
        got.setdefault((r.s, r.fold), []).append((r.data - START).days)
    starts, n = [], int(260 * 0.6)
    while n + 20 <= 260:
        starts.append(n)
        n += 15
    assert got.keys() == {(s, f + 1) for s in "12" for f in range(len(starts))}
    assert all(sorted(v) == list(range(starts[f - 1] - 30, starts[f - 1])) for (_, f), v in got.items())


def test_bounds_are_ranks_of_earlier_errors(spark):
    errors = [("a", f, 0.0, float(f)) for f in range(1, 11)] + [("b", 1, 0.0, 1.0)]
    df = spark.createDataFrame(errors, "k string, fold int, actual double, pred double")
    got = {r.k: r for r in conformal_bounds(df, ["k"], alpha=0.2, calibration=0.7).collect()}
    # Of the errors 1..7 the ceil(8 * 0.8)-th is 7; none of 8, 9, 10 is within.
    assert (got["a"].bound, got["a"].n, got["a"].tested, got["a"].coverage) == (7.0, 7, 3, 0.0)
    assert (got["b"].bound, got["b"].n, got["b"].coverage) == (None, 0, None)
    whole = {r.k: r for r in conformal_bounds(df, ["k"], alpha=0.2, calibration=1.0).collect()}
    assert whole["a"].bound == 9.0 and whole["a"].coverage is None


def test_interval_of_naive_models(kpis, values):
    out = forecast_interval(kpis, naive_forecasters(10), SERIES, alpha=0.2, test_size=10, step=10).collect()
    assert len(out) == 3 * 2 * 10
    known = [r for r in out if r.s in "12"]
    assert all(r.lower <= r.pred_faturamento <= r.upper and math.isclose(r.upper - r.pred_faturamento, r.bound) for r in known)
    assert all(r.n == 7 and r.tested == 3 for r in known)
    short = [r for r in out if r.s == "3"]
    assert short and all(r.bound is None and r.lower is None for r in short)
    # The seasonal model repeats the week, so its errors stay small next to the mean's.
    width = {m: sum(r.bound for r in known if r.model == m) for m in ("naive_lag7", "naive_rolling7")}
    assert width["naive_lag7"] < width["naive_rolling7"]


def test_pooled_bounds_are_quantiles(kpis):
    errors = horizon_errors(kpis, naive_forecasters(5), SERIES, test_size=10, step=10)
    got = {(r.model, r.horizon): r for r in pooled_bounds(errors, ["model", "horizon"], 0.1).collect()}
    relative = {}
    for r in errors.collect():
        relative.setdefault((r.model, r.horizon), []).append(abs(r.actual - r.pred) / r.pred)
    for k, v in relative.items():
        assert got[k].n == len(v) and math.isclose(got[k].bound, sorted(v)[math.ceil(0.9 * len(v)) - 1])


def test_weeks_and_direct_rows(kpis, values):
    weeks = {r.s: r for r in weekly_totals(kpis, SERIES).collect()}
    first = date(2023, 1, 9)
    assert set(weeks) == {"1", "2"} and weeks["1"].first_week == first and len(weeks["1"].totals) == 36
    for s in (1, 2):
        sums = [sum(values[s][5 + 7 * k : 12 + 7 * k]) for k in range(36)]
        assert all(math.isclose(a, b) for a, b in zip(weeks[str(s)].totals, sums, strict=True))
    rows = direct_rows(weekly_totals(kpis, SERIES), SERIES).where("s = '1'").collect()
    assert len(rows) == 25 * 8
    totals = list(weeks["1"].totals)
    for r in rows:
        at = (r.origin - first).days // 7
        assert math.isclose(r.lag_2, totals[at - 2]) and math.isclose(r.mean_12, sum(totals[at - 11 : at + 1]) / 12)
        ahead = at + r.horizon
        assert (r.week - r.origin).days == 7 * r.horizon
        assert (r.target is None) == (ahead >= 36) and (r.target is None or math.isclose(r.target, totals[ahead]))
        assert math.isclose(r.last_year, r.mean_4)  # under a year of weeks


@pytest.mark.parametrize("learned", [False, True])
def test_days_add_up_to_their_week(kpis, learned):
    rows = direct_rows(weekly_totals(kpis, SERIES), SERIES)
    keep = [*SERIES, "horizon", "week"]
    future = latest_origin(rows, SERIES)
    if learned:
        model = fit_direct(rows, LinearRegression(featuresCol="_features", labelCol="target", regParam=0.1))
        weekly = predict_direct(model, future, keep, "linear")
    else:
        weekly = naive_direct(future, keep)
    days = reconciled_days(weekly, weekday_shares(kpis, SERIES), SERIES)
    sums = days.groupBy(*SERIES, "model", "horizon").agg(F.sum("pred_day").alias("d"), F.max("pred").alias("w"), F.count("data").alias("n"))
    got = sums.collect()
    assert len(got) == 2 * 8 * (1 if learned else 2)
    assert all(r.n == 7 and math.isclose(r.d, r.w, rel_tol=1e-12) for r in got)
    assert days.agg(F.min("data")).first()[0].weekday() == 0


def plain_smoothing(values, a=0.3, b=0.05, g=0.2):
    level, trend, season, out = sum(values[:7]) / 7, 0.0, {}, []
    for i, v in enumerate(values[:7]):
        season[(START + timedelta(i)).weekday()] = v - level
    for i, v in enumerate(values[7:], start=7):
        w = (START + timedelta(i)).weekday()
        out.append((level + trend + season[w], level, season[w]))
        new = a * (v - season[w]) + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend
        season[w] = g * (v - new) + (1 - g) * season[w]
        level = new
    return out, level, trend, season


def test_smoothing_equals_a_plain_loop(kpis, values):
    got = {(r.s, r.data): r for r in smoothing_features(kpis, SERIES).collect()}
    ahead = {(r.s, r.data): r.pred_faturamento for r in smoothing_forecast(kpis, 10, SERIES).collect()}
    assert {s for s, _ in got} == {"1", "2"} and len(got) == 2 * 253 and len(ahead) == 20
    for s in (1, 2):
        days, level, trend, season = plain_smoothing(values[s])
        for i, (expected, was, part) in enumerate(days, start=7):
            r = got[str(s), START + timedelta(i)]
            assert math.isclose(r.hw_expected, expected) and math.isclose(r.hw_level, was) and math.isclose(r.hw_season, part, abs_tol=1e-9)
        for h in range(1, 11):
            day = START + timedelta(259 + h)
            assert math.isclose(ahead[str(s), day], level + h * trend + season[day.weekday()])
    assert smoothed_state(kpis.limit(0), SERIES).count() == 0
