from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from signals.operators.drift import drift_report, drift_status, revenue_drift

SIDES = "side string, x double"


def report(spark, ref, cur, **options):
    data = [("r", None if v is None else float(v)) for v in ref] + [("c", None if v is None else float(v)) for v in cur]
    df = spark.createDataFrame(data, SIDES)
    return drift_report(df, ["x"], F.col("side") == "r", F.col("side") == "c", **options).first()


def index(ref, cur, edges, closed=False):
    ref, cur = np.array(ref, float), np.array(cur, float)

    def share(v):
        b = np.searchsorted(edges, v, side="left") - 1
        if closed:
            b = np.clip(b, 0, len(edges) - 2)
        b = b[(b >= 0) & (b < len(edges) - 1)]
        return np.bincount(b, minlength=len(edges) - 1) / len(b)

    p, q = share(ref), share(cur)
    return sum((b - a) * math.log(b / a) for a, b in zip(p, q) if a > 0 and b > 0)


def samples():
    rng = np.random.default_rng(0)
    return rng.normal(0, 1, 300).round(4), rng.normal(0.4, 1.2, 120).round(4)


def test_report_against_numpy(spark):
    ref, cur = samples()
    r = report(spark, ref, cur)
    both = np.concatenate([ref, cur])
    edges = np.linspace(both.min(), both.max(), 11)
    assert r["psi"] == pytest.approx(index(ref, cur, edges, closed=True), abs=1e-4)
    shift = abs(cur.mean() - ref.mean()) / ref.std(ddof=1)
    assert r["mean_shift_normalized"] == pytest.approx(shift, abs=1e-4)
    assert r["ref_std"] == pytest.approx(ref.std(ddof=1), abs=1e-4) and r["status"] == "ALERT"


def test_constant_feature(spark):
    r = report(spark, [3, 3, 3], [3, 3])
    assert (r["psi"], r["mean_shift_normalized"], r["status"]) == (0.0, 0.0, "OK")


def test_one_reference_row(spark):
    r = report(spark, [3], [3, 3])
    assert r["ref_std"] is None and r["mean_shift_normalized"] is None and r["status"] == "OK"


def test_feature_without_values_is_left_out(spark):
    assert report(spark, [None], [1, 2]) is None


def test_empty_bins(spark):
    ref, cur = [0] * 50 + [10], [0] * 10 + [5] * 10 + [10]
    skipped, filled = report(spark, ref, cur)["psi"], report(spark, ref, cur, epsilon=1e-4)["psi"]
    assert filled > skipped


def test_status_limits(spark):
    data = [(0.2, 0.3), (0.21, 0.0), (0.0, 0.31), (0.11, 0.0), (0.0, 0.16), (0.1, 0.15), (0.0, None)]
    df = spark.createDataFrame(data, "p double, s double")
    got = [r[0] for r in df.select(drift_status(F.col("p"), F.col("s"))).collect()]
    assert got == ["WARNING", "ALERT", "ALERT", "WARNING", "WARNING", "OK", "OK"]


def test_revenue_drift_needs_both_sides(spark):
    one = spark.sql("select date'2024-01-01' data, 5.0D faturamento_total")
    assert revenue_drift(one).count() == 0
    many = spark.sql("select date_add(date'2024-01-01', cast(id as int)) data, double(id) faturamento_total from range(20)")
    r = revenue_drift(many).first()
    assert r["ref_mean"] == 7.5 and r["current_mean"] == 17.5 and r["status"] == "ALERT"
