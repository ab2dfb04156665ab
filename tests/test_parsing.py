from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from signals.functions.calendar import calendar_features, next_midnight, weekly_dates, whole_days
from signals.functions.numeric import edge_bin, equal_width_bin, labelled_bin, ratio_or_zero, round4
from signals.functions.text import (
    address_key,
    column_name,
    fold_text,
    parse_count,
    parse_day_first,
    parse_money,
)


def values(spark, texts, expr, kind="string"):
    data = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, f"i int, x {kind}").select("i", expr(F.col("x")).alias("y"))
    return [r["y"] for r in df.orderBy("i").collect()]


def test_money_styles(spark):
    texts = ["1.234,56", "1234,56", "1234.56", "1234", " 1.234,56 ", "-10,5", "", None, "nan", "None"]
    assert values(spark, texts, parse_money) == [1234.56, 1234.56, 1234.56, 1234.0, 1234.56, -10.5, None, None, None, None]


def test_money_rejects(spark):
    assert values(spark, ["1.234.567", "1,234,56", "R$ 10", "1_000", "inf", "1d"], parse_money) == [None] * 6
    assert values(spark, ["1,234.56"], parse_money) == [1.23456]


def test_day_first_dates(spark):
    texts = ["15/03/2024", "5/4/2024", "2024-04-05", "2024-04-05 10:11:12", "5/4/2024 01:02:03", "31/02/2024", "5/4/24", None, "x"]
    expected = [
        datetime(2024, 3, 15),
        datetime(2024, 4, 5),
        datetime(2024, 4, 5),
        datetime(2024, 4, 5, 10, 11, 12),
        datetime(2024, 4, 5, 1, 2, 3),
        None,
        None,
        None,
        None,
    ]
    assert values(spark, texts, parse_day_first) == expected


def test_counts(spark):
    assert values(spark, ["3", "3.7", "-3.7", "", "x", None, " 5 "], parse_count) == [3, 3, -3, 0, 0, 0, 5]


def test_names_and_text(spark):
    assert column_name(" Cód. Cliente ") == "cod_cliente"
    assert column_name("Dt Última Compra") == "dt_ultima_compra"
    assert column_name("Ângulo Avô Ü") == "angulo_avo_u"
    assert values(spark, ["  ÀÉÎõü Ç ", "café"], fold_text) == ["aeiou c", "cafe"]
    assert values(spark, [" Rua A ", None], address_key) == ["rua a", ""]


def test_calendar(spark):
    df = spark.sql("select explode(array(date'2024-12-30', date'2024-03-31', date'2024-06-01')) as data")
    got = {str(r["data"]): r for r in df.withColumns(calendar_features("data")).collect()}
    assert got["2024-12-30"]["semana_ano"] == 1 and got["2024-12-30"]["dia_semana"] == 0
    assert got["2024-03-31"]["is_weekend"] == 1 and got["2024-03-31"]["is_month_end"] == 1
    assert got["2024-06-01"]["is_month_start"] == 1 and got["2024-06-01"]["is_month_end"] == 0


def test_whole_days_and_next_midnight(spark):
    df = spark.sql(
        "select timestamp_ntz'2024-01-01 18:00:00' a, timestamp_ntz'2024-01-02 00:00:00' b, timestamp_ntz'2024-01-02 18:00:00' c"
    )
    r = df.select(
        whole_days(F.col("a"), F.col("b")).alias("ab"),
        whole_days(F.col("a"), F.col("c")).alias("ac"),
        whole_days(F.col("b"), F.col("a")).alias("ba"),
        next_midnight(F.col("a"), "timestamp_ntz").alias("na"),
        next_midnight(F.col("b"), "timestamp_ntz").alias("nb"),
    ).first()
    assert (r["ab"], r["ac"], r["ba"]) == (0, 1, -1)
    assert str(r["na"]) == "2024-01-02" and str(r["nb"]) == "2024-01-02"


def test_weekly_dates(spark):
    df = spark.sql("select date'2024-01-01' lo, date'2024-01-15' hi, date'2024-01-16' lo2, date'2024-01-20' hi2")
    r = df.select(
        weekly_dates(F.col("lo"), F.col("hi")).alias("a"), weekly_dates(F.col("lo2"), F.col("hi2")).alias("b")
    ).first()
    assert [str(x) for x in r["a"]] == ["2024-01-01", "2024-01-08", "2024-01-15"]
    assert r["b"] is None


def test_bins_and_ratios(spark):
    lo, hi = F.lit(0.0), F.lit(10.0)
    assert values(spark, [0.0, 1.0, 1.1, 10.0, 9.99], lambda c: equal_width_bin(c, lo, hi, 10), "double") == [0, 0, 1, 9, 9]
    edges = F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0))
    assert values(spark, [0.0, 0.5, 1.0, 2.0, 2.1], lambda c: edge_bin(c, edges), "double") == [None, 0, 0, 1, None]
    label = lambda c: labelled_bin(c, (-1.0, 0.35, 0.6, 1.0), ("Baixa", "Media", "Alta"))
    assert values(spark, [0.35, 0.36, 0.6, 1.0, 1.1, -1.0], label, "double") == ["Baixa", "Media", "Media", "Alta", None, None]
    assert values(spark, [0.0, 2.0, None], lambda c: ratio_or_zero(F.lit(1.0), c), "double") == [0.0, 0.5, 0.0]
    assert values(spark, [0.00005, 0.00015], round4, "double") == pytest.approx([0.0, 0.0002])
