"""The panel dealt by spans of weeks, and kept up a few snapshots at a time."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from signals.columns import SNAPSHOT, PurchaseCols
from signals.operators import incremental
from signals.operators.incremental import refresh_panel
from signals.operators.panel import propensity_panel
from signals.sources.scratch import shuffles_dropped
from signals.sources.tables import write_table

COLS = PurchaseCols()
SIZES = {"horizon_days": 20, "lookback_days": 40, "short_lookback_days": 10}


@pytest.fixture(scope="module")
def bought(spark):
    """Two hundred purchases of a year, orders of several days among them, some columns null."""
    rows = spark.range(200).selectExpr(
        "CASE WHEN id % 37 <> 5 THEN concat('c', id * 7 % 23) END AS id_cliente",
        "concat('o', id * 11 % 150) AS id_pedido",
        "CASE WHEN id % 41 <> 7 THEN timestamp'2023-06-01 10:30:00' + make_dt_interval(CAST(id * 53 % 365 AS INT)) END AS data_compra",
        "CAST(id % 13 AS DOUBLE) AS valor_total",
    )
    return rows.cache()


def plain(rows, df):
    names = sorted(df.columns)
    return [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows(df.select(*names))]


@pytest.mark.parametrize("between", [None, (date(2023, 8, 2), date(2024, 1, 9))])
@pytest.mark.parametrize("weeks, single", [(1, False), (3, True), (26, False)])
def test_spans_give_the_same_panel(bought, rows, weeks, single, between):
    sizes = {**SIZES, "one_row_per_order": single, "between": between}
    whole = propensity_panel(bought, COLS, **sizes)
    assert plain(rows, propensity_panel(bought, COLS, span_weeks=weeks, **sizes)) == plain(rows, whole) and whole.count() > 50


def test_a_part_holds_few_snapshots(bought):
    """So its rows are written by snapshot where they lie; dealt by customer every part holds all of them."""
    apart = lambda df: df.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct(SNAPSHOT).alias("n")).agg(F.max("n")).first()[0]
    whole, spans = (propensity_panel(bought, COLS, span_weeks=w, **SIZES) for w in (None, 4))
    assert apart(spans) < apart(whole) / 2


@pytest.mark.parametrize("keys", [0, 1000])
def test_refresh_rewrites_few_snapshots_at_once(spark, bought, rows, tmp_path, monkeypatch, keys):
    """The rows written aside are those of two snapshots, whether the buyers' keys are sent to all tasks or not."""
    monkeypatch.setattr(incremental, "SNAPSHOTS_AT_ONCE", 2)
    monkeypatch.setattr(incremental, "BROADCAST_KEYS", keys)
    sizes, seen = [], incremental.replace_snapshots
    monkeypatch.setattr(incremental, "replace_snapshots", lambda p, df: sizes.append(df.select(SNAPSHOT).distinct().count()) or seen(p, df))
    late, new = F.col("id_pedido").isin("o10", "o44"), F.col("data_compra") > F.lit(datetime(2024, 4, 1))
    known, path = bought.where(~late & ~new), str(tmp_path / "panel")
    write_table(propensity_panel(known, COLS, span_weeks=4, **SIZES), path, SNAPSHOT, dealt=True)
    newest = max(r[0] for r in spark.read.parquet(path).select(SNAPSHOT).distinct().collect())
    done = refresh_panel(spark, path, bought, bought.where(late | new), COLS, **SIZES)
    assert len(sizes) > 4 and max(sizes) <= 2 and min(done) < newest < max(done)
    want = propensity_panel(bought, COLS, **SIZES)
    assert plain(rows, spark.read.parquet(path).select(*want.columns)) == plain(rows, want)


def test_shuffles_dropped_keeps_the_setting(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with shuffles_dropped(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == before
