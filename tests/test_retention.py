from __future__ import annotations

import math
import os
import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signals.columns import PROPENSITY_FEATURES, SNAPSHOT, TARGET, PurchaseCols
from signals.operators import as_of
from signals.operators.as_of import attributes_as_of
from signals.operators.enrich import KEY, gazetteer_provider
from signals.operators.gain import captured_by_snapshot, captured_revenue, captured_versus, gain_curve
from signals.operators.incremental import append_to_cache, refresh_panel
from signals.operators.panel import propensity_panel
from signals.operators.retention import activity_islands, inactive_spells, reactivation_by_month, return_curve
from signals.sources.tables import write_table

COLS = PurchaseCols()
SCHEMA = "id_cliente string, id_pedido string, data_compra timestamp_ntz, valor_total double"


@pytest.fixture(scope="module")
def purchases():
    draw = random.Random(11)
    rows = []
    for i in range(900):
        who = "hot" if i % 3 == 0 else f"c{draw.randrange(40)}"
        day = datetime(2023, 1, 2) + timedelta(days=draw.randrange(500), hours=draw.choice([0, 0, 9, 23]))
        rows.append((who, f"o{i}", day, round(draw.uniform(5, 90), 2)))
    rows += [("gone", "g1", datetime(2023, 1, 3), 5.0), ("late", "l1", datetime(2024, 5, 1), 5.0), ("gone", "g2", datetime(2023, 1, 3, 7), 1.0)]
    return rows


@pytest.fixture(scope="module")
def bought(spark, purchases):
    return spark.createDataFrame([*purchases, (None, "x", datetime(2023, 2, 1), 1.0), ("c1", "y", None, 1.0)], SCHEMA)


def spells_of(purchases, gap=60):
    days = defaultdict(set)
    for who, _, at, _ in purchases:
        days[who].add(at.date())
    end = max(d for ds in days.values() for d in ds)
    out = []
    for who, ds in days.items():
        ordered = sorted(ds)
        for a, b in zip(ordered, [*ordered[1:], None], strict=True):
            since = a + timedelta(gap)
            if b is not None and since < b:
                out.append((who, since, b, b, (b - since).days))
            if b is None and since <= end:
                out.append((who, since, None, end, (end - since).days))
    return out


def test_spells_and_islands(bought, purchases):
    got = [tuple(r) for r in inactive_spells(bought, COLS, 60).collect()]
    assert sorted(got, key=str) == sorted(spells_of(purchases), key=str) and any(r[2] is None for r in got)
    islands = activity_islands(bought, COLS, 60).collect()
    by_customer = Counter(r.id_cliente for r in islands)
    ended = Counter(w for w, _, back, _, _ in spells_of(purchases) if back)
    # A gap longer than the limit ends an island and, if another purchase follows, starts the next.
    assert by_customer == {w: 1 + ended[w] for w in {p[0] for p in purchases}}
    assert all(r.first_day <= r.last_day and r.days >= 1 for r in islands)


def test_rates_and_curve(bought, purchases):
    spells = spells_of(purchases)
    frame = inactive_spells(bought, COLS, 60)
    expected = Counter()
    for _, since, back, through, _ in spells:
        month = date(since.year, since.month, 1)
        if month < since:
            month = (month + timedelta(32)).replace(day=1)
        while month <= through:
            key = (month, (month - since).days // 30 * 30)
            expected[key, "n"] += 1
            expected[key, "back"] += back is not None and (back.year, back.month) == (month.year, month.month)
            month = (month + timedelta(32)).replace(day=1)
    got = {(r.month, r.gap_days): (r.inactive, r.reactivated) for r in reactivation_by_month(frame).collect()}
    assert got == {k: (expected[k, "n"], expected[k, "back"]) for k, kind in expected if kind == "n"}
    share = 1.0
    for r in sorted(return_curve(frame, 7).collect(), key=lambda r: r.after_days):
        risk = sum(s[4] // 7 * 7 >= r.after_days for s in spells)
        back = sum(s[4] // 7 * 7 == r.after_days and s[2] is not None for s in spells)
        share *= 1 - back / risk
        assert (r.at_risk, r.returned) == (risk, back) and math.isclose(r.inactive_share, share, abs_tol=1e-12)


def test_no_purchases(bought):
    assert inactive_spells(bought.limit(0)).count() == 0 and activity_islands(bought.limit(0)).count() == 0


@pytest.mark.parametrize("age", [None, 3])
def test_as_of_equals_a_plain_search(spark, age):
    draw = random.Random(age or 1)
    moment = lambda: datetime(2024, 1, 1) + timedelta(hours=draw.randrange(600))
    who = lambda: draw.choice(["hot", "hot", "a", "b", None])
    rows = [(i, who(), moment() if i % 50 else None) for i in range(300)]
    history = [(who(), moment(), n, draw.choice(["x", "y", None])) for n in range(200)]
    history += [("hot", history[0][1], 1000 + n, f"v{n}") for n in range(40)]  # many of one moment
    asked = spark.createDataFrame(rows, "i int, k string, t timestamp_ntz").selectExpr("*", "1 AS _key", "2 AS _value", "3 AS _block")
    known = spark.createDataFrame(history, "who string, seen timestamp_ntz, n int, v string")
    got = attributes_as_of(asked, known, "k", "t", "seen", ["n", "v"], "who", ["n"], age, "at")
    assert got.columns == [*asked.columns, "n", "v", "at"] and got.count() == 300
    for r in got.collect():
        best = max(((s, n, v) for w, s, n, v in history if w is not None and w == r.k and r.t is not None and s <= r.t), default=None, key=lambda x: x[:2])
        if best and age is not None and best[0] < r.t - timedelta(days=age):
            best = None
        assert (r.at, r.n, r.v) == (best or (None, None, None)) and (r._key, r._value) == (1, 2)
    with pytest.raises(ValueError):
        attributes_as_of(asked, known.withColumnRenamed("v", "t"), "k", "t", "seen", ["t"], "who")


def test_as_of_carries_over_blocks(spark, many_blocks, monkeypatch):
    """A key over many blocks: rows in a block without history take the value of a block long before."""
    rows = spark.range(4000).selectExpr("id", "'hot' AS k", "timestampadd(MINUTE, CAST(id AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS t")
    history = spark.createDataFrame([("hot", datetime(2023, 1, 1), "old"), ("hot", datetime(2024, 1, 1, 0, 10), "new")], "k string, s timestamp_ntz, v string")
    seen = {}
    monkeypatch.setattr(as_of, "ordered_blocks", lambda df, order: seen.setdefault("b", many_blocks(df, order)))
    got = {r.id: r.v for r in attributes_as_of(rows, history, "k", "t", "s", ["v"]).collect()}
    assert seen["b"].select("_block").distinct().count() > 3
    assert got == {i: "old" if i < 10 else "new" for i in range(4000)}


@pytest.fixture
def many_blocks(spark):
    from signals.operators.ranking import ordered_blocks

    def run(df, order):
        before = spark.conf.get("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            return ordered_blocks(df, order)
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", before)

    return run


def test_future_value_and_capture(bought, purchases):
    panel = propensity_panel(bought, COLS, future_value="v").collect()
    for r in panel:
        lo = datetime.combine(r[SNAPSHOT], datetime.min.time())
        spent = sum(v for w, _, at, v in purchases if w == r.id_cliente and lo < at <= lo + timedelta(30))
        assert math.isclose(r.v, spent, abs_tol=1e-9) and (r.v > 0) == bool(r[TARGET])


def test_capture_by_hand(spark):
    rows = []
    for day, values in ((1, [5, 3, 2, 0]), (2, [0, 0, 0, 8])):
        for i, v in enumerate(values):
            rows += [("model", f"k{i}", date(2024, 1, day), float(v), 1.0 - i / 10), ("baseline_recency", f"k{i}", date(2024, 1, day), float(v), i / 10)]
    scored = spark.createDataFrame(rows, "strategy string, k string, snapshot_date date, receita_futura double, score double")
    detail = captured_by_snapshot(scored, "k", ks=(1, 2))
    got = {(r.strategy, r.k): (r.captured, r.total, round(r.share, 6), r.share_mean) for r in captured_revenue(detail).collect()}
    assert got["model", 1] == (5.0, 18.0, 0.277778, 0.25) and got["baseline_recency", 2] == (10.0, 18.0, 0.555556, 0.6)
    versus = {r.k: r for r in captured_versus(captured_revenue(detail)).collect()}
    assert versus[1].extra_revenue == -3.0
    curve = {(r.strategy, r.part): (r.rows, r.captured) for r in gain_curve(scored, ["snapshot_date", "k"], steps=4).collect()}
    assert [curve["model", p] for p in (1, 2, 3, 4)] == [(2, 5.0), (4, 8.0), (6, 10.0), (8, 18.0)]
    more = gain_curve(scored.where("k = 'k0'"), ["snapshot_date", "k"], steps=4).where("strategy = 'model'").collect()
    assert sorted((r.part, r.rows) for r in more) == [(2, 1), (4, 2)] or len(more) == 4


def files_of(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


@pytest.mark.parametrize("single", [True, False])
def test_refreshed_panel_equals_a_new_one(spark, tmp_path, bought, purchases, rows, single):
    known = bought.na.drop()
    if not single:
        known = known.unionByName(known.selectExpr("id_cliente", "id_pedido", "data_compra + INTERVAL 3 DAY AS data_compra", "valor_total").sample(0.3, 1))
    known = known.cache()
    cut = datetime(2024, 3, 1)
    late = F.col("id_pedido").isin("o10", "o11")
    batch = F.when(late, 2).when(F.col("data_compra") > F.lit(cut), 1).otherwise(0)
    path = str(tmp_path / "panel")
    sizes = {"horizon_days": 20, "lookback_days": 40, "short_lookback_days": 10, "one_row_per_order": single}
    names = [COLS.customer, SNAPSHOT, *PROPENSITY_FEATURES, TARGET]
    write_table(propensity_panel(known.where(batch == 0), COLS, **sizes), path, SNAPSHOT)
    for n in (1, 2):
        before = files_of(path)
        done = refresh_panel(spark, path, known.where(batch <= n), known.where(batch == n), COLS, **sizes)
        same = {f for f, t in before.items() if files_of(path).get(f) == t}
        touched = {f"{SNAPSHOT}={d}" for d in done}
        assert same == {f for f in before if f.split("/")[-2] not in touched} and same
    want = propensity_panel(known, COLS, **sizes)
    fresh = spark.read.parquet(path).select(*names)
    r = lambda df: [tuple(round(x, 6) if isinstance(x, float) else x for x in t) for t in rows(df.select(*names))]
    assert r(fresh) == r(want)
    assert refresh_panel(spark, path, known, known.limit(0), COLS, **sizes) == []


def test_cache_grows_by_what_is_new(spark, tmp_path):
    path = str(tmp_path / "cache")
    spark.createDataFrame([("rua a", 1.0, 2.0)], f"{KEY} string, lat double, lon double").write.parquet(path)
    known = spark.createDataFrame([("rua a", 9.0, 9.0), ("rua b", 3.0, 4.0)], f"{KEY} string, lat double, lon double")
    people = spark.createDataFrame([("Rua A",), ("rua B ",), ("rua b",), ("rua c",), (None,)], "endereco string")
    before = files_of(path)
    assert [r[KEY] for r in append_to_cache(spark, path, people, gazetteer_provider(known)).collect()] == ["rua b"]
    assert append_to_cache(spark, path, people, gazetteer_provider(known)).count() == 0
    assert before.items() <= files_of(path).items()
    assert sorted(r[KEY] for r in spark.read.parquet(path).collect()) == ["rua a", "rua b"]
