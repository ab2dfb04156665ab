from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from signals.operators.evaluation import (
    metrics_at_k,
    recall_by_snapshot,
    uplift_detail,
    uplift_summary,
    uplift_vs_baseline,
)
from signals.operators.campaign import campaign_list, priority, scored_list, suggested_action
from signals.operators.ranking import (
    full_ranking,
    group_ranking,
    long_scores,
    ordered_blocks,
    rank_areas,
    recency_score,
    over_floor,
    score_floors,
    top_k,
    top_rows,
)
from signals.operators.splits import (
    cutoff_date,
    fold_rows,
    held_out_rows,
    split_by_date,
    split_by_rows,
    training_rows,
    walk_forward_folds,
    with_positions,
)


@pytest.fixture
def many_blocks(spark):
    """Keep small shuffles apart, so that block offsets matter."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def scored(spark, y, s, strategy="m"):
    data = [(i, strategy, a, float(b)) for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(data, "id int, strategy string, y int, score double")


def areas(df):
    r = rank_areas(df, "y").first()
    return r["pr_auc"], r["roc_auc"]


def test_reference_vector(spark):
    y = [1, 0, 1, 0, 1, 0, 1, 0, 0, 0]
    s = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05]
    ap, auc = areas(scored(spark, y, s))
    assert ap == pytest.approx(0.709524, abs=1e-6) and auc == pytest.approx(0.75)


def test_areas_with_heavy_ties_match_pairs(spark, many_blocks):
    rng = random.Random(3)
    y = [int(rng.random() < 0.3) for _ in range(600)]
    s = [0.5 if rng.random() < 0.4 else round(rng.random(), 2) for _ in y]
    ap, auc = areas(scored(spark, y, s))
    pos = [b for a, b in zip(y, s) if a]
    neg = [b for a, b in zip(y, s) if not a]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    expected = 0.0
    for t in sorted(set(s), reverse=True):
        chosen = [a for a, b in zip(y, s) if b >= t]
        gained = sum(a for a, b in zip(y, s) if b == t)
        expected += gained / len(pos) * sum(chosen) / len(chosen)
    assert auc == pytest.approx(pairs) and ap == pytest.approx(expected)


def test_single_class(spark):
    assert areas(scored(spark, [0, 0], [0.1, 0.2])) == (0.0, None)
    ap, auc = areas(scored(spark, [1, 1], [0.1, 0.2]))
    assert ap == pytest.approx(1.0) and auc is None


def at_k(spark, y, k, s=None):
    df = scored(spark, y, s or [len(y) - i for i in range(len(y))])
    return metrics_at_k(df, ["strategy"], ["id"], "y", ks=(k,)).first()


@pytest.mark.parametrize(
    "y, k, recall", [([1, 1, 1, 0, 0], 3, 1.0), ([0, 0, 1, 1, 1], 2, 0.0), ([0, 0, 0], 2, 0.0), ([1, 1, 0, 0, 0], 5, 1.0)]
)
def test_recall(spark, y, k, recall):
    assert at_k(spark, y, k)["recall_at_k"] == recall


@pytest.mark.parametrize("y, k, precision", [([1, 1, 0, 0], 2, 1.0), ([1, 0, 1, 0], 2, 0.5), ([1, 0, 0, 1], 2, 0.5), ([1, 0], 10, 0.5)])
def test_precision(spark, y, k, precision):
    assert at_k(spark, y, k)["precision_at_k"] == precision


def test_one_group(spark):
    r = metrics_at_k(scored(spark, [1, 0, 1, 0], [4, 3, 2, 1]), [], ["id"], "y", ks=(1,)).first()
    assert (r["k"], r["recall_at_k"], r["precision_at_k"], r["lift_at_k"], r["n"]) == (1, 0.5, 1.0, 2.0, 4)


def test_lift_and_monotone_recall(spark):
    y = [1, 1, 1] + [0] * 7
    assert at_k(spark, y, 3)["lift_at_k"] == pytest.approx(10 / 3)
    alternating = [1, 0, 1, 0, 1, 0, 1, 0]
    found = [at_k(spark, alternating, k)["recall_at_k"] for k in (2, 4, 8)]
    assert found == sorted(found)


def panel(spark):
    rng = random.Random(5)
    data = []
    for week in range(4):
        for i in range(40):
            y = 0 if week == 3 else int(rng.random() < 0.4)
            data.append((i, f"2024-01-{1 + 7 * week:02d}", y, y + rng.random(), rng.randint(0, 5)))
    return spark.createDataFrame(data, "id int, d string, target_recompra_30d int, model double, recency int").select(
        "id", F.to_date("d").alias("snapshot_date"), "target_recompra_30d", "model", "recency"
    )


def test_uplift_tables(spark):
    df = recency_score(panel(spark))
    assert df.agg(F.min("score_baseline")).first()[0] == 0.0
    keep = ["id", "snapshot_date", "target_recompra_30d"]
    long = long_scores(df, {"model": "model", "baseline_recency": "score_baseline"}, keep)
    detail = uplift_detail(long, "id")
    assert detail.count() == 4 * 2 * 3
    empty = detail.filter("snapshot_date = '2024-01-22' and k = 10 and strategy = 'model'").first()
    assert (empty["recall_at_k"], empty["lift_at_k"], empty["positives"], empty["n"]) == (0.0, 0.0, 0, 40)
    summary = uplift_summary(detail)
    best = summary.filter("k = 10 and strategy = 'model'").first()
    assert best["precision_mean"] == pytest.approx(0.75) and best["snapshots"] == 4
    versus = uplift_vs_baseline(summary)
    assert versus.count() == 3 and all(r["lift_model"] >= r["lift_baseline"] for r in versus.collect())
    assert uplift_vs_baseline(summary.filter("strategy = 'model'")).count() == 0
    recall = recall_by_snapshot(long.filter("strategy = 'model'"), "id").orderBy("k").collect()
    assert [r["k"] for r in recall] == [10, 30, 50, 100]
    assert recall[-1]["recall_at_k_mean_by_snapshot"] == pytest.approx(0.75)


def test_full_ranking_cuts_a_shared_score(spark, many_blocks):
    data = [(i, 1.0 if i % 3 else i / 10000) for i in range(2000)]
    df = spark.createDataFrame(data, "id long, score double")
    expected = {i: r for r, (i, _) in enumerate(sorted(data, key=lambda t: (-t[1], t[0])), 1)}
    ranked = full_ranking(df, "score", "id").collect()
    assert {r["id"]: r["rank"] for r in ranked} == expected
    blocks = ordered_blocks(df, [F.col("score").desc(), F.col("id").asc()])
    assert blocks.select("_block").distinct().count() == 4
    assert blocks.filter("score = 1.0").select("_block").distinct().count() > 1
    top = top_k(df, "score", "id", 5).orderBy("rank").collect()
    assert [(r["rank"], r["id"]) for r in top] == [(1, 1), (2, 2), (3, 4), (4, 5), (5, 7)]


def test_group_ranking_and_large_k(spark, many_blocks):
    rng = random.Random(9)
    data = [("hot" if rng.random() < 0.6 else f"g{rng.randint(0, 3)}", i, round(rng.random(), 1)) for i in range(1500)]
    df = spark.createDataFrame(data, "g string, id int, score double")
    expected = {}
    for g in {r[0] for r in data}:
        rows = sorted((-s, i) for h, i, s in data if h == g)
        expected.update({i: n for n, (_, i) in enumerate(rows, 1)})
    ranked = group_ranking(df, ["g"], [F.col("score").desc(), F.col("id").asc()]).collect()
    assert {r["id"]: r["_rn"] for r in ranked} == expected
    for k in (700, 1200):
        top = top_rows(df, ["g"], "score", ["id"], k).collect()
        assert {r["id"]: r["_rn"] for r in top} == {i: n for i, n in expected.items() if n <= k}


@pytest.mark.parametrize("bins", [2, 16])
def test_score_floors_narrow_to_the_kth_score(spark, bins):
    rng = random.Random(4)
    data = [("hot" if rng.random() < 0.6 else f"g{rng.randint(0, 3)}", i, rng.choice([rng.gauss(0, 1), 0.5, 1e6 * rng.random()])) for i in range(900)]
    data += [(None, 2000 + i, float(i)) for i in range(30)] + [("g0", 3000, None), ("few", 3001, 1.0), ("same", 3002, 7.0)]
    data += [("same", 4000 + i, 7.0) for i in range(50)]
    df = spark.createDataFrame(data, "g string, id int, score double")
    floors = {r["g"]: r["floor"] for r in score_floors(df, ["g"], "score", 10, bins=bins, rounds=60, spare=0).collect()}
    assert "few" not in floors
    for g, floor in floors.items():
        scores = sorted((s for h, _, s in data if h == g and s is not None), reverse=True)
        held = sum(s >= floor for s in scores)
        assert held >= 10 and floor <= scores[9]
    # At most twice the rows wanted are left over, but for scores that many rows share.
    assert sum(s >= floors[g] for g, _, s in data if g in floors and g != "same" and s is not None) <= 2 * 10 * len(floors) + 330
    left = {r["id"] for r in over_floor(df, ["g"], "score", 10).collect()}
    assert {3000, 3001} <= left | {3000} and 3001 in left
    top = top_rows(df, ["g"], "score", ["id"], 10).collect()
    expected = {}
    for g in {r[0] for r in data}:
        ranked = sorted((s is None, -(s or 0), i) for h, i, s in data if h == g)
        expected.update({i: n for n, (_, _, i) in enumerate(ranked[:10], 1)})
    assert {r["id"]: r["_rn"] for r in top} == expected


def test_campaign_list(spark):
    data = [(str(i), i / 10, 30 if i % 2 else 3, 1, 1.0, 1.0, 0.5) for i in range(11)]
    columns = (
        "id_cliente string, score_recompra_30d double, recency int, frequency_lookback int, monetary_lookback double,"
        " ticket_medio_lookback double, tendencia_gasto_lookback double"
    )
    df = spark.createDataFrame(data, columns)
    people = spark.createDataFrame(
        [("10", "Bia"), ("10", "Ana"), ("9", "Caio"), ("1", None)], "id_cliente string, nome_cliente string"
    )
    out = campaign_list(df, people, size=8).orderBy("rank").collect()
    assert len(out) == 8
    assert tuple(out[0])[:6] == (1, "10", "Ana", 1.0, "Alta", "Oferta premium")
    assert tuple(out[1])[:6] == (2, "9", "Caio", 0.9, "Alta", "Reativacao imediata")
    assert tuple(out[4])[1:6] == ("6", None, 0.6, "Media", "Campanha de relacionamento")
    assert out[7]["prioridade"] == "Baixa" and out[7]["acao_sugerida"] == "Contato padrao"
    whole = scored_list(df, people).orderBy("rank").collect()
    assert len(whole) == 11 and [tuple(r) for r in whole[:8]] == [tuple(r) for r in out]
    assert campaign_list(df, people, size=50).count() == 11


def test_priority_outside_range_is_null(spark):
    df = spark.createDataFrame([(1.5, 3)], "s double, r int")
    row = df.select(priority(F.col("s")).alias("p"), suggested_action(priority(F.col("s")), F.col("r")).alias("a")).first()
    assert tuple(row) == (None, "Contato padrao")


def test_split_by_date(spark):
    data = [(f"2024-{1 + i // 4:02d}-{1 + 7 * (i % 4):02d}", x) for i in range(10) for x in range(3)]
    df = spark.createDataFrame(data, "d string, x int").select(F.to_date("d").alias("snapshot_date"), "x")
    out = split_by_date(df)
    train, test = training_rows(out), held_out_rows(out)
    assert (train.count(), test.count()) == (24, 6)
    assert train.agg(F.max("snapshot_date")).first()[0] < test.agg(F.min("snapshot_date")).first()[0]
    later = split_by_date(df, embargo_days=14)
    assert training_rows(later).count() == 18 and held_out_rows(later).count() == 6
    with pytest.raises(TypeError):
        cutoff_date(df.withColumn("t", F.lit("2024-01-01").cast("timestamp")), "t")


def test_split_by_rows(spark):
    df = spark.range(100).withColumnRenamed("id", "v")
    out = split_by_rows(df, "v")
    assert training_rows(out).count() == 80
    assert training_rows(out).agg(F.max("v")).first()[0] == 79
    assert training_rows(split_by_rows(spark.range(1), "id")).count() == 1
    assert training_rows(split_by_rows(spark.range(1), "id", at_least=0)).count() == 0


@pytest.mark.parametrize("n, size, step", [(100, 30, 30), (100, 10, 5), (100, 10, 17), (20, 30, 30), (75, 30, 30), (76, 30, 30)])
def test_folds_and_fold_rows_agree(spark, n, size, step):
    df = spark.range(n).withColumnRenamed("id", "v")
    folds = walk_forward_folds(df, test_size=size, step=step).orderBy("fold").collect()
    start, expected = int(n * 0.6), []
    while start + size <= n:
        expected.append((len(expected) + 1, 0, start, start, start + size))
        start += step
    assert [tuple(r) for r in folds] == expected
    got = fold_rows(with_positions(df, "v"), 0.6, size, step).select("fold", "v").collect()
    wanted = {(f, v) for f, _, _, lo, hi in expected for v in range(lo, hi)}
    assert {tuple(r) for r in got} == wanted and len(got) == len(wanted)


def test_nan_free_scores(spark):
    assert not math.isnan(areas(scored(spark, [1, 0], [0.0, 0.0]))[1])
