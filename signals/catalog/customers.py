"""Customer queries: profiles, panel, scoring, ranking quality, campaign, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signals.catalog.registry import EVENTS, ORDER_LINES, ORDERS, PEOPLE, as_long, query, rounded, table
from signals.columns import SNAPSHOT, TARGET
from signals.operators.campaign import campaign_list, fit_propensity, score_with, scored_list
from signals.operators.customers import rfm
from signals.operators.drift import drift_summary, panel_drift
from signals.operators.evaluation import (
    propensity_metrics,
    recall_by_snapshot,
    uplift_detail,
    uplift_summary,
    uplift_vs_baseline,
)
from signals.operators.panel import propensity_panel, scoring_base
from signals.operators.ranking import long_scores, rank_areas, recency_score
from signals.operators.reports import campaign_tiles, drift_view, model_tiles, only_priorities, propensity_view
from signals.operators.reports import uplift_tiles, uplift_view
from signals.operators.splits import held_out_rows, split_by_date, training_rows
from signals.operators.tables import first_by_key
from signals.sources.scratch import scratch_path, write_once
from signals.sources.tables import read_report, read_table, write_report, write_table

KEY = ORDERS.customer

# --- shared SQL -------------------------------------------------------------------------


def panel_cte(source: str, key: str, order: str, time: str, value: str, look: int, short: int, horizon: int) -> str:
    return f"""
b AS (SELECT date_trunc('day', min({time})) lo, date_trunc('day', max({time})) hi FROM {source}),
days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS TIMESTAMP) s FROM b),
snaps AS (SELECT s FROM days WHERE isodow(s) = 1),
hist AS (
  SELECT {key}, s, count(DISTINCT {order}) f, sum({value}) m, max({time}) t,
         sum({value}) FILTER (WHERE {time} >= s - INTERVAL {short} DAY) sh
  FROM snaps JOIN {source} ON {time} >= s - INTERVAL {look} DAY AND {time} <= s GROUP BY {key}, s),
fut AS (
  SELECT DISTINCT {key}, s
  FROM snaps JOIN {source} ON {time} > s AND {time} <= s + INTERVAL {horizon} DAY),
panel AS (
  SELECT h.{key}, CAST(h.s AS DATE) snapshot_date,
         CAST(floor(epoch(h.s - t) / 86400) AS BIGINT) recency,
         CAST(f AS BIGINT) frequency_lookback, coalesce(m, 0) monetary_lookback,
         coalesce(m, 0) / f ticket_medio_lookback,
         CASE WHEN coalesce(m, 0) = 0 THEN 0 ELSE coalesce(sh, 0) / m END tendencia_gasto_lookback,
         CAST(fut.{key} IS NOT NULL AS INTEGER) target_recompra_30d
  FROM hist h LEFT JOIN fut ON h.{key} = fut.{key} AND h.s = fut.s)"""


ORDERS_PANEL = panel_cte("orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", 90, 30, 30)
PANEL_SELECT = """snapshot_date, recency, frequency_lookback,
round(monetary_lookback, 2) monetary_lookback, round(ticket_medio_lookback, 6) ticket_medio_lookback,
round(tendencia_gasto_lookback, 6) tendencia_gasto_lookback"""
# A fixed score both engines can compute; a learned score goes into the same column.
SCORE_SQL = "round(least(1.0::DOUBLE, 0.5 * round(tendencia_gasto_lookback, 6) + 0.5 * (90 - recency) / 90.0::DOUBLE), 6)"
TEST_CTE = (
    ORDERS_PANEL
    + f""",
dates AS (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) rn, count(*) OVER () n
          FROM (SELECT DISTINCT snapshot_date FROM panel)),
cut AS (SELECT max(snapshot_date) c FROM dates WHERE rn <= greatest(1, floor(n * CAST(0.8 AS DOUBLE)))),
tr AS (SELECT panel.* FROM panel, cut WHERE snapshot_date <= c),
te AS (SELECT panel.* FROM panel, cut WHERE snapshot_date > c),
scored AS (
  SELECT o_custkey, snapshot_date, target_recompra_30d y, 'model' strategy, CAST({SCORE_SQL} AS DOUBLE) score FROM te
  UNION ALL
  SELECT o_custkey, snapshot_date, target_recompra_30d, 'baseline_recency',
         CAST((SELECT max(recency) FROM te) - recency AS DOUBLE) FROM te)"""
)
AREAS_CTE = """
g AS (SELECT strategy, score, CAST(sum(y) AS DOUBLE) p, CAST(count(*) AS DOUBLE) n FROM scored GROUP BY 1, 2),
c2 AS (SELECT *, sum(p) OVER w tp, sum(n) OVER w nn, sum(p) OVER (PARTITION BY strategy) pt,
              sum(n) OVER (PARTITION BY strategy) nt
       FROM g WINDOW w AS (PARTITION BY strategy ORDER BY score DESC)),
areas AS (SELECT strategy, sum(p / pt * tp / nn) pr_auc,
                 sum((n - p) / (nt - pt) * ((tp - p) + p / 2) / pt) roc_auc FROM c2 GROUP BY strategy)"""


def at_k_cte(by: str, order: str, ks: tuple[int, ...]) -> str:
    values = ", ".join(f"({k})" for k in ks)
    return f"""
rk AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {order}) rn FROM scored),
atk AS (
  SELECT {by}, k, CAST(sum(y) AS BIGINT) positives, count(*) n,
         CASE WHEN sum(y) = 0 THEN 0 ELSE coalesce(sum(y) FILTER (WHERE rn <= k), 0) / sum(y) END recall_at_k,
         coalesce(sum(y) FILTER (WHERE rn <= k), 0) / least(k, count(*)) precision_at_k,
         sum(y) / count(*) base_rate
  FROM rk, (VALUES {values}) ks(k) GROUP BY {by}, k),
det AS (SELECT *, CASE WHEN base_rate > 0 THEN precision_at_k / base_rate ELSE 0 END lift_at_k FROM atk)"""


BASE_CTE = """
a AS (SELECT CAST(CAST(max(o_orderdate) AS DATE) AS TIMESTAMP) d FROM orders),
base AS (
  SELECT o_custkey, CAST(floor(epoch(any_value(d) - max(o_orderdate)) / 86400) AS BIGINT) recency,
         count(DISTINCT o_orderkey) frequency_lookback, sum(o_totalprice) monetary_lookback,
         sum(o_totalprice) / count(DISTINCT o_orderkey) ticket_medio_lookback,
         CASE WHEN sum(o_totalprice) = 0 THEN 0 ELSE
           coalesce(sum(o_totalprice) FILTER (WHERE o_orderdate >= d - INTERVAL 30 DAY), 0) / sum(o_totalprice)
         END tendencia_gasto_lookback
  FROM orders, a WHERE o_orderdate >= d - INTERVAL 90 DAY AND o_orderdate <= d GROUP BY o_custkey)"""
LIST_CTE = (
    BASE_CTE
    + f""",
sc AS (SELECT *, {SCORE_SQL} score_recompra_30d FROM base),
ranked AS (SELECT *, row_number() OVER (ORDER BY score_recompra_30d DESC, o_custkey) AS rank FROM sc),
listed AS (
  SELECT ranked.*, c_name,
         CASE WHEN score_recompra_30d > 0.60 AND score_recompra_30d <= 1 THEN 'Alta'
              WHEN score_recompra_30d > 0.35 AND score_recompra_30d <= 0.60 THEN 'Media'
              WHEN score_recompra_30d > -1 AND score_recompra_30d <= 0.35 THEN 'Baixa' END prioridade
  FROM ranked LEFT JOIN customer ON o_custkey = c_custkey)"""
)
LIST_SELECT = """rank, o_custkey, c_name, score_recompra_30d, prioridade,
CASE WHEN prioridade = 'Alta' AND recency <= 14 THEN 'Oferta premium'
     WHEN prioridade = 'Alta' THEN 'Reativacao imediata'
     WHEN prioridade = 'Media' THEN 'Campanha de relacionamento' ELSE 'Contato padrao' END acao_sugerida,
recency, frequency_lookback, round(monetary_lookback, 2) monetary_lookback,
round(ticket_medio_lookback, 6) ticket_medio_lookback, round(tendencia_gasto_lookback, 6) tendencia_gasto_lookback"""

# --- shared inputs ----------------------------------------------------------------------


def _orders(spark, d) -> DataFrame:
    return table(spark, d, "orders")


def _panel(spark, d) -> DataFrame:
    return propensity_panel(_orders(spark, d), ORDERS, one_row_per_order=True)


def round_features(df: DataFrame) -> DataFrame:
    return rounded(df, monetary_lookback=2, ticket_medio_lookback=6, tendencia_gasto_lookback=6)


def rounded_score(df: DataFrame, name: str) -> DataFrame:
    trend, recency = F.round("tendencia_gasto_lookback", 6), F.col("recency")
    mix = 0.5 * trend + 0.5 * (90 - recency) / F.lit(90.0)
    return df.withColumn(name, F.round(F.least(F.lit(1.0), mix), 6))


def _test_scores(spark, d) -> tuple[DataFrame, DataFrame]:
    """Training rows and long scored test rows from one written panel."""
    split = split_by_date(write_once(_panel(spark, d)))
    test = rounded_score(recency_score(held_out_rows(split)), "score_model")
    scores = {"model": "score_model", "baseline_recency": "score_baseline"}
    return training_rows(split), write_once(long_scores(test, scores, [KEY, SNAPSHOT, TARGET]))


def _scored_base(spark, d) -> DataFrame:
    return rounded_score(scoring_base(_orders(spark, d), cols=ORDERS, one_row_per_order=True), "score_recompra_30d")


# --- queries ----------------------------------------------------------------------------


@query("campaign_top100", f"WITH {LIST_CTE} SELECT {LIST_SELECT} FROM listed WHERE rank <= 100")
def campaign_top100(spark, d):
    scored = _scored_base(spark, d)
    out = campaign_list(scored, table(spark, d, "customer"), key=KEY, cols=PEOPLE)
    return round_features(as_long(out, "rank"))


@query("full_ranking", f"WITH {LIST_CTE} SELECT {LIST_SELECT} FROM listed")
def full_ranking_query(spark, d):
    out = scored_list(_scored_base(spark, d), table(spark, d, "customer"), key=KEY, cols=PEOPLE)
    return round_features(out)


@query("campaign_tiles", f"""WITH {LIST_CTE} SELECT count(*) clientes_na_lista,
round(avg(score_recompra_30d), 6) score_medio, round(avg(CAST(c_name IS NULL AS INT)), 6) sem_nome
FROM listed WHERE rank <= 100 AND prioridade IN ('Alta', 'Media')""")
def campaign_tiles_query(spark, d):
    top = only_priorities(campaign_top100(spark, d), ["Alta", "Media"])
    return rounded(campaign_tiles(top, name="c_name"), score_medio=6, sem_nome=6)


@query("scoring_base", f"""WITH {BASE_CTE} SELECT o_custkey, recency, frequency_lookback,
round(monetary_lookback, 2) monetary_lookback, round(ticket_medio_lookback, 6) ticket_medio_lookback,
round(tendencia_gasto_lookback, 6) tendencia_gasto_lookback FROM base""")
def scoring_base_query(spark, d):
    return round_features(scoring_base(_orders(spark, d), cols=ORDERS, one_row_per_order=True))


RFM_SQL = """SELECT o_custkey, max(o_orderdate) ultima_compra, count(DISTINCT o_orderkey) frequency,
round(sum(o_totalprice), 2) monetary,
CAST(floor(epoch((SELECT max(o_orderdate) + INTERVAL 1 DAY FROM orders) - max(o_orderdate)) / 86400) AS BIGINT) recency
FROM orders GROUP BY o_custkey"""


@query("rfm", RFM_SQL)
def rfm_query(spark, d):
    return rounded(rfm(_orders(spark, d), cols=ORDERS, one_row_per_order=True), monetary=2)


@query("rfm_known_customers", RFM_SQL.replace(
    "FROM orders GROUP BY", "FROM orders WHERE o_orderkey % 97 <> 0 GROUP BY"))
def rfm_known_customers(spark, d):
    """Purchases without a customer make no profile."""
    orders = _orders(spark, d).withColumn(KEY, F.when(F.col("o_orderkey") % 97 != 0, F.col(KEY)))
    return rounded(rfm(orders, cols=ORDERS, one_row_per_order=True), monetary=2)


@query("scoring_base_known_customers", f"""WITH {BASE_CTE.replace("FROM orders, a WHERE", "FROM orders, a WHERE o_orderkey % 97 <> 0 AND")}
SELECT o_custkey, recency, frequency_lookback, round(monetary_lookback, 2) monetary_lookback,
round(ticket_medio_lookback, 6) ticket_medio_lookback, round(tendencia_gasto_lookback, 6) tendencia_gasto_lookback FROM base""")
def scoring_base_known_customers(spark, d):
    """Purchases without a customer make no row to score."""
    orders = _orders(spark, d).withColumn(KEY, F.when(F.col("o_orderkey") % 97 != 0, F.col(KEY)))
    return round_features(scoring_base(orders, cols=ORDERS, one_row_per_order=True))


@query("first_customer_copy", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def first_customer_copy(spark, d):
    """Of copies with and without a name or balance, the first that has them."""
    people = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    nameless = people.withColumn("c_name", F.lit(None).cast("string"))
    empty = nameless.withColumn("c_acctbal", F.lit(None).cast("double"))
    return first_by_key(nameless.unionByName(empty).unionByName(people), ["c_custkey"])


@query("parquet_round_trip", "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders")
def parquet_round_trip(spark, d):
    path = scratch_path(spark)
    write_table(_orders(spark, d).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), path)
    return read_table(spark, path)


@query("csv_round_trip", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    path = scratch_path(spark)
    people = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    write_report(people, path)
    return read_report(spark, path, people.schema)


@query("rfm_events", """SELECT user_id, max(ts) ultima_compra, count(DISTINCT event_id) frequency,
round(sum(value), 2) monetary, CAST(floor(epoch((SELECT max(ts) + INTERVAL 1 DAY FROM events
WHERE event_type = 'purchase') - max(ts)) / 86400) AS BIGINT) recency
FROM events WHERE event_type = 'purchase' GROUP BY user_id""")
def rfm_events(spark, d):
    bought = table(spark, d, "events").filter("event_type = 'purchase'")
    return rounded(rfm(bought, cols=EVENTS), monetary=2)


@query("rfm_order_lines", """SELECT l_suppkey, max(l_shipdate) ultima_compra, count(DISTINCT l_orderkey) frequency,
round(sum(l_extendedprice), 2) monetary, CAST(floor(epoch((SELECT max(l_shipdate) + INTERVAL 1 DAY FROM lineitem)
- max(l_shipdate)) / 86400) AS BIGINT) recency FROM lineitem GROUP BY l_suppkey""")
def rfm_order_lines(spark, d):
    return rounded(rfm(table(spark, d, "lineitem"), cols=ORDER_LINES), monetary=2)


@query("rfm_customers", f"""SELECT r.*, c_name, c_nationkey, c_acctbal, c_mktsegment
FROM ({RFM_SQL}) r LEFT JOIN customer ON o_custkey = c_custkey""")
def rfm_customers(spark, d):
    people = table(spark, d, "customer")
    return rounded(rfm(_orders(spark, d), people, cols=ORDERS, customer_key="c_custkey", one_row_per_order=True), monetary=2)


@query("propensity_panel", f"WITH {ORDERS_PANEL} SELECT o_custkey, {PANEL_SELECT}, target_recompra_30d FROM panel")
def propensity_panel_query(spark, d):
    return round_features(_panel(spark, d))


EVENT_PANEL = panel_cte("ev", "user_id", "event_id", "ts", "value", 7, 3, 7)


@query("panel_events", f"""WITH ev AS (SELECT * FROM events WHERE event_type = 'purchase'), {EVENT_PANEL}
SELECT user_id, {PANEL_SELECT}, target_recompra_30d FROM panel""")
def panel_events(spark, d):
    bought = table(spark, d, "events").filter("event_type = 'purchase'")
    return round_features(propensity_panel(bought, EVENTS, 7, 7, 3))


# Order lines repeat their order over several ship dates: the general distinct-order path.
LINE_PANEL = panel_cte("ln", "l_suppkey", "l_orderkey", "l_shipdate", "l_extendedprice", 90, 30, 30)


@query("panel_order_lines", f"""WITH ln AS (SELECT * FROM lineitem), {LINE_PANEL}
SELECT l_suppkey, {PANEL_SELECT.replace("ticket_medio_lookback, 6", "ticket_medio_lookback, 7")}, target_recompra_30d
FROM panel""")
def panel_order_lines(spark, d):
    panel = propensity_panel(table(spark, d, "lineitem"), ORDER_LINES)
    # Seven digits: with 32 orders the sixth is an exact tie, which engines round differently.
    return rounded(panel, monetary_lookback=2, ticket_medio_lookback=7, tendencia_gasto_lookback=6)


@query("scoring_base_order_lines", """WITH a AS (SELECT CAST(CAST(max(l_shipdate) AS DATE) AS TIMESTAMP) d FROM lineitem)
SELECT l_suppkey, CAST(floor(epoch(any_value(d) - max(l_shipdate)) / 86400) AS BIGINT) recency,
count(DISTINCT l_orderkey) frequency_lookback, round(sum(l_extendedprice), 2) monetary_lookback,
round(sum(l_extendedprice) / count(DISTINCT l_orderkey), 7) ticket_medio_lookback,
round(coalesce(sum(l_extendedprice) FILTER (WHERE l_shipdate >= d - INTERVAL 30 DAY), 0) / sum(l_extendedprice), 6)
  tendencia_gasto_lookback
FROM lineitem, a WHERE l_shipdate >= d - INTERVAL 90 DAY AND l_shipdate <= d GROUP BY l_suppkey""")
def scoring_base_order_lines(spark, d):
    base = scoring_base(table(spark, d, "lineitem"), cols=ORDER_LINES)
    return rounded(base, monetary_lookback=2, ticket_medio_lookback=7, tendencia_gasto_lookback=6)


@query("split_by_date", """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) order_date FROM orders),
dd AS (SELECT order_date, row_number() OVER (ORDER BY order_date) rn, count(*) OVER () n
       FROM (SELECT DISTINCT order_date FROM o)),
cut AS (SELECT max(order_date) c FROM dd WHERE rn <= greatest(1, floor(n * CAST(0.8 AS DOUBLE))))
SELECT o_orderkey, order_date, CASE WHEN order_date <= c THEN 'train' ELSE 'test' END split FROM o, cut""")
def split_by_date_query(spark, d):
    days = _orders(spark, d).select("o_orderkey", F.to_date("o_orderdate").alias("order_date"))
    return split_by_date(days, "order_date")


@query("baseline_score", f"""WITH {ORDERS_PANEL} SELECT o_custkey, snapshot_date,
CAST((SELECT max(recency) FROM panel) - recency AS DOUBLE) score_baseline FROM panel""")
def baseline_score(spark, d):
    panel = write_once(_panel(spark, d).select(KEY, SNAPSHOT, "recency"))
    return recency_score(panel).select(KEY, SNAPSHOT, "score_baseline")


@query("ap_auc_by_strategy", f"""WITH {TEST_CTE}, {AREAS_CTE}
SELECT strategy, round(pr_auc, 6) pr_auc, round(roc_auc, 6) roc_auc FROM areas""")
def ap_auc_by_strategy(spark, d):
    _, scored = _test_scores(spark, d)
    return rounded(rank_areas(scored, TARGET), pr_auc=6, roc_auc=6)


_POOLED = ", ".join(
    f"round(max({m}_at_k) FILTER (WHERE k = {k}), 6) {m}_at_{k}" for k in (10, 30, 50) for m in ("recall", "precision")
)
METRICS_SQL = f"""WITH {TEST_CTE}, {AREAS_CTE}, {at_k_cte("strategy", "snapshot_date, o_custkey", (10, 30, 50))},
pool AS (SELECT strategy, {_POOLED} FROM det GROUP BY strategy)
SELECT areas.strategy AS model, round(pr_auc, 6) pr_auc, round(roc_auc, 6) roc_auc,
(SELECT count(*) FROM tr) train_rows, (SELECT count(*) FROM te) test_rows,
(SELECT min(snapshot_date) FROM tr) train_start, (SELECT max(snapshot_date) FROM tr) train_end,
(SELECT min(snapshot_date) FROM te) test_start, (SELECT max(snapshot_date) FROM te) test_end,
recall_at_10, precision_at_10, recall_at_30, precision_at_30, recall_at_50, precision_at_50,
round(pr_auc - (SELECT pr_auc FROM areas WHERE strategy = 'baseline_recency'), 6) uplift_pr_auc_vs_baseline
FROM areas JOIN pool ON areas.strategy = pool.strategy"""


def _metrics(spark, d) -> DataFrame:
    train, scored = _test_scores(spark, d)
    return propensity_metrics(train, scored, KEY)


def _round_metrics(df: DataFrame) -> DataFrame:
    names = [f"{m}_at_{k}" for k in (10, 30, 50) for m in ("recall", "precision")]
    return rounded(df, pr_auc=6, roc_auc=6, uplift_pr_auc_vs_baseline=6, **{n: 6 for n in names})


@query("propensity_metrics", METRICS_SQL)
def propensity_metrics_query(spark, d):
    return _round_metrics(_metrics(spark, d))


@query("propensity_metrics_view", f"""WITH m AS ({METRICS_SQL})
SELECT CASE model WHEN 'baseline_recency' THEN 'Baseline (recencia)' ELSE model END "Estrategia",
printf('%.4f', pr_auc) "Qualidade do ranking (PR-AUC)", printf('%.4f', roc_auc) "ROC-AUC",
printf('%.4f', recall_at_50) "Recall Top 50", printf('%.4f', precision_at_50) "Precisao Top 50",
uplift_pr_auc_vs_baseline "Ganho PR-AUC vs baseline", train_rows "Linhas treino", test_rows "Linhas teste",
train_start "Inicio treino", train_end "Fim treino", test_start "Inicio teste", test_end "Fim teste" FROM m""")
def propensity_metrics_view(spark, d):
    return propensity_view(_round_metrics(_metrics(spark, d)))


@query("model_tiles", f"""WITH m AS ({METRICS_SQL})
SELECT max(pr_auc) FILTER (WHERE model = 'model') pr_auc,
printf('%+.1f p.p.', round_even((max(pr_auc) FILTER (WHERE model = 'model')
  - max(pr_auc) FILTER (WHERE model = 'baseline_recency')) * 100, 1)) delta_pr_auc,
printf('%.1f%%', round_even(max(precision_at_50) FILTER (WHERE model = 'model') * 100, 1)) precisao_top_50,
printf('%.1f%%', round_even(max(recall_at_50) FILTER (WHERE model = 'model') * 100, 1)) recall_top_50 FROM m""")
def model_tiles_query(spark, d):
    return model_tiles(_round_metrics(_metrics(spark, d)), model="model")


@query("recall_at_k_by_snapshot", f"""WITH {TEST_CTE}, {at_k_cte("snapshot_date, strategy", "o_custkey", (10, 30, 50, 100))}
SELECT k, round(avg(recall_at_k), 6) recall_at_k_mean_by_snapshot FROM det WHERE strategy = 'model' GROUP BY k""")
def recall_at_k_by_snapshot(spark, d):
    _, scored = _test_scores(spark, d)
    model = scored.filter(F.col("strategy") == "model")
    return rounded(recall_by_snapshot(model, KEY), recall_at_k_mean_by_snapshot=6)


DETAIL_CTE = f"{TEST_CTE}, {at_k_cte('snapshot_date, strategy', 'o_custkey', (10, 30, 50))}"
SUMMARY_CTE = f"""{DETAIL_CTE},
summ AS (SELECT strategy, k, count(*) snapshots, avg(recall_at_k) recall_mean, stddev_samp(recall_at_k) recall_std,
                avg(precision_at_k) precision_mean, avg(lift_at_k) lift_mean, avg(base_rate) base_rate_mean
         FROM det GROUP BY strategy, k)"""
VERSUS_CTE = f"""{SUMMARY_CTE},
vs AS (SELECT m.k, (m.recall_mean - b.recall_mean) * 100 recall_uplift_pp,
              (m.precision_mean - b.precision_mean) * 100 precision_uplift_pp,
              m.lift_mean lift_model, b.lift_mean lift_baseline
       FROM summ m JOIN summ b ON m.k = b.k AND m.strategy = 'model' AND b.strategy = 'baseline_recency')"""
SUMMARY_SELECT = """k, snapshots, round(recall_mean, 6) recall_mean, round(recall_std, 6) recall_std,
round(precision_mean, 6) precision_mean, round(lift_mean, 6) lift_mean, round(base_rate_mean, 6) base_rate_mean"""


def _detail(spark, d) -> DataFrame:
    _, scored = _test_scores(spark, d)
    return uplift_detail(scored, KEY)


def _round_summary(df: DataFrame) -> DataFrame:
    return rounded(df, recall_mean=6, recall_std=6, precision_mean=6, lift_mean=6, base_rate_mean=6)


@query("uplift_detail", f"""WITH {DETAIL_CTE} SELECT snapshot_date, strategy, k, round(recall_at_k, 6) recall_at_k,
round(precision_at_k, 6) precision_at_k, round(lift_at_k, 6) lift_at_k, round(base_rate, 6) base_rate, positives, n
FROM det""")
def uplift_detail_query(spark, d):
    return rounded(_detail(spark, d), recall_at_k=6, precision_at_k=6, lift_at_k=6, base_rate=6)


@query("uplift_summary", f"WITH {SUMMARY_CTE} SELECT strategy, {SUMMARY_SELECT} FROM summ")
def uplift_summary_query(spark, d):
    return _round_summary(uplift_summary(_detail(spark, d)))


@query("uplift_summary_view", f"""WITH {SUMMARY_CTE} SELECT CASE strategy WHEN 'model' THEN 'Modelo IA'
ELSE 'Baseline recencia' END strategy, {SUMMARY_SELECT} FROM summ""")
def uplift_summary_view(spark, d):
    return uplift_view(_round_summary(uplift_summary(_detail(spark, d))))


@query("uplift_vs_baseline", f"""WITH {VERSUS_CTE} SELECT k, round(recall_uplift_pp, 6) recall_uplift_pp,
round(precision_uplift_pp, 6) precision_uplift_pp, round(lift_model, 6) lift_model,
round(lift_baseline, 6) lift_baseline FROM vs""")
def uplift_vs_baseline_query(spark, d):
    out = uplift_vs_baseline(uplift_summary(_detail(spark, d)))
    return rounded(out, recall_uplift_pp=6, precision_uplift_pp=6, lift_model=6, lift_baseline=6)


@query("uplift_tiles", f"""WITH {VERSUS_CTE} SELECT
printf('%+.1f p.p.', round_even(round(recall_uplift_pp, 6) + 0.0::DOUBLE, 1)) recall_ganho,
printf('%+.1f p.p.', round_even(round(precision_uplift_pp, 6) + 0.0::DOUBLE, 1)) precisao_ganho,
printf('%.2fx', round_even(round(lift_model, 6), 2)) lift_modelo FROM vs WHERE k = 50""")
def uplift_tiles_query(spark, d):
    out = uplift_vs_baseline(uplift_summary(_detail(spark, d)))
    return uplift_tiles(rounded(out, recall_uplift_pp=6, precision_uplift_pp=6, lift_model=6))


# --- drift ------------------------------------------------------------------------------


def drift_cte(rows: str) -> str:
    """``rows`` yields feature, value, r (reference flag), c (current flag)."""
    return f"""
lf AS ({rows}),
st AS (SELECT feature, avg(value) FILTER (WHERE r) rm, stddev_samp(value) FILTER (WHERE r) rs,
              avg(value) FILTER (WHERE c) cm, stddev_samp(value) FILTER (WHERE c) cs,
              min(value) FILTER (WHERE r OR c) lo, max(value) FILTER (WHERE r OR c) hi FROM lf GROUP BY feature),
bins AS (SELECT feature, least(9, greatest(0, CAST(ceil((value - lo) / ((hi - lo) / 10.0::DOUBLE)) - 1 AS INTEGER))) b,
                CAST(count(*) FILTER (WHERE r) AS DOUBLE) rn, CAST(count(*) FILTER (WHERE c) AS DOUBLE) cn
         FROM lf JOIN st USING (feature) WHERE (r OR c) AND lo < hi GROUP BY 1, 2),
shares AS (SELECT feature, rn / sum(rn) OVER (PARTITION BY feature) p, cn / sum(cn) OVER (PARTITION BY feature) q
           FROM bins),
idx AS (SELECT feature, sum(CASE WHEN p > 0 AND q > 0 THEN (q - p) * ln(q / p) END) psi FROM shares GROUP BY feature),
sig AS (SELECT st.*, coalesce(psi, 0) psi, CASE WHEN rs = 0 THEN 0 ELSE abs(cm - rm) / rs END sh
        FROM st LEFT JOIN idx USING (feature)),
rep AS (SELECT feature, round_even(rm, 4) ref_mean, round_even(rs, 4) ref_std, round_even(cm, 4) current_mean,
               round_even(cs, 4) current_std, round_even(sh, 4) mean_shift_normalized, round_even(psi, 4) psi,
               CASE WHEN psi > 0.2 OR sh > 0.30 THEN 'ALERT' WHEN psi > 0.1 OR sh > 0.15 THEN 'WARNING'
                    ELSE 'OK' END status FROM sig)"""


_FEATURE_ROWS = " UNION ALL ".join(
    f"SELECT '{f}' feature, CAST({f} AS DOUBLE) value, r, c FROM flagged"
    for f in (
        "recency",
        "frequency_lookback",
        "monetary_lookback",
        "ticket_medio_lookback",
        "tendencia_gasto_lookback",
    )
)
PANEL_DRIFT_CTE = f"""{TEST_CTE},
flagged AS (SELECT panel.*, snapshot_date <= (SELECT c FROM cut) r,
                   snapshot_date >= (SELECT max(snapshot_date) - INTERVAL 30 DAY FROM panel) c FROM panel),
{drift_cte(_FEATURE_ROWS)}"""


def _written_panel(spark, d) -> DataFrame:
    return write_once(_panel(spark, d))


@query("drift_report", f"WITH {PANEL_DRIFT_CTE} SELECT * FROM rep")
def drift_report_query(spark, d):
    return panel_drift(_written_panel(spark, d))


@query("drift_report_view", f"""WITH {PANEL_DRIFT_CTE} SELECT feature "Feature", ref_mean "Media treino",
current_mean "Media recente", psi "PSI", mean_shift_normalized "Desvio (sigma)",
CASE status WHEN 'ALERT' THEN 'Alerta' WHEN 'WARNING' THEN 'Aviso' ELSE status END "Status" FROM rep""")
def drift_report_view(spark, d):
    return drift_view(panel_drift(_written_panel(spark, d)))


@query("drift_summary", f"""WITH {PANEL_DRIFT_CTE}
SELECT CASE WHEN count(*) FILTER (WHERE status = 'ALERT') > 0 THEN 'ALERT'
            WHEN count(*) FILTER (WHERE status = 'WARNING') > 0 THEN 'WARNING' ELSE 'OK' END overall_status,
count(*) n_features, count(*) FILTER (WHERE status = 'OK') n_ok, count(*) FILTER (WHERE status = 'WARNING') n_warning,
count(*) FILTER (WHERE status = 'ALERT') n_alert, 30 recent_days,
(SELECT count(*) FROM flagged WHERE r) reference_rows, (SELECT count(*) FROM flagged WHERE c) current_rows FROM rep""")
def drift_summary_query(spark, d):
    panel = _written_panel(spark, d)
    return drift_summary(panel_drift(panel), panel)


# --- learned model ----------------------------------------------------------------------


# Learned numbers differ between libraries, so these queries have no reference SQL; tests hold their rows, counts, dates and
# baselines against it, and the forest against the baseline. 300 trees are the production value; README has the times.
TREES = 50


@query("propensity_rf")
def propensity_rf(spark, d, trees: int = TREES):
    """Train on the first dates, compare the forest with the recency baseline on the rest: metrics of both."""
    split = split_by_date(write_once(_panel(spark, d)))
    train = training_rows(split)
    model = fit_propensity(train, trees=trees)
    test = score_with(model, recency_score(held_out_rows(split)), "score_model")
    scores = {"random_forest": "score_model", "baseline_recency": "score_baseline"}
    long = write_once(long_scores(test, scores, [KEY, SNAPSHOT, TARGET]))
    return _round_metrics(propensity_metrics(train, long, KEY))


@query("campaign_rf")
def campaign_rf(spark, d, trees: int = TREES):
    """The weekly list with the learned score: the hundred customers most likely to buy, with what to do."""
    panel = write_once(_panel(spark, d))
    model = fit_propensity(training_rows(split_by_date(panel)), trees=trees)
    base = write_once(scoring_base(_orders(spark, d), cols=ORDERS, one_row_per_order=True))
    return campaign_list(score_with(model, base), table(spark, d, "customer"), key=KEY, cols=PEOPLE)
