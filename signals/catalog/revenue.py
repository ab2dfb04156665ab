"""Revenue queries: daily indicators, forecast features, backtest, selection, forecast."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signals.catalog.customers import drift_cte
from signals.catalog.registry import LINES, ORDER_LINES, ORDERS, query, rounded, table
from signals.columns import DAILY_DRIVERS, DAY, REVENUE
from signals.operators.drift import revenue_drift
from signals.operators.forecast import (
    CALENDAR_FEATURES,
    HISTORY_FEATURES,
    NAIVE_MODELS,
    PREDICTION,
    backtest_summary,
    comparison,
    fit_regressor,
    forecast_features,
    holdout_split,
    learned_backtest,
    model_selection,
    naive_backtest,
    naive_forecast,
    naive_predictions,
    next_day_features,
    predict_with,
    production_metrics,
    recursive_forecast,
    regressors,
    series_state,
    train_candidates,
)
from signals.operators.kpis import daily_features, daily_kpis, fill_calendar
from signals.operators.reports import backtest_view, business_tiles, forecast_total, forecast_view, real_and_predicted
from signals.operators.splits import held_out_rows, split_by_rows, training_rows, walk_forward_folds
from signals.sources.models import feature_list, load_model, save_model
from signals.sources.scratch import scratch_path, write_once
from signals.sources.tables import read_report, write_report

SEGMENT = ("c_mktsegment",)
NAIVE = tuple(NAIVE_MODELS)

# --- shared SQL -------------------------------------------------------------------------

KPI_CTE = """
sales AS (SELECT CAST(o_orderdate AS DATE) data, sum(o_totalprice) fat, count(DISTINCT o_orderkey) np,
                 count(DISTINCT o_custkey) cu FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
fac AS (SELECT CAST(l_shipdate AS DATE) data, sum(l_extendedprice) v FROM lineitem
        WHERE l_shipdate IS NOT NULL GROUP BY 1),
kpis AS (SELECT data, fat faturamento_total, np numero_pedidos, cu clientes_unicos, fat / np ticket_medio,
                coalesce(v, 0) valor_pedido_fabrica FROM sales LEFT JOIN fac USING (data))"""
SEGMENT_KPI_CTE = """
kpis AS (SELECT c_mktsegment, CAST(o_orderdate AS DATE) data, sum(o_totalprice) faturamento_total,
                count(DISTINCT o_orderkey) numero_pedidos, count(DISTINCT o_custkey) clientes_unicos,
                sum(o_totalprice) / count(DISTINCT o_orderkey) ticket_medio, coalesce(any_value(v), 0) valor_pedido_fabrica
         FROM orders JOIN customer ON o_custkey = c_custkey
         LEFT JOIN (SELECT c_mktsegment seg, CAST(l_shipdate AS DATE) dia, sum(l_extendedprice) v FROM lineitem
                    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) fac
         ON seg = c_mktsegment AND dia = CAST(o_orderdate AS DATE) GROUP BY 1, 2)"""
KPI_SELECT = """data, round(faturamento_total, 2) faturamento_total, numero_pedidos, clientes_unicos,
round(ticket_medio, 6) ticket_medio, round(valor_pedido_fabrica, 2) valor_pedido_fabrica"""


def features_cte(part: str = "") -> str:
    over = f"PARTITION BY {part} ORDER BY data" if part else "ORDER BY data"
    lags = ", ".join(f"lag(faturamento_total, {k}) OVER w fat_lag_{k}" for k in (1, 7, 14, 21, 28))
    rolls = ", ".join(
        f"avg(faturamento_total) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) fat_roll_mean_{n}, "
        f"coalesce(stddev_pop(faturamento_total) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0) fat_roll_std_{n}"
        for n in (7, 14, 30)
    )
    return f"""
ft0 AS (SELECT *, CAST(isodow(data) - 1 AS INTEGER) dia_semana, CAST(month(data) AS INTEGER) mes,
              CAST(year(data) AS INTEGER) ano, CAST(weekofyear(data) AS INTEGER) semana_ano,
              CAST(isodow(data) >= 6 AS INTEGER) is_weekend, CAST(day(data) = 1 AS INTEGER) is_month_start,
              CAST(data = last_day(data) AS INTEGER) is_month_end, {lags}, {rolls}
       FROM kpis WINDOW w AS ({over})),
ft AS (SELECT * FROM ft0 WHERE fat_lag_28 IS NOT NULL)"""


FEATURE_SELECT = (
    KPI_SELECT
    + ", "
    + ", ".join(CALENDAR_FEATURES)
    + ", "
    + ", ".join(f"round({c}, {2 if 'std' in c else 6}) {c}" for c in HISTORY_FEATURES)
)
NAIVE_ROWS = """
nv AS (SELECT *, 'naive_lag7' model, fat_lag_7 pred FROM {src}
       UNION ALL SELECT *, 'naive_rolling7', fat_roll_mean_7 FROM {src})"""
ERRORS = """avg(abs(faturamento_total - pred)) mae,
avg(abs(faturamento_total - pred) / nullif(abs(faturamento_total), 0)) mape,
CASE WHEN sum(abs(faturamento_total)) = 0 THEN 0 ELSE
  sum(abs(faturamento_total - pred)) / sum(abs(faturamento_total)) END wape"""


def backtest_cte(part: str = "") -> str:
    over = f"PARTITION BY {part} ORDER BY data" if part else "ORDER BY data"
    whole = f"PARTITION BY {part}" if part else ""
    by = f"{part}, " if part else ""
    match = f"AND ps.{part} = fo.{part}" if part else ""
    group = f"GROUP BY {part}" if part else ""
    return f"""{features_cte(part)},
ps AS (SELECT *, row_number() OVER ({over}) - 1 pos, count(*) OVER ({whole}) n FROM ft),
sz AS (SELECT {by}count(*) n, CAST(floor(count(*) * CAST(0.6 AS DOUBLE)) AS BIGINT) init FROM ft {group}),
fo AS (SELECT {by}n, init, unnest(range(init, n - 30 + 1, 30)) st FROM sz),
tst AS (SELECT ps.*, CAST((st - init) / 30 + 1 AS INTEGER) fold
        FROM ps JOIN fo ON pos >= st AND pos < st + 30 {match}),
{NAIVE_ROWS.format(src="tst")},
det AS (SELECT {by}model, fold, {ERRORS} FROM nv GROUP BY {by}model, fold),
su0 AS (SELECT {by}model, count(*) folds, avg(mae) mae_mean, stddev_samp(mae) mae_std, avg(mape) mape_mean,
               stddev_samp(mape) mape_std, avg(wape) wape_mean, stddev_samp(wape) wape_std
        FROM det GROUP BY {by}model),
su AS (SELECT *, min(wape_mean) OVER ({whole}) - wape_mean wape_uplift_vs_best_baseline FROM su0)"""


DETAIL_SELECT = "model, fold, round(mae, 4) mae, round(mape, 6) mape, round(wape, 6) wape"
SUMMARY_SELECT = """model, folds, round(mae_mean, 4) mae_mean, round(mae_std, 4) mae_std, round(mape_mean, 6) mape_mean,
round(mape_std, 6) mape_std, round(wape_mean, 6) wape_mean, round(wape_std, 6) wape_std,
round(wape_uplift_vs_best_baseline, 6) wape_uplift_vs_best_baseline"""
HOLDOUT_CTE = f"""{KPI_CTE}, {features_cte()},
ps AS (SELECT *, row_number() OVER (ORDER BY data) rn, count(*) OVER () n FROM ft),
sp AS (SELECT *, rn <= greatest(1, floor(n * CAST(0.8 AS DOUBLE))) is_train FROM ps),
te AS (SELECT * FROM sp WHERE NOT is_train),
{NAIVE_ROWS.format(src="te")},
cm0 AS (SELECT model, {ERRORS} FROM nv GROUP BY model),
cm AS (SELECT *, min(wape) OVER () - wape gain FROM cm0),
fm AS (SELECT model, mae, mape, wape, gain wape_uplift_vs_best_baseline,
              (SELECT count(*) FROM sp WHERE is_train) train_rows, (SELECT count(*) FROM te) test_rows,
              (SELECT min(data) FROM sp WHERE is_train) train_start, (SELECT max(data) FROM sp WHERE is_train) train_end,
              (SELECT min(data) FROM te) test_start, (SELECT max(data) FROM te) test_end
       FROM cm ORDER BY wape, model LIMIT 1)"""

# --- shared inputs ----------------------------------------------------------------------


def _kpis(spark, d) -> DataFrame:
    return daily_kpis(table(spark, d, "orders"), table(spark, d, "lineitem"), ORDERS, LINES, one_row_per_order=True)


def segment_kpis(spark, d) -> DataFrame:
    owner = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), *SEGMENT)
    orders = table(spark, d, "orders").join(owner, "o_custkey")
    of_order = orders.select(F.col("o_orderkey").alias("l_orderkey"), *SEGMENT)
    lines = table(spark, d, "lineitem").join(of_order, "l_orderkey")
    return daily_kpis(orders, lines, ORDERS, LINES, series=SEGMENT, one_row_per_order=True)


def _round_kpis(df: DataFrame) -> DataFrame:
    return rounded(df, faturamento_total=2, ticket_medio=6, valor_pedido_fabrica=2)


def _round_features(df: DataFrame) -> DataFrame:
    return rounded(_round_kpis(df), **{c: 2 if "std" in c else 6 for c in HISTORY_FEATURES})


def _round_detail(df: DataFrame) -> DataFrame:
    return rounded(df, mae=4, mape=6, wape=6)


def _round_summary(df: DataFrame) -> DataFrame:
    money = {"mae_mean": 4, "mae_std": 4}
    shares = {c: 6 for c in ("mape_mean", "mape_std", "wape_mean", "wape_std", "wape_uplift_vs_best_baseline")}
    return rounded(df, **money, **shares)


# --- queries ----------------------------------------------------------------------------


@query("daily_kpis", f"WITH {KPI_CTE} SELECT {KPI_SELECT} FROM kpis")
def daily_kpis_query(spark, d):
    return _round_kpis(_kpis(spark, d))


@query("daily_kpis_order_lines", """SELECT CAST(l_shipdate AS DATE) data,
round(sum(l_extendedprice), 2) faturamento_total, count(DISTINCT l_orderkey) numero_pedidos,
count(DISTINCT l_suppkey) clientes_unicos, round(sum(l_extendedprice) / count(DISTINCT l_orderkey), 7) ticket_medio,
CAST(0 AS DOUBLE) valor_pedido_fabrica FROM lineitem GROUP BY 1""")
def daily_kpis_order_lines(spark, d):
    return rounded(daily_kpis(table(spark, d, "lineitem"), cols=ORDER_LINES), faturamento_total=2, ticket_medio=7)


@query("daily_features", f"""WITH {KPI_CTE} SELECT {KPI_SELECT}, CAST(isodow(data) - 1 AS INTEGER) dia_semana,
CAST(month(data) AS INTEGER) mes, CAST(year(data) AS INTEGER) ano,
round(avg(faturamento_total) OVER (ORDER BY data ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) fat_rolling_7,
round(avg(faturamento_total) OVER (ORDER BY data ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) fat_rolling_30
FROM kpis""")
def daily_features_query(spark, d):
    return rounded(_round_kpis(daily_features(_kpis(spark, d))), fat_rolling_7=6, fat_rolling_30=6)


@query("daily_kpis_filled", f"""WITH {SEGMENT_KPI_CTE},
cal AS (SELECT c_mktsegment, CAST(unnest(generate_series(min(data), max(data), INTERVAL 1 DAY)) AS DATE) data
        FROM kpis GROUP BY 1)
SELECT c_mktsegment, data, round(coalesce(faturamento_total, 0), 2) faturamento_total,
coalesce(numero_pedidos, 0) numero_pedidos, coalesce(clientes_unicos, 0) clientes_unicos,
round(coalesce(ticket_medio, 0), 6) ticket_medio, round(coalesce(valor_pedido_fabrica, 0), 2) valor_pedido_fabrica
FROM cal LEFT JOIN kpis USING (c_mktsegment, data)""")
def daily_kpis_filled(spark, d):
    return _round_kpis(fill_calendar(segment_kpis(spark, d), SEGMENT))


@query("kpi_tiles", f"""WITH {KPI_CTE} SELECT round(sum(faturamento_total), 2) faturamento_historico,
round(avg(ticket_medio), 6) ticket_medio, round(avg(clientes_unicos), 6) clientes_unicos_dia FROM kpis""")
def kpi_tiles(spark, d):
    tiles = business_tiles(_kpis(spark, d))
    return rounded(tiles, faturamento_historico=2, ticket_medio=6, clientes_unicos_dia=6)


@query("forecast_features", f"WITH {KPI_CTE}, {features_cte()} SELECT {FEATURE_SELECT} FROM ft")
def forecast_features_query(spark, d):
    return _round_features(forecast_features(_kpis(spark, d)))


@query(
    "forecast_features_by_segment",
    f"""WITH {SEGMENT_KPI_CTE}, {features_cte("c_mktsegment")} SELECT c_mktsegment, {FEATURE_SELECT} FROM ft""",
)
def forecast_features_by_segment(spark, d):
    return _round_features(forecast_features(segment_kpis(spark, d), SEGMENT))


@query("split_by_rows", f"""WITH {SEGMENT_KPI_CTE},
p AS (SELECT c_mktsegment, data, row_number() OVER (PARTITION BY c_mktsegment ORDER BY data) rn,
             count(*) OVER (PARTITION BY c_mktsegment) n FROM kpis)
SELECT c_mktsegment, data, CASE WHEN rn <= greatest(1, floor(n * CAST(0.8 AS DOUBLE))) THEN 'train' ELSE 'test' END split
FROM p""")
def split_by_rows_query(spark, d):
    return split_by_rows(segment_kpis(spark, d).select(*SEGMENT, DAY), DAY, SEGMENT)


@query("walk_forward_folds", f"""WITH {SEGMENT_KPI_CTE}, {features_cte("c_mktsegment")},
sz AS (SELECT c_mktsegment, count(*) n, CAST(floor(count(*) * CAST(0.6 AS DOUBLE)) AS BIGINT) init FROM ft GROUP BY 1),
fo AS (SELECT c_mktsegment, init, unnest(range(init, n - 30 + 1, 30)) st FROM sz)
SELECT c_mktsegment, CAST((st - init) / 30 + 1 AS INTEGER) fold, 0 train_start, CAST(st AS INTEGER) train_end,
CAST(st AS INTEGER) test_start, CAST(st + 30 AS INTEGER) test_end FROM fo""")
def walk_forward_folds_query(spark, d):
    return walk_forward_folds(forecast_features(segment_kpis(spark, d), SEGMENT), SEGMENT)


@query("naive_backtest_detail", f"WITH {KPI_CTE}, {backtest_cte()} SELECT {DETAIL_SELECT} FROM det")
def naive_backtest_detail(spark, d):
    return _round_detail(naive_backtest(forecast_features(_kpis(spark, d))))


@query(
    "naive_backtest_by_segment",
    f"""WITH {SEGMENT_KPI_CTE}, {backtest_cte("c_mktsegment")} SELECT c_mktsegment, {DETAIL_SELECT} FROM det""",
)
def naive_backtest_by_segment(spark, d):
    return _round_detail(naive_backtest(forecast_features(segment_kpis(spark, d), SEGMENT), SEGMENT))


@query("naive_backtest_summary", f"WITH {KPI_CTE}, {backtest_cte()} SELECT {SUMMARY_SELECT} FROM su")
def naive_backtest_summary(spark, d):
    return _round_summary(backtest_summary(naive_backtest(forecast_features(_kpis(spark, d)))))


@query("report_labels", f"""WITH {KPI_CTE}, {backtest_cte()} SELECT CASE model WHEN 'naive_lag7' THEN 'Baseline lag-7'
ELSE 'Baseline media movel 7d' END "Modelo", folds "Folds", printf('%.1f%%', round_even(wape_mean * 100, 1)) "WAPE medio",
'R$ ' || format('{{:,.2f}}', mae_mean) "MAE medio (R$)" FROM su""")
def report_labels(spark, d):
    return backtest_view(backtest_summary(naive_backtest(forecast_features(_kpis(spark, d)))))


@query("model_selection", f"""WITH {SEGMENT_KPI_CTE}, {backtest_cte("c_mktsegment")},
rk AS (SELECT c_mktsegment, model, row_number() OVER (PARTITION BY c_mktsegment ORDER BY wape_mean, model) rn FROM su)
SELECT c_mktsegment, model selected_model, 'min_wape_mean' criteria, 'models/' || model artifact FROM rk WHERE rn = 1""")
def model_selection_query(spark, d):
    features = forecast_features(segment_kpis(spark, d), SEGMENT)
    summary = backtest_summary(naive_backtest(features, SEGMENT), SEGMENT)
    return model_selection(summary, NAIVE, "models", SEGMENT, "min_wape_mean")


def _holdout(spark, d) -> tuple[DataFrame, DataFrame]:
    split = holdout_split(forecast_features(_kpis(spark, d)))
    return split, comparison(naive_predictions(held_out_rows(split)))


@query("forecast_comparison_naive", f"""WITH {HOLDOUT_CTE} SELECT model, round(mae, 4) mae, round(mape, 6) mape,
round(wape, 6) wape, round(gain, 6) wape_uplift_vs_baseline FROM cm""")
def forecast_comparison_naive(spark, d):
    return rounded(_round_detail(_holdout(spark, d)[1]), wape_uplift_vs_baseline=6)


@query("forecast_metrics_naive", f"""WITH {HOLDOUT_CTE} SELECT model, round(mae, 4) mae, round(mape, 6) mape,
round(wape, 6) wape, round(wape_uplift_vs_best_baseline, 6) wape_uplift_vs_best_baseline, train_rows, test_rows,
train_start, train_end, test_start, test_end FROM fm""")
def forecast_metrics_naive(spark, d):
    split, table_ = _holdout(spark, d)
    out = production_metrics(table_, split, NAIVE)
    return rounded(_round_detail(out), wape_uplift_vs_best_baseline=6)


@query("forecast_metrics_view", f"""WITH {HOLDOUT_CTE} SELECT CASE model WHEN 'naive_lag7' THEN 'Baseline lag-7'
ELSE 'Baseline media movel 7d' END "Modelo", 'R$ ' || format('{{:,.2f}}', mae) "Erro medio (R$/dia)",
printf('%.1f%%', round_even(mape * 100, 1)) "MAPE", printf('%.1f%%', round_even(wape * 100, 1)) "Erro de previsao (WAPE)",
round(wape_uplift_vs_best_baseline, 6) "Ganho WAPE vs baseline", train_rows "Dias treino", test_rows "Dias teste"
FROM fm""")
def forecast_metrics_view(spark, d):
    split, table_ = _holdout(spark, d)
    out = production_metrics(table_, split, NAIVE)
    return forecast_view(rounded(out, wape_uplift_vs_best_baseline=6))


@query("real_and_predicted", f"""WITH {HOLDOUT_CTE} SELECT data, round(faturamento_total, 2) "Real",
round(pred, 6) "Previsto" FROM nv WHERE model = 'naive_rolling7'""")
def real_and_predicted_query(spark, d):
    split, _ = _holdout(spark, d)
    rows = naive_predictions(held_out_rows(split)).filter(F.col("model") == "naive_rolling7")
    return rounded(real_and_predicted(rows), Real=2, Previsto=6)


ROLL_CTE = f"""{SEGMENT_KPI_CTE},
st AS (SELECT c_mktsegment, max(data) d, list(faturamento_total ORDER BY data) h FROM kpis GROUP BY 1),
r AS (SELECT c_mktsegment, d, h[-30:] h, 0 step, CAST(NULL AS DOUBLE) pred FROM st
      UNION ALL
      SELECT c_mktsegment, d + 1, list_append(h, list_avg(h[-7:])), step + 1, list_avg(h[-7:]) FROM r WHERE step < 30)"""


@query("recursive_naive_forecast", f"""WITH RECURSIVE {ROLL_CTE}
SELECT c_mktsegment, d data, round(pred, 4) pred_faturamento FROM r WHERE step > 0""")
def recursive_naive_forecast(spark, d):
    out = naive_forecast(segment_kpis(spark, d), "naive_rolling7", 30, SEGMENT)
    return rounded(out, pred_faturamento=4)


@query("recursive_lag7_forecast", f"""WITH RECURSIVE {ROLL_CTE.replace("list_avg(h[-7:])", "h[-7]")}
SELECT c_mktsegment, d data, round(pred, 4) pred_faturamento FROM r WHERE step > 0""")
def recursive_lag7_forecast(spark, d):
    out = naive_forecast(segment_kpis(spark, d), "naive_lag7", 30, SEGMENT)
    return rounded(out, pred_faturamento=4)


@query("forecast_total", f"""WITH RECURSIVE {ROLL_CTE}
SELECT round(sum(pred), 2) faturamento_previsto FROM r WHERE step > 0""")
def forecast_total_query(spark, d):
    out = naive_forecast(segment_kpis(spark, d), "naive_rolling7", 30, SEGMENT)
    return rounded(forecast_total(out), faturamento_previsto=2)


_NEXT_LAGS = ", ".join(f"round(CASE WHEN len(h) >= {k} THEN h[-{k}] ELSE h[-1] END, 6) fat_lag_{k}" for k in (1, 7, 14, 21, 28))
_NEXT_ROLLS = ", ".join(
    f"round(list_avg(h[-{n}:]), 6) fat_roll_mean_{n}, round(list_aggregate(h[-{n}:], 'stddev_pop'), 2) fat_roll_std_{n}"
    for n in (7, 14, 30)
)
_NEXT_DRIVERS = ", ".join(f"round(list_avg({d}[-7:]), 6) {d}" for d in DAILY_DRIVERS)


@query("next_day_features", f"""WITH {SEGMENT_KPI_CTE},
s AS (SELECT c_mktsegment, max(data) + 1 d, list(faturamento_total ORDER BY data) h,
      {", ".join(f"list(CAST({c} AS DOUBLE) ORDER BY data) {c}" for c in DAILY_DRIVERS)} FROM kpis GROUP BY 1)
SELECT c_mktsegment, CAST(d AS DATE) data, {_NEXT_DRIVERS}, CAST(isodow(d) - 1 AS INTEGER) dia_semana,
CAST(month(d) AS INTEGER) mes, CAST(year(d) AS INTEGER) ano, CAST(weekofyear(d) AS INTEGER) semana_ano,
CAST(isodow(d) >= 6 AS INTEGER) is_weekend, CAST(day(d) = 1 AS INTEGER) is_month_start,
CAST(d = last_day(d) AS INTEGER) is_month_end, {_NEXT_LAGS}, {_NEXT_ROLLS} FROM s""")
def next_day_features_query(spark, d):
    rows = next_day_features(series_state(segment_kpis(spark, d), SEGMENT))
    picked = rows.select(*SEGMENT, DAY, *DAILY_DRIVERS, *CALENDAR_FEATURES, *HISTORY_FEATURES)
    digits = {c: 2 if "std" in c else 6 for c in (*DAILY_DRIVERS, *HISTORY_FEATURES)}
    return rounded(picked, **digits)


_REVENUE_ROWS = """SELECT 'faturamento_total' feature, faturamento_total value, rn <= floor(n * CAST(0.8 AS DOUBLE)) r,
rn > floor(n * CAST(0.8 AS DOUBLE)) c
FROM (SELECT *, row_number() OVER (ORDER BY data) rn, count(*) OVER () n FROM kpis)"""


@query("revenue_drift", f"WITH {KPI_CTE}, {drift_cte(_REVENUE_ROWS)} SELECT * FROM rep")
def revenue_drift_query(spark, d):
    return revenue_drift(write_once(_kpis(spark, d).select(DAY, REVENUE)))


# --- learned models ---------------------------------------------------------------------


# A straight line on one lag is a learned model whose numbers SQL can state, so training, saving, the backtest and the recursion of
# learned models are compared whole. Trees cannot be: their queries return the real forecasts without reference SQL, and tests hold
# them against the naive models and the range they learned from.
LINE_FEATURES = ("fat_lag_7",)
LINE = {"linear": lambda: LinearRegression(featuresCol="_features", labelCol=REVENUE, solver="normal")}


@query("forecast_linear_saved", f"""WITH {HOLDOUT_CTE},
fit AS (SELECT regr_slope(faturamento_total, fat_lag_7) a, regr_intercept(faturamento_total, fat_lag_7) b FROM sp WHERE is_train)
SELECT data, round(faturamento_total, 2) faturamento_total, round(a * fat_lag_7 + b, 1) pred_faturamento, 'fat_lag_7' features FROM te, fit""")
def forecast_linear_saved(spark, d):
    """A line fitted on the first days, saved and read back with its feature list, on the rest of the days."""
    split = holdout_split(forecast_features(_kpis(spark, d)))
    fitted = train_candidates(training_rows(split), LINE, LINE_FEATURES)
    path = scratch_path(spark)
    save_model(fitted["linear"], path)
    model = load_model(path)
    rows = predict_with(model, held_out_rows(split)).select(DAY, REVENUE, PREDICTION, F.lit(",".join(feature_list(model))).alias("features"))
    return rounded(rows, faturamento_total=2, pred_faturamento=1)


@query("forecast_linear_backtest", f"""WITH {SEGMENT_KPI_CTE}, {backtest_cte("c_mktsegment")},
fs AS (SELECT fold, min(data) d FROM tst GROUP BY 1),
fit AS (SELECT fold, regr_slope(faturamento_total, fat_lag_7) a, regr_intercept(faturamento_total, fat_lag_7) b FROM ft JOIN fs ON data < d GROUP BY 1),
lp AS (SELECT tst.*, a * fat_lag_7 + b pred FROM tst JOIN fit USING (fold))
SELECT c_mktsegment, fold, 'linear' model, round(avg(abs(faturamento_total - pred)), 1) mae,
round(avg(abs(faturamento_total - pred) / nullif(abs(faturamento_total), 0)), 6) mape,
round(sum(abs(faturamento_total - pred)) / sum(abs(faturamento_total)), 6) wape FROM lp GROUP BY ALL""")
def forecast_linear_backtest(spark, d):
    """Walk-forward backtest of a learned line, one fit a fold on all segments together."""
    features = write_once(forecast_features(segment_kpis(spark, d), SEGMENT))
    return rounded(learned_backtest(features, LINE, SEGMENT, LINE_FEATURES), mae=1, mape=6, wape=6)


@query("forecast_linear_30d", f"""WITH RECURSIVE {SEGMENT_KPI_CTE}, {features_cte("c_mktsegment")},
fit AS (SELECT regr_slope(faturamento_total, fat_lag_7) a, regr_intercept(faturamento_total, fat_lag_7) b FROM ft),
st AS (SELECT c_mktsegment, max(data) d, (list(faturamento_total ORDER BY data))[-30:] h FROM kpis GROUP BY 1),
r AS (SELECT c_mktsegment, d, h, 0 step, CAST(NULL AS DOUBLE) pred FROM st
      UNION ALL SELECT c_mktsegment, d + 1, list_append(h, a * h[-7] + b), step + 1, a * h[-7] + b FROM r, fit WHERE step < 30)
SELECT c_mktsegment, CAST(d AS DATE) data, round(pred, 1) pred_faturamento FROM r WHERE step > 0""")
def forecast_linear_30d(spark, d):
    """Recursive 30-day forecast of every segment by a learned line."""
    kpis = write_once(segment_kpis(spark, d))
    model = fit_regressor(write_once(forecast_features(kpis, SEGMENT)), LINE["linear"](), LINE_FEATURES)
    return rounded(recursive_forecast(kpis, model, 30, SEGMENT), pred_faturamento=1)


#: Trees and rounds of the registered queries; README has the times that the production sizes take.
SIZES = {"forest_trees": 100, "forest_depth": 8, "boost_rounds": 30, "boost_depth": 5}
BACKTEST_SIZES = {**SIZES, "forest_trees": 20}


@query("forecast_rf_backtest")
def forecast_rf_backtest(spark, d, sizes=BACKTEST_SIZES):
    """Walk-forward backtest of naive and forest models over all folds of all segments: the errors of each."""
    features = write_once(forecast_features(segment_kpis(spark, d), SEGMENT))
    forest = {"random_forest": regressors(**sizes)["random_forest"]}
    detail = naive_backtest(features, SEGMENT).unionByName(learned_backtest(features, forest, SEGMENT))
    return _round_summary(backtest_summary(detail, SEGMENT))


def _next_30(spark, d, name: str, sizes) -> DataFrame:
    """The forecast of every segment."""
    kpis = write_once(segment_kpis(spark, d))
    train = write_once(forecast_features(kpis, SEGMENT))
    model = fit_regressor(train, regressors(**sizes)[name]())
    return rounded(recursive_forecast(kpis, model, 30, SEGMENT), pred_faturamento=2)


@query("forecast_rf_30d")
def forecast_rf_30d(spark, d, sizes=SIZES):
    """Recursive 30-day forecast of every segment with one forest."""
    return _next_30(spark, d, "random_forest", sizes)


@query("forecast_boosted_30d")
def forecast_boosted_30d(spark, d, sizes=SIZES):
    """The same with boosted trees."""
    return _next_30(spark, d, "gbt", sizes)


@query("sorted_report", f"""WITH {KPI_CTE} SELECT row_number() OVER (ORDER BY data) - 1 linha, data, numero_pedidos FROM kpis""")
def sorted_report(spark, d):
    """The daily table as one sorted CSV report, read back with the place of each line."""
    path = scratch_path(spark)
    write_report(_kpis(spark, d).select(DAY, "numero_pedidos").orderBy(DAY), path, single_file=True)
    read = read_report(spark, path, f"{DAY} date, numero_pedidos bigint").withColumn("linha", F.monotonically_increasing_id())
    return read.select("linha", DAY, "numero_pedidos")
