"""Outlook queries: forecast intervals, direct weekly forecasts, seasonal smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signals.catalog.registry import query, rounded
from signals.catalog.revenue import SEGMENT, SEGMENT_KPI_CTE, segment_kpis
from signals.columns import DAY
from signals.operators.forecast import PREDICTION
from signals.operators.horizon import (
    WEEKS_AHEAD,
    direct_backtest,
    direct_rows,
    latest_origin,
    naive_direct,
    reconciled_days,
    weekday_shares,
    weekly_totals,
)
from signals.operators.intervals import forecast_interval, naive_forecasters
from signals.operators.smoothing import smoothing_features, smoothing_forecast
from signals.sources.scratch import write_once

# --- intervals --------------------------------------------------------------------------

_NEXT = "CASE model WHEN 'naive_lag7' THEN h[-7] ELSE list_avg(h[-7:]) END"
INTERVAL_CTE = f"""{SEGMENT_KPI_CTE},
ps AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY data) - 1 pos, count(*) OVER (PARTITION BY c_mktsegment) n FROM kpis),
sz AS (SELECT c_mktsegment, count(*) n, CAST(floor(count(*) * CAST(0.6 AS DOUBLE)) AS BIGINT) init FROM kpis GROUP BY 1),
fo AS (SELECT c_mktsegment, init, unnest(range(init, n - 30 + 1, 30)) st FROM sz),
og AS (SELECT ps.c_mktsegment, CAST((st - init) / 30 + 1 AS INTEGER) fold, max(data) d, list(faturamento_total ORDER BY data) h
       FROM ps JOIN fo ON ps.c_mktsegment = fo.c_mktsegment AND pos < st AND pos >= st - 30 GROUP BY ALL
       UNION ALL
       SELECT c_mktsegment, 0, max(data), (list(faturamento_total ORDER BY data))[-30:] FROM kpis GROUP BY 1),
r AS (SELECT og.*, model, 0 step, CAST(NULL AS DOUBLE) pred FROM og, (VALUES ('naive_lag7'), ('naive_rolling7')) m(model)
      UNION ALL
      SELECT c_mktsegment, fold, d + 1, list_append(h, {_NEXT}), model, step + 1, {_NEXT} FROM r WHERE step < 30),
er AS (SELECT r.*, abs(k.faturamento_total - pred) e FROM r JOIN kpis k ON k.c_mktsegment = r.c_mktsegment AND k.data = r.d
       WHERE step > 0 AND fold > 0),
fut AS (SELECT c_mktsegment, model, CAST(d AS DATE) data, CAST(step AS INTEGER) horizon, pred FROM r WHERE step > 0 AND fold = 0)"""


@query("forecast_interval", f"""WITH RECURSIVE {INTERVAL_CTE},
ce AS (SELECT *, floor(max(fold) OVER (PARTITION BY c_mktsegment, model, step) * 0.7::DOUBLE) cut FROM er),
cb AS (SELECT c_mktsegment, model, step, list_sort(coalesce(list(e) FILTER (fold <= cut), [])) known FROM ce GROUP BY ALL),
bd AS (SELECT *, CASE WHEN ceil((len(known) + 1) * 0.9::DOUBLE) <= len(known) THEN known[ceil((len(known) + 1) * 0.9::DOUBLE)::BIGINT] END bound FROM cb),
co AS (SELECT ce.c_mktsegment, ce.model, ce.step, count(*) FILTER (fold > cut) tested, avg(CAST(e <= bound AS INT)) FILTER (fold > cut AND bound IS NOT NULL) coverage
       FROM ce JOIN bd USING (c_mktsegment, model, step) GROUP BY ALL)
SELECT fut.c_mktsegment, fut.model, data, horizon, round(pred, 4) pred_faturamento, round(CASE WHEN bound IS NOT NULL THEN greatest(0, pred - bound) END, 4) lower,
round(pred + bound, 4) upper, round(bound, 4) bound, len(known) n, tested, round(coverage, 6) coverage
FROM fut LEFT JOIN bd ON bd.c_mktsegment = fut.c_mktsegment AND bd.model = fut.model AND bd.step = horizon
LEFT JOIN co ON co.c_mktsegment = fut.c_mktsegment AND co.model = fut.model AND co.step = horizon""")
def forecast_interval_query(spark, d):
    """The naive forecasts of every segment with bounds by horizon day and how often they held."""
    out = forecast_interval(write_once(segment_kpis(spark, d)), naive_forecasters(), SEGMENT)
    return rounded(out, pred_faturamento=4, lower=4, upper=4, bound=4, coverage=6)


@query("forecast_interval_pooled", f"""WITH RECURSIVE {INTERVAL_CTE},
bd AS (SELECT model, step, quantile_disc(e / abs(pred), 0.9) bound, count(*) n FROM er WHERE pred <> 0 GROUP BY ALL)
SELECT c_mktsegment, fut.model, data, horizon, round(pred, 4) pred_faturamento, round(CASE WHEN bound IS NOT NULL THEN greatest(0, pred - bound * abs(pred)) END, 4) lower,
round(pred + bound * abs(pred), 4) upper, round(bound, 6) bound, n FROM fut LEFT JOIN bd ON bd.model = fut.model AND bd.step = horizon""")
def forecast_interval_pooled(spark, d):
    """The same with one relative bound a model and horizon for all segments, by a mergeable sketch."""
    out = forecast_interval(write_once(segment_kpis(spark, d)), naive_forecasters(), SEGMENT, pooled=True)
    return rounded(out, pred_faturamento=4, lower=4, upper=4, bound=6)


# --- weeks ahead ------------------------------------------------------------------------

WEEK_CTE = f"""{SEGMENT_KPI_CTE},
sp AS (SELECT c_mktsegment, min(data) lo, max(data) hi, CAST(min(data) + CAST((8 - isodow(min(data))) % 7 AS INTEGER) AS DATE) mon FROM kpis GROUP BY 1),
wk AS (SELECT c_mktsegment, mon, unnest(range(0, CAST(floor((hi + 1 - mon) / 7) AS BIGINT))) i FROM sp),
wv AS (SELECT c_mktsegment, CAST(date_trunc('week', data) AS DATE) w, sum(faturamento_total) v FROM kpis GROUP BY ALL),
ar AS (SELECT wk.c_mktsegment, any_value(mon) mon, list(coalesce(v, 0) ORDER BY i) t
       FROM wk LEFT JOIN wv ON wv.c_mktsegment = wk.c_mktsegment AND w = mon + CAST(7 * i AS INTEGER) GROUP BY 1),
o0 AS (SELECT *, unnest(range(12, len(t) + 1)) a FROM ar),
o1 AS (SELECT *, unnest(range(1, {WEEKS_AHEAD + 1})) h FROM o0),
dr AS (SELECT c_mktsegment, CAST(mon + CAST((a - 1) * 7 AS INTEGER) AS DATE) origin, CAST(mon + CAST((a + h - 1) * 7 AS INTEGER) AS DATE) AS week,
         CAST(h AS INTEGER) horizon, t[a] lag_0, t[a - 1] lag_1, t[a - 2] lag_2, t[a - 3] lag_3, list_sum(t[a - 3:a]) / 4 mean_4,
         list_sum(t[a - 11:a]) / 12 mean_12, CASE WHEN a + h > 52 AND a + h - 52 <= len(t) THEN t[a + h - 52] ELSE list_sum(t[a - 3:a]) / 4 END last_year,
         CASE WHEN a + h <= len(t) THEN t[a + h] END target, a = len(t) latest FROM o1),
np AS (SELECT *, 'naive_mean4' model, mean_4 pred FROM dr UNION ALL SELECT *, 'naive_last_year', last_year FROM dr)"""


def _rows(spark, d) -> tuple[DataFrame, DataFrame]:
    kpis = write_once(segment_kpis(spark, d))
    return kpis, direct_rows(weekly_totals(kpis, SEGMENT), SEGMENT)


@query("weekly_direct_rows", f"""WITH {WEEK_CTE} SELECT c_mktsegment, origin, week, horizon, round(lag_0, 2) lag_0, round(lag_3, 2) lag_3,
round(mean_4, 4) mean_4, round(mean_12, 4) mean_12, round(last_year, 4) last_year, CAST(weekofyear(week) AS INTEGER) week_of_year,
round(target, 2) target FROM dr""")
def weekly_direct_rows(spark, d):
    """Training rows of every origin week and distance, from one pass over each segment's weeks."""
    rows = _rows(spark, d)[1]
    picked = rows.select(
        *SEGMENT, "origin", "week", "horizon", "lag_0", "lag_3", "mean_4", "mean_12", "last_year", "week_of_year", "target"
    )
    return rounded(picked, lag_0=2, lag_3=2, mean_4=4, mean_12=4, last_year=4, target=2)


@query("weekly_direct_backtest", f"""WITH {WEEK_CTE} SELECT c_mktsegment, model, horizon, count(*) origins, round(avg(abs(target - pred)), 4) mae,
round(sum(abs(target - pred)) / sum(abs(target)), 6) wape FROM np WHERE target IS NOT NULL GROUP BY ALL""")
def weekly_direct_backtest(spark, d):
    """Errors of the naive direct models by weeks ahead."""
    predictions = naive_direct(_rows(spark, d)[1], [*SEGMENT, "horizon", "target"])
    return rounded(direct_backtest(predictions, SEGMENT), mae=4, wape=6)


@query("weekly_direct_forecast", f"""WITH {WEEK_CTE},
rc AS (SELECT k.c_mktsegment, isodow(data) wd, faturamento_total v FROM kpis k JOIN sp USING (c_mktsegment) WHERE hi - data < 84),
sh AS (SELECT c_mktsegment, wd, sum(v) / sum(sum(v)) OVER (PARTITION BY c_mktsegment) s FROM rc GROUP BY c_mktsegment, wd),
dy AS (SELECT np.c_mktsegment, model, horizon, week, pred, g.wd, coalesce(s, 0) s FROM np CROSS JOIN range(1, 8) g(wd)
       LEFT JOIN sh ON sh.c_mktsegment = np.c_mktsegment AND sh.wd = g.wd WHERE latest)
SELECT c_mktsegment, model, horizon, week, round(pred, 2) pred, CAST(week + CAST(wd - 1 AS INTEGER) AS DATE) data, round(s * pred, 2) pred_day FROM dy""")
def weekly_direct_forecast(spark, d):
    """The next eight weeks of every segment and their days, which add up to their week."""
    kpis, rows = _rows(spark, d)
    weekly = naive_direct(latest_origin(rows, SEGMENT), [*SEGMENT, "horizon", "week"])
    return rounded(reconciled_days(weekly, weekday_shares(kpis, SEGMENT), SEGMENT), pred=2, pred_day=2)


# --- smoothing --------------------------------------------------------------------------

_A, _B, _G = "0.3::DOUBLE", "0.05::DOUBLE", "0.2::DOUBLE"
SMOOTH_CTE = f"""{SEGMENT_KPI_CTE},
sr AS (SELECT c_mktsegment, list(faturamento_total ORDER BY data) y, list(CAST(isodow(data) AS INTEGER) ORDER BY data) w, list(data ORDER BY data) dd
       FROM kpis GROUP BY 1 HAVING count(*) >= 7),
s0 AS (SELECT c_mktsegment, list_sum(y[1:7]) / 7 lv, y, w, dd FROM sr),
s1 AS (SELECT *, list_transform(range(1, 8), lambda j: coalesce(list_avg(list_transform(list_filter(range(1, 8), lambda i: w[i] = j), lambda i: y[i] - lv)), 0)) se
       FROM s0),
r AS (SELECT c_mktsegment, 7 i, lv, 0::DOUBLE tr, se, CAST(NULL AS DOUBLE) ex, CAST(NULL AS DOUBLE) l0, CAST(NULL AS DOUBLE) q0, y, w, dd FROM s1
      UNION ALL
      SELECT c_mktsegment, i + 1, nl, {_B} * (nl - lv) + (1 - {_B}) * tr,
        list_transform(se, lambda s, j: CASE WHEN j = w[i + 1] THEN {_G} * (y[i + 1] - nl) + (1 - {_G}) * q ELSE s END), lv + tr + q, lv, q, y, w, dd
      FROM (SELECT *, se[w[i + 1]] q, {_A} * (y[i + 1] - se[w[i + 1]]) + (1 - {_A}) * (lv + tr) nl FROM r WHERE i < len(y)))"""


@query("seasonal_smoothing", f"""WITH RECURSIVE {SMOOTH_CTE}
SELECT c_mktsegment, CAST(dd[i] AS DATE) data, round(ex, 4) hw_expected, round(l0, 4) hw_level, round(q0, 4) hw_season FROM r WHERE i > 7""")
def seasonal_smoothing(spark, d):
    """Level, weekly season and expected revenue of every day, known before it."""
    return rounded(smoothing_features(segment_kpis(spark, d), SEGMENT), hw_expected=4, hw_level=4, hw_season=4)


@query("seasonal_smoothing_forecast", f"""WITH RECURSIVE {SMOOTH_CTE}, e AS (SELECT *, unnest(range(1, 31)) h FROM r WHERE i = len(y))
SELECT c_mktsegment, CAST(dd[-1] + CAST(h AS INTEGER) AS DATE) data,
round(lv + h * tr + se[isodow(CAST(dd[-1] + CAST(h AS INTEGER) AS DATE))], 4) pred_faturamento FROM e""")
def seasonal_smoothing_forecast(spark, d):
    return rounded(smoothing_forecast(segment_kpis(spark, d), 30, SEGMENT), pred_faturamento=4)


@query("forecast_interval_smoothing")
def forecast_interval_smoothing(spark, d):
    """Bounds of the smoothed forecast by horizon day, from its own errors on the folds, each after a year of days."""
    kpis = write_once(segment_kpis(spark, d))
    model = {"smoothing": lambda rows, keys: smoothing_forecast(rows, 30, keys)}
    out = forecast_interval(kpis, model, SEGMENT, history_rows=364)
    return out.select(*SEGMENT, "model", DAY, "horizon", PREDICTION, "lower", "upper", "bound", "n", "tested", F.round("coverage", 6).alias("coverage"))
