"""Retention queries: return of inactive customers, attributes as of a snapshot, captured revenue, stored tables kept up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signals.catalog.cleaning import ADDRESS_CTE, CITY, addresses, place_cache, places_provider
from signals.catalog.customers import KEY, ORDERS_PANEL, PANEL_SELECT, SCORE_SQL, round_features, rounded_score
from signals.catalog.registry import ORDERS, query, rounded, table
from signals.columns import SNAPSHOT
from signals.operators.as_of import attributes_as_of
from signals.operators.enrich import enrich_addresses
from signals.operators.gain import FUTURE_VALUE, captured_by_snapshot, captured_revenue, captured_versus, gain_curve
from signals.operators.incremental import append_to_cache, refresh_panel
from signals.operators.panel import propensity_panel
from signals.operators.ranking import long_scores, recency_score
from signals.operators.retention import activity_islands, inactive_spells, reactivation_by_month, return_curve
from signals.operators.splits import held_out_rows, split_by_date
from signals.sources.scratch import scratch_path, shuffles_dropped, write_once
from signals.sources.tables import write_table


def _orders(spark, d) -> DataFrame:
    return table(spark, d, "orders")


# --- reactivation -----------------------------------------------------------------------

DAYS_CTE = """dy AS (SELECT o_custkey, CAST(o_orderdate AS DATE) d, sum(o_totalprice) v FROM orders
  WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY ALL)"""
SPELL_CTE = f"""{DAYS_CTE}, en AS (SELECT max(CAST(o_orderdate AS DATE)) hi FROM orders),
s0 AS (SELECT o_custkey, CAST(d + 90 AS DATE) since, lead(d) OVER (PARTITION BY o_custkey ORDER BY d) returned, hi FROM dy, en),
sp AS (SELECT o_custkey, since, returned, coalesce(returned, hi) through, CAST(coalesce(returned, hi) - since AS INTEGER) AS length FROM s0
       WHERE (returned IS NOT NULL AND since < returned) OR (returned IS NULL AND since <= hi))"""


@query("activity_islands", f"""WITH {DAYS_CTE},
g AS (SELECT *, CASE WHEN d - lag(d) OVER w <= 90 THEN 0 ELSE 1 END st FROM dy WINDOW w AS (PARTITION BY o_custkey ORDER BY d)),
i AS (SELECT *, CAST(sum(st) OVER (PARTITION BY o_custkey ORDER BY d) AS BIGINT) island FROM g)
SELECT o_custkey, island, min(d) first_day, max(d) last_day, count(*) AS days, round(sum(v), 2) spend FROM i GROUP BY ALL""")
def activity_islands_query(spark, d):
    return rounded(activity_islands(_orders(spark, d), ORDERS), spend=2)


@query("inactive_spells", f"WITH {SPELL_CTE} SELECT * FROM sp")
def inactive_spells_query(spark, d):
    return inactive_spells(_orders(spark, d), ORDERS)


@query("reactivation_by_month", f"""WITH {SPELL_CTE},
m AS (SELECT *, CAST(unnest(generate_series(CASE WHEN date_trunc('month', since) = since THEN since ELSE date_trunc('month', since) + INTERVAL 1 MONTH END,
      date_trunc('month', through), INTERVAL 1 MONTH)) AS DATE) AS month FROM sp)
SELECT month, CAST(floor((month - since) / 30) * 30 AS INTEGER) gap_days, count(*) inactive,
count(*) FILTER (date_trunc('month', returned) = month) reactivated,
round(count(*) FILTER (date_trunc('month', returned) = month) / count(*), 6) rate FROM m GROUP BY ALL""")
def reactivation_by_month_query(spark, d):
    """Of the customers inactive when a month begins, by how long, who comes back in it."""
    return rounded(reactivation_by_month(write_once(inactive_spells(_orders(spark, d), ORDERS))), rate=6)


@query("return_curve", f"""WITH {SPELL_CTE}, c AS (SELECT CAST(floor(length / 7) AS INTEGER) st, count(returned) b, count(*) n FROM sp GROUP BY 1),
a AS (SELECT *, CAST(sum(n) OVER (ORDER BY st ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) at_risk FROM c)
SELECT st * 7 after_days, at_risk, b returned, n - b censored, round(b / at_risk, 6) hazard,
round(product(1 - b / at_risk) OVER (ORDER BY st ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) inactive_share FROM a""")
def return_curve_query(spark, d):
    """How long inactivity lasts, spells that the data cut off counted as far as they were seen."""
    return rounded(return_curve(inactive_spells(_orders(spark, d), ORDERS)), hazard=6, inactive_share=6)


# --- as of ------------------------------------------------------------------------------


@query("panel_as_of_attributes", f"""WITH {ORDERS_PANEL},
hs AS (SELECT o_custkey, o_orderdate, arg_max(o_orderpriority, o_orderkey) priority, arg_max(o_orderstatus, o_orderkey) status
       FROM orders GROUP BY ALL)
SELECT p.o_custkey, p.snapshot_date, recency, target_recompra_30d, priority, status, o_orderdate AS known_at
FROM panel p ASOF LEFT JOIN hs ON p.o_custkey = hs.o_custkey AND CAST(p.snapshot_date AS TIMESTAMP) >= hs.o_orderdate""")
def panel_as_of_attributes(spark, d):
    """Every panel row with the priority and status of the customer's newest order known at the snapshot."""
    panel = propensity_panel(_orders(spark, d), ORDERS, one_row_per_order=True)
    history = _orders(spark, d).select(
        KEY, "o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")
    )
    rows = panel.select(KEY, SNAPSHOT, "recency", "target_recompra_30d")
    return attributes_as_of(rows, history, KEY, SNAPSHOT, "o_orderdate", ["priority", "status"], order=["o_orderkey"], known_at="known_at")


@query("purchase_as_of_event", """WITH h AS (SELECT user_id, ts AS seen, arg_max(event_type, event_id) kind, arg_max(props, event_id) detail
       FROM events WHERE event_type <> 'purchase' GROUP BY ALL),
p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
j AS (SELECT p.*, kind, detail, seen FROM p ASOF LEFT JOIN h ON p.user_id = h.user_id AND p.ts >= h.seen)
SELECT event_id, user_id, ts, CASE WHEN seen >= ts - INTERVAL 1 DAY THEN kind END last_event,
CASE WHEN seen >= ts - INTERVAL 1 DAY THEN detail END last_props FROM j""")
def purchase_as_of_event(spark, d):
    """Every purchase with the same user's newest other event of the day before it, to the microsecond."""
    events = table(spark, d, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    other = events.where("event_type <> 'purchase'").select(
        "user_id", F.col("ts").alias("seen"), F.col("event_id").alias("n"), F.col("event_type").alias("last_event"), F.col("props").alias("last_props")
    )
    return attributes_as_of(bought, other, "user_id", "ts", "seen", ["last_event", "last_props"], order=["n"], max_age_days=1)


# --- captured revenue -------------------------------------------------------------------

FUTURE_CTE = f"""{ORDERS_PANEL},
fv AS (SELECT o_custkey, s, sum(o_totalprice) v FROM snaps JOIN orders ON o_orderdate > s AND o_orderdate <= s + INTERVAL 30 DAY GROUP BY ALL),
pv AS (SELECT p.*, coalesce(v, 0) receita_futura FROM panel p LEFT JOIN fv ON fv.o_custkey = p.o_custkey AND CAST(fv.s AS DATE) = p.snapshot_date),
dates AS (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) rn, count(*) OVER () n FROM (SELECT DISTINCT snapshot_date FROM pv)),
cut AS (SELECT max(snapshot_date) c FROM dates WHERE rn <= greatest(1, floor(n * CAST(0.8 AS DOUBLE)))),
te AS (SELECT pv.* FROM pv, cut WHERE snapshot_date > c),
scored AS (SELECT o_custkey, snapshot_date, receita_futura, 'model' strategy, CAST({SCORE_SQL} AS DOUBLE) score FROM te
  UNION ALL SELECT o_custkey, snapshot_date, receita_futura, 'baseline_recency', CAST((SELECT max(recency) FROM te) - recency AS DOUBLE) FROM te),
rk AS (SELECT *, row_number() OVER (PARTITION BY snapshot_date, strategy ORDER BY score DESC, o_custkey) rn FROM scored),
cs AS (SELECT snapshot_date, strategy, k, coalesce(sum(receita_futura) FILTER (rn <= k), 0) captured, sum(receita_futura) total
       FROM rk, (VALUES (10), (30), (50)) ks(k) GROUP BY ALL),
ct AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE captured / total END share FROM cs)"""


def _scored(spark, d) -> DataFrame:
    panel = write_once(propensity_panel(_orders(spark, d), ORDERS, one_row_per_order=True, future_value=FUTURE_VALUE))
    test = write_once(rounded_score(recency_score(held_out_rows(split_by_date(panel))), "score_model"))
    scores = {"model": "score_model", "baseline_recency": "score_baseline"}
    return write_once(long_scores(test, scores, [KEY, SNAPSHOT, FUTURE_VALUE]))


@query("panel_future_value", f"""WITH {FUTURE_CTE} SELECT o_custkey, {PANEL_SELECT}, target_recompra_30d, round(receita_futura, 2) receita_futura FROM pv""")
def panel_future_value(spark, d):
    """The panel with the spend of the label window beside the label."""
    panel = propensity_panel(_orders(spark, d), ORDERS, one_row_per_order=True, future_value=FUTURE_VALUE)
    return rounded(round_features(panel), receita_futura=2)


@query("captured_by_snapshot", f"""WITH {FUTURE_CTE} SELECT snapshot_date, strategy, k, round(captured, 2) captured, round(total, 2) total,
round(share, 6) share FROM ct""")
def captured_by_snapshot_query(spark, d):
    return rounded(captured_by_snapshot(_scored(spark, d), KEY), captured=2, total=2, share=6)


@query("captured_revenue", f"""WITH {FUTURE_CTE} SELECT strategy, k, count(*) snapshots, round(sum(captured), 2) captured, round(sum(total), 2) total,
round(sum(captured) / sum(total), 6) share, round(avg(share), 6) share_mean FROM ct GROUP BY ALL""")
def captured_revenue_query(spark, d):
    """The share of future revenue that the best of each list bring, for model and baseline."""
    summary = captured_revenue(captured_by_snapshot(_scored(spark, d), KEY))
    return rounded(summary, captured=2, total=2, share=6, share_mean=6)


@query("captured_versus_baseline", f"""WITH {FUTURE_CTE}, su AS (SELECT strategy, k, sum(captured) cp, sum(captured) / sum(total) sh FROM ct GROUP BY ALL)
SELECT k, round(m.sh, 6) model_share, round(b.sh, 6) baseline_share, round(m.cp - b.cp, 2) extra_revenue, round((m.sh - b.sh) * 100, 6) gain_pp
FROM (SELECT * FROM su WHERE strategy = 'model') m JOIN (SELECT * FROM su WHERE strategy = 'baseline_recency') b USING (k)""")
def captured_versus_query(spark, d):
    out = captured_versus(captured_revenue(captured_by_snapshot(_scored(spark, d), KEY)))
    return rounded(out, model_share=6, baseline_share=6, extra_revenue=2, gain_pp=6)


@query("gain_curve", f"""WITH {FUTURE_CTE},
o AS (SELECT *, row_number() OVER w rn, sum(receita_futura) OVER (w ROWS UNBOUNDED PRECEDING) cum, count(*) OVER (PARTITION BY strategy) n,
        sum(receita_futura) OVER (PARTITION BY strategy) tot FROM scored
      WINDOW w AS (PARTITION BY strategy ORDER BY score DESC, snapshot_date, o_custkey)),
pt AS (SELECT *, unnest(range(CAST(floor((rn - 1) * 20 / n) AS BIGINT) + 1, CAST(floor(rn * 20 / n) AS BIGINT) + 1)) part FROM o)
SELECT strategy, CAST(part AS INTEGER) part, rn AS rows, round(cum, 2) captured, round(cum / tot, 6) share FROM pt""")
def gain_curve_query(spark, d):
    """Revenue of the best twentieth, two twentieths and so on of all scored rows, for model and baseline."""
    return rounded(gain_curve(_scored(spark, d), [SNAPSHOT, KEY]), captured=2, share=6)


# --- stored tables kept up --------------------------------------------------------------


@query("panel_incremental", f"WITH {ORDERS_PANEL} SELECT o_custkey, {PANEL_SELECT}, target_recompra_30d FROM panel")
def panel_incremental(spark, d):
    """A stored panel after two deliveries, the last months and late purchases of all years; equal to one built from everything."""
    orders = _orders(spark, d)
    end = orders.agg(F.date_sub(F.to_date(F.max("o_orderdate")), 60).alias("d")).scalar()
    delivery = write_once(
        orders.withColumn("_batch", F.when(F.col("o_orderkey") % 997 == 0, 2).when(F.to_date("o_orderdate") > end, 1).otherwise(0))
    )
    path = scratch_path(spark)
    stored = propensity_panel(delivery.where("_batch = 0"), ORDERS, one_row_per_order=True, span_weeks=26)
    with shuffles_dropped(spark):
        write_table(stored, path, SNAPSHOT, dealt=True)
    for n in (1, 2):
        known, arrived = delivery.where(F.col("_batch") <= n), delivery.where(F.col("_batch") == n)
        refresh_panel(spark, path, known, arrived, ORDERS, one_row_per_order=True)
    return round_features(spark.read.schema(stored.schema).parquet(path))


@query("address_cache_append", f"""WITH {ADDRESS_CTE} SELECT c_custkey, endereco, lat, lon FROM ak LEFT JOIN grown USING (endereco_norm)""")
def address_cache_append(spark, d):
    """A stored address cache that two deliveries of customers add to; only what is new is written."""
    people = addresses(spark, d)
    path = scratch_path(spark)
    place_cache(spark, d).write.parquet(path)
    for n in (0, 1):
        append_to_cache(spark, path, people.where(F.col("c_custkey") % 2 == n), places_provider(spark, d), city=CITY)
    return enrich_addresses(people, spark.read.parquet(path))
