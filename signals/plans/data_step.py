"""Step 1: clean, check, and derive the profile and daily tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from signals.columns import DAY, CustomerCols
from signals.operators.clean import clean_customers, clean_factory_orders, is_usable, parse_purchases
from signals.operators.customers import rfm
from signals.operators.kpis import daily_features, daily_kpis
from signals.operators.quality import (
    CUSTOMER_RULES,
    FACTORY_RULES,
    ISSUE_SCHEMA,
    PURCHASE_RULES,
    enforce_gate,
    missing_columns,
    quality_report,
    write_checked,
)
from signals.operators.tables import first_by_key
from signals.plans.workspace import Workspace
from signals.sources.tables import read_report


def run_data_step(ws: Workspace, purchases: DataFrame, customers: DataFrame, factory_orders: DataFrame) -> None:
    """Raw text tables in, clean and derived tables out.

    Each raw table is read and parsed once: quality is observed on all its parsed rows while they are written, usable and
    rejected ones apart, and everything that follows reads what was written. Missing required columns are known
    from the schema and stop the batch before anything is written but the report; the gate on the whole report comes before the
    derived tables.
    """
    tables = {
        "compras_clientes": (parse_purchases(purchases), PURCHASE_RULES),
        "clientes_clean": (clean_customers(customers), CUSTOMER_RULES),
        "pedidos_cd_clean": (clean_factory_orders(factory_orders), FACTORY_RULES),
    }
    if any(missing_columns(df, rules) for df, rules in tables.values()):
        ws.report(quality_report(*[df for df, _ in tables.values()]), "quality_report")
        enforce_gate(read_report(ws.spark, ws.path("quality_report"), ISSUE_SCHEMA), ws.path("quality_report"))
    usable = {"compras_clientes": is_usable((ws.cols.customer, ws.cols.order), (ws.cols.time,))}
    clean, report = {}, None
    for name, (df, rules) in tables.items():
        issues, clean[name] = write_checked(df, rules, ws.path(name), usable.get(name))
        report = issues if report is None else report.unionByName(issues)
    ws.report(report, "quality_report")
    enforce_gate(report, ws.path("quality_report"))

    purchases, people, supplies = clean.values()
    keyed = ws.sizes.one_row_per_order
    ws.save(rfm(purchases, people, cols=ws.cols, one_row_per_order=keyed), "rfm_clientes")
    series = list(ws.series)
    if series:
        purchases = _with_series(purchases, people, ws)
        supplies = None  # factory orders name no customer, so they belong to no series
    kpis = daily_kpis(purchases, supplies, ws.cols, series=series, one_row_per_order=keyed)
    kpis = ws.save(kpis.orderBy(*series, DAY), "kpis_diarios")
    ws.save(daily_features(kpis, series).orderBy(*series, DAY), "kpis_diarios_features")


def _with_series(purchases: DataFrame, people: DataFrame, ws: Workspace) -> DataFrame:
    """Purchases with the customer columns that split the revenue into series; customers who are not known
    are one series, the empty one."""
    owners = first_by_key(people.select(CustomerCols().customer, *ws.series), [CustomerCols().customer])
    named = owners.withColumnRenamed(CustomerCols().customer, ws.cols.customer)
    return purchases.drop(*ws.series).join(named, ws.cols.customer, "left").na.fill("", list(ws.series))
