"""Data-quality rules, report and gate.

All rules of one table are computed in a single aggregate pass, or observed in the pass that writes it. The only
shuffle is the one behind the distinct key count, and Spark combines copies of a key before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from signals.functions.text import parse_day_first
from signals.sources.tables import path_exists

# Folders of usable and rejected rows under a checked table.
SITUATION, ACCEPTED, REJECTED = "situacao", "aceita", "rejeitada"
ISSUE_SCHEMA = "dataset string, rule string, severity string, details string"


@dataclass(frozen=True)
class TableRules:
    """What is checked on one table."""

    dataset: str
    required: Sequence[str] = ()
    keys: Sequence[str] = ()
    max_null: Mapping[str, float] = field(default_factory=dict)
    date: str | None = None


# The default rule set.
PURCHASE_RULES = TableRules(
    "compras",
    ("id_cliente", "id_pedido", "data_compra", "valor_total"),
    ("id_pedido",),
    {"id_cliente": 0.01, "valor_total": 0.01},
    "data_compra",
)
CUSTOMER_RULES = TableRules(
    "clientes",
    ("id_cliente", "nome_cliente"),
    ("id_cliente",),
    {"nome_cliente": 0.20, "data_cadastro": 0.80},
    "data_cadastro",
)
FACTORY_RULES = TableRules(
    "pedidos_cd", ("id_pedido", "data_pedido"), ("id_pedido",), {"data_pedido": 0.05}, "data_pedido"
)


def null_ratio(c: Column) -> Column:
    """Share of null rows, 0 for an empty table."""
    return F.coalesce(F.avg(c.isNull().cast("double")), F.lit(0.0))


def duplicate_count(keys: Sequence[str]) -> Column:
    """Rows beyond the first of each key; null keys equal each other."""
    return F.count(F.lit(1)) - F.count_distinct(F.struct(*keys))


def invalid_date_count(df: DataFrame, name: str) -> Column:
    """A10: rows whose date is missing or cannot be read."""
    c = F.col(name)
    moment = parse_day_first(c) if dict(df.dtypes)[name] == "string" else c
    return F.count_if(moment.isNull())


def _issue(dataset: str, rule: str, severity: str, details: Column, raised: Column) -> Column:
    row = F.struct(
        F.lit(dataset).alias("dataset"),
        F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"),
        details.alias("details"),
    )
    return F.when(raised, row)


def _three(c: Column) -> Column:
    return F.format_string("%.3f", F.bround(c, 3))


def _plan(df: DataFrame, rules: TableRules) -> tuple[dict[str, Column], list[str], list[Column]]:
    """What one pass over a table measures, the keys whose copies are counted besides, and the issues these facts make.

    The texts of the details are fixed values, as readers of the report compare them.
    """
    name = rules.dataset
    missing = [c for c in rules.required if c not in df.columns]
    keys = [c for c in rules.keys if c in df.columns]
    keys = keys if len(keys) == len(rules.keys) else []
    measured: dict[str, Column] = {}
    issues: list[Column] = []
    if missing:
        details = F.lit(f"Missing required columns: {missing}")
        issues.append(_issue(name, "required_columns", "error", details, F.lit(True)))
    if keys:
        n = F.col("duplicates")
        text = F.concat(n.cast("string"), F.lit(f" duplicated rows on keys {keys}"))
        issues.append(_issue(name, "duplicates", "warning", text, n > 0))
    for i, (c, limit) in enumerate(rules.max_null.items()):
        if c in df.columns:
            measured[f"null_{i}"] = null_ratio(F.col(c))
            r = F.col(f"null_{i}")
            text = F.concat(F.lit(f"{c}: null_ratio="), _three(r), F.lit(f" > {limit:.3f}"))
            issues.append(_issue(name, "null_threshold", "warning", text, r > limit))
    if rules.date and rules.date in df.columns:
        measured["invalid_dates"] = invalid_date_count(df, rules.date)
        n = F.col("invalid_dates")
        text = F.concat(n.cast("string"), F.lit(f" invalid/NaT values in {rules.date}"))
        issues.append(_issue(name, "invalid_dates", "warning", text, n > 0))
    return measured, keys, issues


def _raised(facts: DataFrame, issues: list[Column]) -> DataFrame:
    """The issues of one row of facts that are to be raised."""
    if not issues:
        return facts.sparkSession.createDataFrame([], ISSUE_SCHEMA)
    return facts.select(F.explode(F.array_compact(F.array(*issues))).alias("issue")).select("issue.*")


def check_table(df: DataFrame, rules: TableRules) -> DataFrame:
    """Q1-Q4: the issues of one table, one row each."""
    measured, keys, issues = _plan(df, rules)
    if keys:
        measured["duplicates"] = duplicate_count(keys)
    facts = df.agg(*[c.alias(k) for k, c in measured.items()]) if measured else df.sparkSession.range(1)
    return _raised(facts, issues)


def write_checked(
    df: DataFrame, rules: TableRules, path: str, usable: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Write a table and check it in the same pass: the issues of all its rows, and a reader of the usable ones.

    Null ratios and unreadable dates are observed while the rows go by on their way to the files, so the table is computed
    once. Copies of a key need a distinct count, which cannot be observed; it reads the key columns of what was written. With
    ``usable`` the rows go to two folders under ``path`` by whether it holds, so that rejects are kept, counted and
    apart. The issues equal those of ``check_table``.
    """
    spark = df.sparkSession
    measured, keys, issues = _plan(df, rules)
    if SITUATION in df.columns:
        raise ValueError(f"the table has a column {SITUATION}")
    seen = Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in measured.items()])
    here, all_rows = path, lambda: spark.read.schema(df.schema).parquet(path)
    if usable is None:
        watched.write.mode("overwrite").parquet(path)
    else:
        situation = F.when(F.coalesce(usable, F.lit(False)), ACCEPTED).otherwise(REJECTED)
        watched.withColumn(SITUATION, situation).write.mode("overwrite").partitionBy(SITUATION).parquet(path)
        here = f"{path}/{SITUATION}={ACCEPTED}"
        if not path_exists(spark, here):
            df.limit(0).write.parquet(here)
    found = {k: float(v) if k.startswith("null_") else int(v) for k, v in seen.get.items()}
    if keys:
        found["duplicates"] = all_rows().agg(duplicate_count(keys).alias("n")).first()["n"]
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint'}" for k, v in found.items())
    facts = spark.createDataFrame([tuple(found.values())], schema)
    return _raised(facts, issues), spark.read.schema(df.schema).parquet(here)


def missing_columns(df: DataFrame, rules: TableRules) -> list[str]:
    """The required columns a table lacks; known before any job."""
    return [c for c in rules.required if c not in df.columns]


def check_required(df: DataFrame, dataset: str, required: Sequence[str]) -> DataFrame:
    """Q1: an error when required columns are missing (no job)."""
    return check_table(df, TableRules(dataset, required=required))


def check_duplicates(df: DataFrame, dataset: str, keys: Sequence[str]) -> DataFrame:
    """Q2: a warning for repeated keys; nothing when a key column is absent."""
    return check_table(df, TableRules(dataset, keys=keys))


def check_nulls(df: DataFrame, dataset: str, max_null: Mapping[str, float]) -> DataFrame:
    """Q3: a warning per column whose null ratio exceeds its limit."""
    return check_table(df, TableRules(dataset, max_null=max_null))


def check_dates(df: DataFrame, dataset: str, date: str) -> DataFrame:
    """Q4: a warning counting missing or unreadable dates."""
    return check_table(df, TableRules(dataset, date=date))


def quality_report(
    purchases: DataFrame,
    customers: DataFrame,
    factory_orders: DataFrame,
    rules: Sequence[TableRules] = (PURCHASE_RULES, CUSTOMER_RULES, FACTORY_RULES),
) -> DataFrame:
    """Q5: the issues of the three tables."""
    report = None
    for df, r in zip((purchases, customers, factory_orders), rules):
        issues = check_table(df, r)
        report = issues if report is None else report.unionByName(issues)
    return report


def gate_status(report: DataFrame) -> DataFrame:
    """Q6 as data: issue counts by severity and whether the batch may go on."""
    errors = F.count_if(F.lower("severity") == "error")
    return report.agg(
        errors.alias("n_errors"),
        F.count_if(F.lower("severity") == "warning").alias("n_warnings"),
        (errors == 0).cast("int").alias("passed"),
    )


def enforce_gate(report: DataFrame, where: str = "the quality report") -> None:
    """Q6: stop the batch when any issue is an error."""
    if not report.filter(F.lower("severity") == "error").isEmpty():
        raise RuntimeError(f"batch stopped: critical quality errors, see {where}")
