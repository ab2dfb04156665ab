from __future__ import annotations

from datetime import datetime

import pytest

from signals.operators.clean import clean_customers, clean_factory_orders, clean_purchases, is_usable, parse_purchases
from signals.operators.quality import (
    ISSUE_SCHEMA,
    PURCHASE_RULES,
    TableRules,
    check_dates,
    check_duplicates,
    check_nulls,
    check_required,
    check_table,
    enforce_gate,
    gate_status,
    missing_columns,
    quality_report,
    write_checked,
)
from signals.operators.tables import first_by_key, require_columns, require_rows


def test_raw_purchase_row(spark):
    raw = spark.createDataFrame(
        [("100", "OP1", "15/03/2024", "1.234,56", "10,50", "3")],
        "`Cód. Cliente` string, OP string, Data string, `Valor Total` string, `Valor Desconto` string, `Qtde Itens` string",
    )
    r = clean_purchases(raw).first()
    assert r["valor_total"] == 1234.56 and r["valor_desconto"] == 10.5 and r["qtde_itens"] == 3
    assert r["id_cliente"] == "100" and r["id_pedido"] == "OP1" and r["data_compra"] == datetime(2024, 3, 15)


def test_unusable_rows_are_dropped_but_counted(spark):
    raw = spark.createDataFrame(
        [("1", "a", "01/01/2024", "1"), (None, "b", "01/01/2024", "1"), (" ", "c", "01/01/2024", "1"), ("2", "d", "99/01/2024", "1"), ("3", "", "01/01/2024", "x")],
        "`Cód. Cliente` string, OP string, Data string, `Valor Total` string",
    )
    assert [r["id_pedido"] for r in clean_purchases(raw).collect()] == ["a"]
    report = {r["rule"]: r["details"] for r in check_table(parse_purchases(raw), PURCHASE_RULES).collect()}
    assert report["invalid_dates"] == "1 invalid/NaT values in data_compra"
    assert report["null_threshold"] == "id_cliente: null_ratio=0.200 > 0.010"


def test_customers_and_factory_orders(spark):
    people = spark.createDataFrame(
        [(" 7 ", "Ana", "1/2/2024", "bad", "12")],
        "Codigo string, Nome string, `Dt Cadastro` string, `Dt Ultima Compra` string, `Qtde Itens` string",
    )
    r = clean_customers(people).first()
    assert r["id_cliente"] == "7" and r["data_cadastro"] == datetime(2024, 2, 1)
    assert r["data_ultima_compra"] is None and r["qtde_itens"] == "12"
    orders = spark.createDataFrame([("5", "10,5", "2024-01-02")], "Pedido string, Valor string, `Data Pedido` string")
    r = clean_factory_orders(orders).first()
    assert (r["id_pedido"], r["valor_pedido"], r["data_pedido"]) == ("5", 10.5, datetime(2024, 1, 2))


def tables(spark):
    purchases = spark.sql(
        "select * from values ('1','10',timestamp_ntz'2025-01-10',100.0D), ('2','11',timestamp_ntz'2025-01-11',200.0D)"
        " t(id_cliente, id_pedido, data_compra, valor_total)"
    )
    customers = spark.sql(
        "select * from values ('1','Ana',timestamp_ntz'2024-01-01'), ('2','Bia',timestamp_ntz'2024-02-01')"
        " t(id_cliente, nome_cliente, data_cadastro)"
    )
    supplies = spark.sql(
        "select * from values ('500',timestamp_ntz'2025-01-01'), ('501',timestamp_ntz'2025-01-02') t(id_pedido, data_pedido)"
    )
    return purchases, customers, supplies


def test_valid_tables_pass(spark):
    report = quality_report(*tables(spark))
    assert report.count() == 0
    enforce_gate(report)
    enforce_gate(spark.createDataFrame([], ISSUE_SCHEMA))


def test_missing_columns_stop_the_batch(spark):
    p, c, f = tables(spark)
    report = quality_report(p.select("id_cliente"), c.select("id_cliente"), f.select("id_pedido"))
    found = [tuple(r) for r in report.filter("rule = 'required_columns'").orderBy("dataset").collect()]
    assert len(found) == 3 and all(r[2] == "error" for r in found)
    assert found[0][3] == "Missing required columns: ['nome_cliente']"
    assert gate_status(report).first()["passed"] == 0
    with pytest.raises(RuntimeError):
        enforce_gate(report)


def test_single_checks(spark):
    df = spark.createDataFrame([("a", None), ("a", "01/01/2024")], "k string, d string")
    assert check_required(df, "t", ["z"]).first()["severity"] == "error"
    assert check_required(df, "t", ["k"]).count() == 0
    assert check_duplicates(df, "t", ["k"]).first()["details"].startswith("1 duplicated")
    assert check_duplicates(df, "t", ["z"]).count() == 0
    assert check_nulls(df, "t", {"d": 0.4, "z": 0.1}).first()["details"] == "d: null_ratio=0.500 > 0.400"
    assert check_dates(df, "t", "d").first()["rule"] == "invalid_dates"
    assert check_dates(df, "t", "z").count() == 0


def test_null_keys_count_as_duplicates(spark):
    df = spark.createDataFrame([(None,), (None,), ("a",), ("a",), ("b",)], "k string")
    issue = check_table(df, TableRules("t", keys=("k",))).first()
    assert issue["details"] == "2 duplicated rows on keys ['k']"


def test_empty_table_has_no_ratio_issue(spark):
    df = spark.createDataFrame([], "a string, d string")
    assert check_table(df, TableRules("t", keys=("a",), max_null={"a": 0.0}, date="d")).count() == 0


def test_first_by_key(spark, rows):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 1, "z"), ("b", None, None)], "k string, o int, v string")
    assert rows(first_by_key(df, ["k"], ["o"])) == [("a", 1, "y"), ("b", None, None)]
    assert rows(first_by_key(df.select("k"), ["k"])) == [("a",), ("b",)]


def test_guards(spark):
    df = spark.createDataFrame([], "a string")
    with pytest.raises(ValueError):
        require_columns(df, ["b"])
    with pytest.raises(RuntimeError):
        require_rows(df, "the table")


def test_first_by_key_prefers_a_value_to_null(spark, rows):
    df = spark.createDataFrame([(1, None), (1, "Ana"), (2, None)], "k int, name string")
    assert rows(first_by_key(df, ["k"])) == [(1, "Ana"), (2, None)]


@pytest.mark.parametrize("with_rejects", [True, False])
def test_checked_write_equals_the_check(spark, tmp_path, rows, with_rejects):
    data = [("1", "a", "2024-01-01"), ("1", None, "x"), (None, "b", None), ("", "c", "2024-01-02"), ("2", "d", "2024-02-30"), ("2", "e", "2024-01-05")]
    df = spark.createDataFrame(data, "id string, name string, d string").repartition(3)
    rules = TableRules("t", ("id", "name"), ("id",), {"name": 0.1, "d": 0.9, "none": 0.1}, "d")
    usable = is_usable(("id",), ("name",)) if with_rejects else None
    path = str(tmp_path / "t")
    issues, kept = write_checked(df, rules, path, usable)
    assert rows(issues) == rows(check_table(df, rules)) and issues.count() == 3
    whole = spark.read.parquet(path)
    assert whole.count() == 6 and kept.columns == df.columns
    assert kept.count() == (3 if with_rejects else 6)
    if with_rejects:
        assert whole.where("situacao = 'rejeitada'").count() == 3


def test_checked_write_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([(None, "x")], "id string, name string")
    rules = TableRules("t", ("id", "other"), ("id",), {"name": 0.1})
    issues, kept = write_checked(df, rules, str(tmp_path / "a"), is_usable(("id",)))
    assert [r["rule"] for r in issues.collect()] == ["required_columns"] and kept.count() == 0
    empty, none = write_checked(df.limit(0), TableRules("t", keys=("id",)), str(tmp_path / "b"))
    assert empty.count() == 0 and none.count() == 0
    assert missing_columns(df, rules) == ["other"]
    with pytest.raises(ValueError):
        write_checked(df.withColumn("situacao", df["id"]), rules, str(tmp_path / "c"))
