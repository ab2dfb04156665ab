from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from signals.operators.enrich import (
    KEY,
    address_misses,
    batch_provider,
    enrich_addresses,
    gazetteer_provider,
    repaired_cache,
    updated_cache,
)
from signals.operators.masking import mask_rows, mask_table, rule_for
from signals.sources.sheets import (
    LINE,
    header_line,
    ingest_sheets,
    mask_files,
    mask_sheet_files,
    mask_sheet,
    numbered_body,
    read_top_lines,
)
from signals.sources.tables import read_report, read_table, write_report, write_table


def test_rules_by_whole_words():
    expected = {
        "Nome Master": "name",
        "E-mail": "email",
        "Telefone": "phone",
        "CPF": "document",
        "CEP": "postcode",
        "Endereço": "address",
        "Cidade": "city",
        "UF": "state",
        "Dt Cadastro": "date",
        "Data": "date",
        "Valor Total": "number",
        "Cód. Cliente": "id",
        "Pedido": "id",
        "Origem": None,
        "Cargo": None,
        "Opcao": None,
    }
    assert {n: rule_for(n) for n in expected} == expected


def people(spark):
    data = [
        (str(i % 5), "Maria", "m@x", "11 9", "1", "d", "r", "c", "e", "15/03/2024" if i else "soon", "1.234,56" if i else "?", "free")
        for i in range(40)
    ]
    names = "Codigo, Nome, Email, Telefone, CPF, CEP, `Endereço`, Cidade, Estado, `Dt Cadastro`, `Valor Total`, Obs"
    schema = ", ".join(f"{n} string" for n in names.split(", "))
    return spark.createDataFrame(data, schema).withColumn("linha", F.monotonically_increasing_id())


def test_mask_table(spark):
    df = people(spark).cache()
    out = mask_table(df, "salt", ["linha"]).orderBy("linha").collect()
    for original, r in zip(df.orderBy("linha").collect(), out):
        assert re.fullmatch(r"ID[0-9a-f]{16}", r["Codigo"])
        assert r["Nome"] != "Maria" and " " in r["Nome"]
        assert re.fullmatch(r"cliente[0-9a-f]{12}@example\.com", r["Email"])
        assert re.fullmatch(r"\(\d{2}\) 9\d{4}-\d{4}", r["Telefone"])
        assert re.fullmatch(r"\d{3}\.\d{3}\.\d{3}-\d{2}", r["CPF"])
        assert re.fullmatch(r"\d{5}-\d{3}", r["CEP"])
        assert r["Obs"] == "free"
    assert out[0]["Dt Cadastro"] == "soon" and out[0]["Valor Total"] == "?"
    assert all(re.fullmatch(r"\d{2}/\d{2}/\d{4}", r["Dt Cadastro"]) for r in out[1:])
    amounts = [float(r["Valor Total"].replace(",", ".")) for r in out[1:]]
    assert len(set(amounts)) > 30 and 1234.56 * 0.8 < sum(amounts) / len(amounts) < 1234.56 * 1.2
    # Equal ids stay equal, other cells are not linkable, and a salt fixes the output.
    assert len({r["Codigo"] for r in out}) == 5 and len({r["Email"] for r in out}) == 40
    assert mask_table(df.repartition(3), "salt", ["linha"]).orderBy("linha").collect() == out
    assert mask_table(df, "other", ["linha"]).orderBy("linha").first()["Codigo"] != out[0]["Codigo"]


def test_mask_options(spark):
    df = spark.createDataFrame([("", "x"), ("nan", "y"), (None, "z"), ("7", "w")], "Codigo string, Obs string")
    out = [r["Codigo"] for r in mask_table(df, "s", ["Obs"]).collect()]
    assert out[:3] == ["", "nan", None] and out[3].startswith("ID")
    hidden = mask_table(df, "s", ["Obs"], hide_unknown_text=True).collect()
    assert all(r["Obs"].startswith("ID") for r in hidden)
    kept = mask_table(df, "s", ["Obs"], rules={"Codigo": None}).collect()
    assert kept[3]["Codigo"] == "7"


SHEET = [
    (0, "Relatorio", None, None),
    (1, "Filial", "2024", None),
    (2, "Cód. Cliente", " Nome ", "  "),
    (3, "1", "Ana", "x"),
    (4, "2", "Bia", None),
    (5, "3", None, None),
]


def sheet(spark, lines=SHEET):
    return spark.createDataFrame(lines, f"{LINE} int, c0 string, c1 string, c2 string")


def test_header_detection(spark, rows):
    assert header_line(sheet(spark)).first()["header_line"] == 2
    assert rows(numbered_body(sheet(spark))) == [("1", "Ana"), ("2", "Bia"), ("3", None)]
    assert numbered_body(sheet(spark)).columns == ["Cód. Cliente", "Nome"]
    plain = [(0, "a", "b", "c"), (1, "d", "e", "f"), (2, "nome", "g", "h")]
    assert header_line(sheet(spark, plain)).first()["header_line"] == 1
    assert header_line(sheet(spark, plain[:1])).first()["header_line"] == 0
    tie = [(0, "nome", "valor", ""), (1, "data", "pedido", "")]
    assert header_line(sheet(spark, tie)).first()["header_line"] == 0
    late = [(i, "x", "y", "z") for i in range(10)] + [(10, "nome", "valor", "data")]
    assert header_line(sheet(spark, late)).first()["header_line"] == 1


def test_mask_sheet_keeps_header_and_masks_banner_data(spark):
    out = mask_sheet(sheet(spark), 2, "s").orderBy(LINE).collect()
    assert tuple(out[2])[1:] == ("Cód. Cliente", " Nome ", "  ")
    assert out[0]["c0"].startswith("ID") and out[3]["c0"].startswith("ID")
    assert out[3]["c1"] != "Ana"


def test_ingest_many_files(spark, tmp_path, rows):
    top = "Relatorio,,\nFilial,2024,\nCód. Cliente, Nome ,\n"
    (tmp_path / "a.csv").write_text(top + "1,Ana,x\n2,Bia,\n")
    (tmp_path / "b.csv").write_text(top + "3,Caio,\n")
    assert [r["c0"] for r in read_top_lines(spark, str(tmp_path / "a.csv")).orderBy(LINE).collect()] == ["Relatorio", "Filial", "Cód. Cliente", "1", "2"]
    for line in (2, None):
        df = ingest_sheets(spark, str(tmp_path), line)
        assert df.columns == ["Cód. Cliente", "Nome"]
        assert rows(df) == [("1", "Ana"), ("2", "Bia"), ("3", "Caio")]
    with pytest.raises(ValueError):
        ingest_sheets(spark, str(tmp_path), 9)


def test_ingest_keeps_rows_like_the_banner_and_tells_wide_ones(spark, tmp_path, rows):
    body = "".join(f"{i},x\n" for i in range(20))
    (tmp_path / "a.csv").write_text("Relatorio,\n\nCodigo,Nome\nRelatorio,\n\n" + body + '99,"a, b",extra\n100,,\n7\n')
    df = ingest_sheets(spark, str(tmp_path), wide="_wide")
    got = {r["Codigo"]: r for r in df.collect()}
    assert df.columns == ["Codigo", "Nome", "_wide"] and df.count() == 24
    assert got["Relatorio"]["Nome"] is None and got["99"]["Nome"] == "a, b" and got["7"]["Nome"] is None
    assert {k for k, r in got.items() if r["_wide"]} == {"99", "100"}
    with pytest.raises(Exception, match="more cells than the header"):
        ingest_sheets(spark, str(tmp_path)).collect()


def test_files_of_other_layouts(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text("Relatorio,\nCodigo,Nome\n1,Ana\n")
    (tmp_path / "b.csv").write_text("Nome,Codigo,\nBia,2,\n")
    (tmp_path / "c.csv").write_text("x,\n,\ny,\nCodigo, Nome \n3,Caio\n4\n")
    (tmp_path / "d.csv").write_text("")
    df = ingest_sheets(spark, str(tmp_path), line=None)
    assert df.columns == ["Codigo", "Nome"] and rows(df) == [("1", "Ana"), ("2", "Bia"), ("3", "Caio"), ("4", None)]
    (tmp_path / "e.csv").write_text("Codigo,Valor\n5,10\n")
    with pytest.raises(ValueError, match="e.csv"):
        ingest_sheets(spark, str(tmp_path), line=None)
    assert ("5", None) in rows(ingest_sheets(spark, str(tmp_path), line=None, lenient=True))
    (tmp_path / "wide").mkdir()
    (tmp_path / "wide" / "a.csv").write_text("Codigo,Nome\n1,Ana,more,cells\n")
    assert [r["w"] for r in ingest_sheets(spark, str(tmp_path / "wide"), line=0, wide="w").collect()] == ["1,Ana,more,cells"]
    (tmp_path / "twice").mkdir()
    (tmp_path / "twice" / "a.csv").write_text("Codigo,Codigo\n1,2\n")
    with pytest.raises(ValueError, match="twice"):
        ingest_sheets(spark, str(tmp_path / "twice"), line=0)


def test_quoted_line_breaks_over_many_splits(spark, tmp_path, rows):
    draw = random.Random(3)
    made = []
    for i in range(400):
        note = draw.choice(["plain", 'say ""hi""', "two\nlines", "a,\n\n,b", "\n" * 90 + "end", "cr\r\nlf", ""])
        made.append((str(i), note))
    text = 'Relatorio,"of\ntwo lines"\nCodigo,Nome\n' + "".join(f'{i},"{n}"\r\n' for i, n in made)
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = ingest_sheets(spark, str(tmp_path), line=1)
        got = sorted((r["Codigo"], r["Nome"] or "") for r in df.collect())
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    want = sorted((i, n.replace('""', '"')) for i, n in made for _ in range(2))
    assert [(i, n.replace("\r\n", "\n")) for i, n in got] == [(i, n.replace("\r\n", "\n")) for i, n in want]
    (tmp_path / "c.csv").write_text('Codigo,Nome\n1,"open\n')
    with pytest.raises(ValueError, match="c.csv"):
        ingest_sheets(spark, str(tmp_path), line=0)


def test_masked_copies_of_sheets(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('Relatorio de vendas\nJoao Silva,900,x\n\nCod. Cliente,Nome,Obs\n17,"Ana\nMaria",ok\n18,Bia\n19,Caio,so,wide\n')
    (tmp_path / "in" / "b.csv").write_text("Nome,Cod. Cliente,Obs\nAna,17,ok\n")
    assert mask_sheet_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), "s") == 2
    read = lambda f: [r.value for r in spark.read.text(str(tmp_path / "out" / f"arquivo={f}"), wholetext=True).collect()][0]
    a, b = read("a.csv"), read("b.csv")
    lines = a.split("\n")
    assert lines[3] == "Cod. Cliente,Nome,Obs" and "Joao" not in a and "Ana" not in a and "Bia" not in a and "Caio" not in a
    assert lines[4].startswith("ID") and lines[4].endswith(",ok") and "wide" not in a
    assert b.split("\n")[0] == "Nome,Cod. Cliente,Obs" and "Ana" not in b
    assert b.split("\n")[1].split(",")[1] == lines[4].split(",")[0]  # the same customer keeps one pseudonym


def test_row_digests_tell_parts_apart(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c")], "x string, y string").withColumn("Nome", F.lit("n")).withColumn("Email", F.lit("e"))
    assert len({r["Email"] for r in mask_table(df, "s", ["x", "y"]).collect()}) == 2
    keyed = df.withColumn("_key", F.lit("mine"))
    out = mask_rows(keyed, "s")
    assert out.columns == keyed.columns and {r["_key"] for r in out.collect()} == {"mine"}


def test_masking_fails_closed(spark):
    df = people(spark)
    with pytest.raises(ValueError):
        mask_table(df, "", ["linha"])
    keyed = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string").withColumn("Email", F.lit("e"))
    assert len({r["Email"] for r in mask_table(keyed, "s", ["x", "y", "z"]).collect()}) == 2
    dotted = spark.createDataFrame([("1", "Ana"), ("2", "Bia")], "`Cód. Cliente` string, Nome string")
    out = mask_rows(dotted, "s", hide_unknown_text=True)
    assert out.columns == dotted.columns and all(r[0].startswith("ID") for r in out.collect())


def test_mask_files_skips_absent(spark, tmp_path):
    people(spark).write.parquet(str(tmp_path / "p"))
    files = {"p": (str(tmp_path / "p"), ["linha"]), "q": (str(tmp_path / "q"), ["linha"])}
    assert mask_files(spark, files, str(tmp_path / "out"), "s") == ["p"]
    assert spark.read.parquet(str(tmp_path / "out" / "p")).count() == 40


def test_tables_and_reports(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    write_table(df, str(tmp_path / "t"), "k")
    assert rows(read_table(spark, str(tmp_path / "t"), "v int, k string")) == [(1, "a"), (2, "b")]
    assert read_table(spark, str(tmp_path / "none"), "v int", optional=True).count() == 0
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "none"), optional=True)
    write_report(df, str(tmp_path / "r"), single_file=True)
    assert rows(read_report(spark, str(tmp_path / "r"), "k string, v int")) == [("a", 1), ("b", 2)]


def addresses(spark):
    return spark.createDataFrame(
        [(1, "Rua A, 123"), (2, " rua a, 123 "), (3, "Rua B, 456"), (4, None), (5, ""), (6, "Rua C, 789")],
        "id int, endereco string",
    )


def test_address_misses(spark, rows):
    cache = spark.createDataFrame([("rua b, 456", 1.0, 2.0)], f"{KEY} string, lat double, lon double")
    got = rows(address_misses(addresses(spark), cache, city="Recife"))
    assert got == [("rua a, 123", " rua a, 123 , Recife"), ("rua c, 789", "Rua C, 789, Recife")]


def test_enrichment_round_trip(spark, rows):
    cache = spark.createDataFrame([], f"{KEY} string, lat double, lon double")
    known = spark.createDataFrame([("rua a, 123", -8.0, -34.0), ("rua b, 456", -8.5, -34.5)], f"{KEY} string, lat double, lon double")
    grown = updated_cache(addresses(spark), cache, gazetteer_provider(known))
    assert grown.count() == 2
    out = enrich_addresses(addresses(spark), grown)
    assert out.columns == ["id", "endereco", "lat", "lon"]
    assert rows(out, "id", "lat") == [(1, -8.0), (2, -8.0), (3, -8.5), (4, None), (5, None), (6, None)]
    # The failed address is asked for again on the next run.
    assert rows(address_misses(addresses(spark), grown), KEY) == [("rua c, 789",)]


def test_batch_provider(spark):
    cache = spark.createDataFrame([], f"{KEY} string, lat double, lon double")
    provider = batch_provider(lambda pdf: pdf[pdf[KEY] != "rua c, 789"].assign(lat=-8.05428, lon=-34.8813))
    out = enrich_addresses(addresses(spark), updated_cache(addresses(spark), cache, provider))
    assert out.filter("lat is not null").count() == 3


def test_empty_and_missing_column(spark):
    cache = spark.createDataFrame([], f"{KEY} string, lat double, lon double")
    empty = spark.createDataFrame([], "endereco string")
    out = enrich_addresses(empty, cache)
    assert out.count() == 0 and {"lat", "lon"} <= set(out.columns)
    with pytest.raises(ValueError):
        enrich_addresses(spark.createDataFrame([], "x string"), cache)
    with pytest.raises(ValueError):
        address_misses(spark.createDataFrame([], "x string"), cache)


def test_old_cache_repair(spark):
    old = spark.createDataFrame([(" Rua A ", 1.0, 2.0)], "endereco string, lat double, lon double")
    assert repaired_cache(old, "endereco").first()[KEY] == "rua a"
    assert repaired_cache(old.drop("endereco"), "endereco").first()[KEY] == ""
