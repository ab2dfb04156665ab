"""Cleaning, quality, sheet, masking and address queries.

The test tables are already clean, so the raw inputs here are derived from whole tables by
the same key arithmetic in Spark and in SQL: every row is kept and rewritten as the kind of
text a spreadsheet export holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from signals.catalog.registry import query, rounded, table
from signals.functions.text import parse_count, parse_day_first, parse_money
from signals.operators.clean import clean_customers, clean_factory_orders, clean_purchases, is_usable, parse_purchases
from signals.operators.enrich import address_misses, enrich_addresses, gazetteer_provider, repaired_cache, updated_cache
from signals.operators.masking import (
    CITIES,
    FIRST_NAMES,
    LAST_NAMES,
    STATES,
    STREETS,
    mask_table,
)
from signals.operators.quality import (
    ACCEPTED,
    CUSTOMER_RULES,
    FACTORY_RULES,
    PURCHASE_RULES,
    SITUATION,
    gate_status,
    quality_report,
    write_checked,
)
from signals.sources.scratch import scratch_path
from signals.sources.sheets import HEADER_HINTS, LINE, header_line, ingest_sheets, mask_sheet, numbered_body, text_schema

# --- raw text, in Spark -----------------------------------------------------------------


def _style(key: str, n: int, *texts: Column) -> Column:
    out = None
    for i, t in enumerate(texts):
        hit = F.col(key) % n == i
        out = F.when(hit, t) if out is None else out.when(hit, t)
    return out


def _two(amount: Column) -> Column:
    return F.format_string("%.2f", amount)


def _grouped(amount: Column) -> Column:
    return F.translate(F.format_number(amount, 2), ",.", ".,")


def _money(key: str, amount: str) -> Column:
    c = F.col(amount)
    cents = F.translate(F.format_number(F.round(c * 100).cast("long"), 0), ",", ".")
    return _style(
        key,
        6,
        _grouped(c),
        F.translate(_two(c), ".", ","),
        _two(c),
        F.lit("  "),
        F.concat(F.lit("R$ "), _two(c)),
        cents,
    )


def _date(key: str, moment: str) -> Column:
    c = F.col(moment)
    short = F.date_format(c, "dd/MM/yyyy")
    return _style(
        key,
        5,
        short,
        short,
        F.date_format(c, "yyyy-MM-dd"),
        F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
        F.lit("31/02/2024"),
    )


def _count(key: str) -> Column:
    n = (F.col(key) % 50).cast("string")
    return _style(key, 4, n, F.concat(n, F.lit(".7")), F.lit(""), F.lit("x"))


def _with_copies(df: DataFrame, key: str, every: int) -> DataFrame:
    copies = F.when(F.col(key) % every == 0, F.sequence(F.lit(1), F.lit(2))).otherwise(F.sequence(F.lit(1), F.lit(1)))
    return df.withColumn("_copy", F.explode(copies)).drop("_copy")


def raw_purchases(spark, d) -> DataFrame:
    key = F.col("o_orderkey")
    customer = F.when(key % 97 == 0, F.lit(None)).when(key % 101 == 0, F.lit(" ")).otherwise(F.col("o_custkey").cast("string"))
    moment = F.when(key % 53 != 0, _date("o_orderkey", "o_orderdate"))
    return _with_copies(table(spark, d, "orders"), "o_orderkey", 89).select(
        F.concat(F.lit(" "), key.cast("string")).alias("OP"),
        F.col("o_orderpriority").alias("Origem"),
        customer.alias("Cód. Cliente"),
        _count("o_orderkey").alias("Qtde Itens"),
        _money("o_orderkey", "o_totalprice").alias("Valor Total"),
        F.concat((key % 100).cast("string"), F.lit(",50")).alias("Valor Desconto"),
        moment.alias("Data"),
    )


def raw_customers(spark, d) -> DataFrame:
    key = F.col("c_custkey")
    joined = F.date_add(F.lit("2020-01-01").cast("date"), (key % 1000).cast("int"))
    return _with_copies(table(spark, d, "customer"), "c_custkey", 50).select(
        key.cast("string").alias("Codigo"),
        F.when(key % 4 != 0, F.col("c_name")).alias("Nome"),
        F.col("c_mktsegment").alias("Nome Master"),
        F.date_format(joined, "d/M/yyyy").alias("Dt Cadastro"),
        F.date_format(F.date_add(joined, 30), "yyyy-MM-dd").alias("Dt Última Compra"),
        (key % 7).cast("string").alias("Qtde Pontos no Mês"),
    )


def raw_factory_orders(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("Pedido"),
        F.col("l_suppkey").cast("string").alias("Nome Consultor"),
        _money("l_orderkey", "l_extendedprice").alias("Valor"),
        _date("l_orderkey", "l_shipdate").alias("Data Pedido"),
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("Data Nota Fiscal"),
    )


# --- the same in SQL --------------------------------------------------------------------


def money_sql(key: str, c: str) -> str:
    return f"""CASE {key} % 6 WHEN 0 THEN translate(format('{{:,.2f}}', {c}), ',.', '.,')
WHEN 1 THEN replace(printf('%.2f', {c}), '.', ',') WHEN 2 THEN printf('%.2f', {c}) WHEN 3 THEN '  '
WHEN 4 THEN 'R$ ' || printf('%.2f', {c}) ELSE replace(format('{{:,}}', CAST(round({c} * 100) AS BIGINT)), ',', '.') END"""


def date_sql(key: str, c: str) -> str:
    return f"""CASE {key} % 5 WHEN 2 THEN strftime({c}, '%Y-%m-%d') WHEN 3 THEN strftime({c}, '%Y-%m-%d %H:%M:%S')
WHEN 4 THEN '31/02/2024' ELSE strftime({c}, '%d/%m/%Y') END"""


def count_sql(key: str) -> str:
    return f"""CASE {key} % 4 WHEN 0 THEN CAST({key} % 50 AS VARCHAR) WHEN 1 THEN ({key} % 50) || '.7'
WHEN 2 THEN '' ELSE 'x' END"""


_NUMBER_SQL = r"'[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?'"


def parse_money_sql(x: str) -> str:
    t = f"CASE WHEN contains({x}, ',') THEN replace(replace({x}, '.', ''), ',', '.') ELSE {x} END"
    t = f"replace(trim({t}), ' ', '')"
    return f"CASE WHEN regexp_full_match({t}, {_NUMBER_SQL}) THEN TRY_CAST({t} AS DOUBLE) END"


def parse_date_sql(x: str) -> str:
    formats = ("%d/%m/%Y", "%d/%m/%Y %H:%M:%S", "%Y-%m-%d", "%Y-%m-%d %H:%M:%S")
    return "coalesce(" + ", ".join(f"try_strptime({x}, '{f}')" for f in formats) + ")"


def parse_count_sql(x: str) -> str:
    number = f"CASE WHEN regexp_full_match(trim({x}), {_NUMBER_SQL}) THEN TRY_CAST(trim({x}) AS DOUBLE) END"
    return f"CAST(trunc(coalesce({number}, 0)) AS BIGINT)"


RAW_PURCHASES = f"""
rp0 AS (SELECT o_orderkey, o_orderpriority,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN ' ' ELSE CAST(o_custkey AS VARCHAR) END cust,
  {count_sql("o_orderkey")} q, {money_sql("o_orderkey", "o_totalprice")} v,
  (o_orderkey % 100) || ',50' dsc,
  CASE WHEN o_orderkey % 53 <> 0 THEN {date_sql("o_orderkey", "o_orderdate")} END dt,
  unnest(range(0, CASE WHEN o_orderkey % 89 = 0 THEN 2 ELSE 1 END)) AS copy FROM orders),
pp AS (SELECT CAST(o_orderkey AS VARCHAR) id_pedido, o_orderpriority origem, trim(cust) id_cliente,
  {parse_count_sql("q")} qtde_itens, coalesce({parse_money_sql("v")}, 0) valor_total,
  coalesce({parse_money_sql("dsc")}, 0) valor_desconto, CAST({parse_date_sql("dt")} AS TIMESTAMP) data_compra FROM rp0)"""
CLEAN_PURCHASES = """SELECT id_pedido, origem, id_cliente, qtde_itens, round(valor_total, 4) valor_total,
round(valor_desconto, 4) valor_desconto, data_compra FROM pp
WHERE coalesce(id_cliente, '') <> '' AND coalesce(id_pedido, '') <> '' AND data_compra IS NOT NULL"""
RAW_CUSTOMERS = """
rc0 AS (SELECT *, DATE '2020-01-01' + CAST(c_custkey % 1000 AS INTEGER) joined,
  unnest(range(0, CASE WHEN c_custkey % 50 = 0 THEN 2 ELSE 1 END)) AS copy FROM customer),
pc AS (SELECT CAST(c_custkey AS VARCHAR) id_cliente, CASE WHEN c_custkey % 4 <> 0 THEN c_name END nome_cliente,
  c_mktsegment nome_master, CAST(joined AS TIMESTAMP) data_cadastro, CAST(joined + 30 AS TIMESTAMP) data_ultima_compra,
  CAST(c_custkey % 7 AS VARCHAR) qtde_pontos_mes FROM rc0)"""
RAW_FACTORY = f"""
pf AS (SELECT CAST(l_orderkey AS VARCHAR) id_pedido, CAST(l_suppkey AS VARCHAR) nome_cliente,
  coalesce({parse_money_sql("(" + money_sql("l_orderkey", "l_extendedprice") + ")")}, 0) valor_pedido,
  CAST({parse_date_sql("(" + date_sql("l_orderkey", "l_shipdate") + ")")} AS TIMESTAMP) data_pedido,
  strftime(l_shipdate, '%d/%m/%Y') data_nota_fiscal FROM lineitem)"""

# --- parsing and cleaning ---------------------------------------------------------------


@query("parse_money", f"""WITH t AS (SELECT o_orderkey, {money_sql("o_orderkey", "o_totalprice")} x FROM orders)
SELECT o_orderkey, x AS texto, round({parse_money_sql("x")}, 4) valor FROM t""")
def parse_money_query(spark, d):
    texts = table(spark, d, "orders").select("o_orderkey", _money("o_orderkey", "o_totalprice").alias("texto"))
    return texts.withColumn("valor", F.round(parse_money(F.col("texto")), 4))


@query("parse_dates", f"""WITH t AS (SELECT o_orderkey, {date_sql("o_orderkey", "o_orderdate")} x FROM orders)
SELECT o_orderkey, x AS texto, CAST({parse_date_sql("x")} AS TIMESTAMP) momento FROM t""")
def parse_dates_query(spark, d):
    texts = table(spark, d, "orders").select("o_orderkey", _date("o_orderkey", "o_orderdate").alias("texto"))
    return texts.withColumn("momento", parse_day_first(F.col("texto")))


@query("parse_qty", f"""WITH t AS (SELECT l_orderkey, l_linenumber, {count_sql("l_orderkey")} x FROM lineitem)
SELECT l_orderkey, l_linenumber, x AS texto, {parse_count_sql("x")} quantidade FROM t""")
def parse_qty_query(spark, d):
    texts = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _count("l_orderkey").alias("texto"))
    return texts.withColumn("quantidade", parse_count(F.col("texto")))


@query("clean_purchases", f"WITH {RAW_PURCHASES} {CLEAN_PURCHASES}")
def clean_purchases_query(spark, d):
    return rounded(clean_purchases(raw_purchases(spark, d)), valor_total=4, valor_desconto=4)


@query("clean_customers", f"WITH {RAW_CUSTOMERS} SELECT * FROM pc")
def clean_customers_query(spark, d):
    return clean_customers(raw_customers(spark, d))


@query("clean_factory_orders", f"""WITH {RAW_FACTORY} SELECT id_pedido, nome_cliente,
round(valor_pedido, 4) valor_pedido, data_pedido, data_nota_fiscal FROM pf""")
def clean_factory_orders_query(spark, d):
    return rounded(clean_factory_orders(raw_factory_orders(spark, d)), valor_pedido=4)


# --- quality ----------------------------------------------------------------------------


def _dup_sql(dataset: str, src: str, key: str) -> str:
    return f"""SELECT '{dataset}' dataset, 'duplicates' rule, 'warning' severity,
(count(*) - count(DISTINCT coalesce({key}, '?'))) || ' duplicated rows on keys [''{key}'']' details
FROM {src} HAVING count(*) > count(DISTINCT coalesce({key}, '?'))"""


def _null_sql(dataset: str, src: str, c: str, limit: float) -> str:
    ratio = f"avg(CAST({c} IS NULL AS DOUBLE))"
    return f"""SELECT '{dataset}', 'null_threshold', 'warning',
'{c}: null_ratio=' || printf('%.3f', round_even({ratio}, 3)) || ' > {limit:.3f}' FROM {src} HAVING {ratio} > {limit}"""


def _bad_date_sql(dataset: str, src: str, c: str) -> str:
    return f"""SELECT '{dataset}', 'invalid_dates', 'warning',
count(*) FILTER (WHERE {c} IS NULL) || ' invalid/NaT values in {c}' FROM {src}
HAVING count(*) FILTER (WHERE {c} IS NULL) > 0"""


QUALITY_CTE = f"{RAW_PURCHASES}, {RAW_CUSTOMERS}, {RAW_FACTORY}, issues AS (" + " UNION ALL ".join(
    [
        _dup_sql("compras", "pp", "id_pedido"),
        _null_sql("compras", "pp", "id_cliente", 0.01),
        _null_sql("compras", "pp", "valor_total", 0.01),
        _bad_date_sql("compras", "pp", "data_compra"),
        _dup_sql("clientes", "pc", "id_cliente"),
        _null_sql("clientes", "pc", "nome_cliente", 0.20),
        _null_sql("clientes", "pc", "data_cadastro", 0.80),
        _bad_date_sql("clientes", "pc", "data_cadastro"),
        _dup_sql("pedidos_cd", "pf", "id_pedido"),
        _null_sql("pedidos_cd", "pf", "data_pedido", 0.05),
        _bad_date_sql("pedidos_cd", "pf", "data_pedido"),
    ]
) + ")"


def _issues(spark, d) -> DataFrame:
    return quality_report(
        parse_purchases(raw_purchases(spark, d)),
        clean_customers(raw_customers(spark, d)),
        clean_factory_orders(raw_factory_orders(spark, d)),
    )


@query("quality_report", f"WITH {QUALITY_CTE} SELECT * FROM issues")
def quality_report_query(spark, d):
    return _issues(spark, d)


@query("quality_gate", f"""WITH {QUALITY_CTE} SELECT count(*) FILTER (WHERE severity = 'error') n_errors,
count(*) FILTER (WHERE severity = 'warning') n_warnings,
CAST(count(*) FILTER (WHERE severity = 'error') = 0 AS INTEGER) passed FROM issues""")
def quality_gate_query(spark, d):
    return gate_status(_issues(spark, d))


def _write_all_checked(spark, d) -> list[tuple[str, str, DataFrame, DataFrame]]:
    """The three parsed tables written and checked in one pass each: dataset, path, issues, usable rows."""
    tables = (
        (parse_purchases(raw_purchases(spark, d)), PURCHASE_RULES, is_usable(("id_cliente", "id_pedido"), ("data_compra",))),
        (clean_customers(raw_customers(spark, d)), CUSTOMER_RULES, None),
        (clean_factory_orders(raw_factory_orders(spark, d)), FACTORY_RULES, None),
    )
    out = []
    for df, rules, usable in tables:
        path = scratch_path(spark)
        out.append((rules.dataset, path, *write_checked(df, rules, path, usable)))
    return out


@query("quality_report_observed", f"WITH {QUALITY_CTE} SELECT * FROM issues")
def quality_report_observed(spark, d):
    """The same report from what is observed while the parsed tables are written, without a second pass over the raw ones."""
    (_, _, report, _), *rest = _write_all_checked(spark, d)
    for _, _, issues, _ in rest:
        report = report.unionByName(issues)
    return report


@query("checked_tables", f"""WITH {RAW_PURCHASES}, {RAW_CUSTOMERS}, {RAW_FACTORY},
u AS (SELECT *, coalesce(id_cliente, '') <> '' AND coalesce(id_pedido, '') <> '' AND data_compra IS NOT NULL ok FROM pp)
SELECT 'compras' dataset, CASE WHEN ok THEN 'aceita' ELSE 'rejeitada' END situacao, count(*) linhas, count(DISTINCT id_pedido) pedidos,
  CAST(sum(CAST(valor_total AS DECIMAL(18, 4))) AS DOUBLE) valor FROM u GROUP BY ok
UNION ALL SELECT 'clientes', 'aceita', count(*), NULL, NULL FROM pc
UNION ALL SELECT 'pedidos_cd', 'aceita', count(*), count(DISTINCT id_pedido), CAST(sum(CAST(valor_pedido AS DECIMAL(18, 4))) AS DOUBLE) FROM pf""")
def checked_tables(spark, d):
    """What the checked tables hold, usable and rejected rows apart, read back from the files."""
    rows = None
    for dataset, path, _, usable in _write_all_checked(spark, d):
        order, value = ("id_pedido", "valor_total" if dataset == "compras" else "valor_pedido")
        read = spark.read.parquet(path) if dataset == "compras" else usable.withColumn(SITUATION, F.lit(ACCEPTED))
        known = dataset != "clientes"
        count = read.groupBy(SITUATION).agg(
            F.count(F.lit(1)).alias("linhas"),
            (F.count_distinct(order) if known else F.max(F.lit(None).cast("long"))).alias("pedidos"),
            (F.sum(F.col(value).cast("decimal(18,4)")).cast("double") if known else F.max(F.lit(None).cast("double"))).alias("valor"),
        )
        part = count.select(F.lit(dataset).alias("dataset"), SITUATION, "linhas", "pedidos", "valor")
        rows = part if rows is None else rows.unionByName(part)
    return rows


_MISSING_CTE = QUALITY_CTE.replace("issues AS (", "issues AS (" + " UNION ALL ".join([
    """SELECT 'compras' dataset, 'required_columns' rule, 'error' severity,
  'Missing required columns: [''data_compra'', ''valor_total'']' details""",
    "SELECT 'clientes', 'required_columns', 'error', 'Missing required columns: [''nome_cliente'']'",
]) + " UNION ALL ").replace(" UNION ALL " + _null_sql("compras", "pp", "valor_total", 0.01), "").replace(
    " UNION ALL " + _bad_date_sql("compras", "pp", "data_compra"), "").replace(
    " UNION ALL " + _null_sql("clientes", "pc", "nome_cliente", 0.20), "")


@query("quality_report_missing", f"WITH {_MISSING_CTE} SELECT * FROM issues")
def quality_report_missing(spark, d):
    """Tables that came without required columns: errors for those, and the checks of the columns that are there."""
    return quality_report(
        parse_purchases(raw_purchases(spark, d)).drop("data_compra", "valor_total"),
        clean_customers(raw_customers(spark, d)).drop("nome_cliente"),
        clean_factory_orders(raw_factory_orders(spark, d)),
    )


# --- sheets -----------------------------------------------------------------------------


def purchase_sheet(spark, d) -> DataFrame:
    """All raw purchases as a numbered sheet: two banner lines, a header line, then the rows."""
    raw = raw_purchases(spark, d)
    cells = {f"c{i}": F.col(f"`{name}`") for i, name in enumerate(raw.columns)}
    cells[f"c{len(raw.columns)}"] = F.lit("nota")  # a column without a header
    keyed = raw.withColumn(LINE, (F.trim("OP").cast("long") + 3))
    body = keyed.select(LINE, *[c.cast("string").alias(n) for n, c in cells.items()])
    blank = [None] * (len(raw.columns) + 1)
    top = [
        (0, *["Relatorio de vendas", *blank[1:]]),
        (1, *["Filial 1", "2024", *blank[2:]]),
        (2, *raw.columns, "  "),
    ]
    head = spark.createDataFrame(top, StructType([StructField(LINE, LongType()), *text_schema(len(blank)).fields]))
    return head.unionByName(body)


_SHEET_SQL = """src AS (SELECT o_orderkey + 3 ln, ' ' || o_orderkey c0, o_orderpriority c1, cust c2, q c3, v c4, dsc c5, dt c6, 'nota' c7
  FROM rp0
  UNION ALL SELECT 0, 'Relatorio de vendas', NULL, NULL, NULL, NULL, NULL, NULL, NULL
  UNION ALL SELECT 1, 'Filial 1', '2024', NULL, NULL, NULL, NULL, NULL, NULL
  UNION ALL SELECT 2, 'OP', 'Origem', 'Cód. Cliente', 'Qtde Itens', 'Valor Total', 'Valor Desconto', 'Data', '  ')"""


def _hits_sql(cell: str) -> str:
    folded = f"strip_accents(lower(trim(coalesce({cell}, ''))))"
    words = " OR ".join(f"contains({folded}, '{h}')" for h in HEADER_HINTS)
    return f"CAST(length({folded}) >= 2 AND ({words}) AS INTEGER)"


@query("header_detect", f"""WITH {RAW_PURCHASES}, {_SHEET_SQL},
scored AS (SELECT ln, {" + ".join(_hits_sql(f"c{i}") for i in range(8))} score FROM src WHERE ln < 10)
SELECT CAST(CASE WHEN max(score) < 2 AND count(*) > 1 THEN 1 ELSE arg_max(ln, score * 100 - ln) END AS INTEGER) header_line,
max(score) score FROM scored""")
def header_detect(spark, d):
    return header_line(purchase_sheet(spark, d))


#: Raw rows a CSV part is made of at least, besides three parts in any case.
ROWS_A_PART = 20_000


def csv_parts(spark, d) -> str:
    """The raw purchases as CSV files with a banner, a blank line and a header each, more files for more rows.

    Of three files one has its columns in reverse and one a second banner line. Each also has a body row that reads like its
    banner, and a late row with a cell too many; every seventh order has a quoted line break.
    """
    raw = raw_purchases(spark, d)
    parts = 3 + raw.count() // ROWS_A_PART
    broken = F.when(F.trim("OP").cast("long") % 7 == 0, F.concat("Origem", F.lit('\n("nota")'))).otherwise(F.col("Origem"))
    raw = raw.withColumn("Origem", broken)
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(raw.columns)]
    part = F.pmod(F.xxhash64(F.trim("OP")), F.lit(parts)).cast("int").alias("part")
    cells = lambda columns: F.to_csv(F.struct(*columns), {"escape": '"'})
    line = F.when(part % 3 == 1, cells(reversed(text))).otherwise(cells(text))
    rows = raw.select(part, F.lit(5).alias("place"), line.alias("value"))
    banner = "Relatorio de vendas,,,,,,"
    head = ",".join(raw.columns)
    every = spark.range(parts).select(F.col("id").cast("int").alias("part"))
    fixed = [
        (0, F.lit(banner)),
        (1, F.lit("")),
        (2, F.when(F.col("part") % 3 == 2, F.lit("Filial 1,2024,,,,,"))),
        (3, F.when(F.col("part") % 3 == 1, F.lit(",".join(reversed(raw.columns)))).otherwise(F.lit(head))),
        (4, F.lit(banner)),
        (9, F.lit("extra,,1,,,,,late cell")),
    ]
    for place, value in fixed:
        rows = rows.unionByName(every.select("part", F.lit(place).alias("place"), value.alias("value")).where("value IS NOT NULL"))
    path = scratch_path(spark)
    ordered = rows.repartition(parts, "part").sortWithinPartitions("part", "place")
    ordered.select("part", "value").write.partitionBy("part").text(path)
    return path + "/part=*"


_PARTS_SQL = f"range((SELECT 3 + (SELECT count(*) FROM rp0) // {ROWS_A_PART})) g(part)"


@query("sheet_ingest_files", f"""WITH {RAW_PURCHASES}
SELECT trim(' ' || o_orderkey) op, o_orderpriority || CASE WHEN o_orderkey % 7 = 0 THEN chr(10) || '("nota")' ELSE '' END origem,
nullif(trim(cust), '') cliente, nullif(trim(v), '') valor, dt AS data, CAST(NULL AS VARCHAR) larga FROM rp0
UNION ALL SELECT CASE WHEN part % 3 <> 1 THEN 'Relatorio de vendas' END, NULL, NULL, NULL,
  CASE WHEN part % 3 = 1 THEN 'Relatorio de vendas' END, NULL FROM {_PARTS_SQL}
UNION ALL SELECT CASE WHEN part % 3 <> 1 THEN 'extra' END, NULL, CASE WHEN part % 3 <> 1 THEN '1' END,
  CASE WHEN part % 3 = 1 THEN '1' END, CASE WHEN part % 3 = 1 THEN 'extra' END, 'extra,,1,,,,,late cell' FROM {_PARTS_SQL}""")
def sheet_ingest_files(spark, d):
    """The purchase sheet written as CSV files of different layouts and read back whole, each by its own header."""
    sheet = ingest_sheets(spark, csv_parts(spark, d), line=None, wide="larga")
    blank = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    return sheet.select(
        blank("OP").alias("op"),
        blank("Origem").alias("origem"),
        blank("Cód. Cliente").alias("cliente"),
        blank("Valor Total").alias("valor"),
        blank("Data").alias("data"),
        "larga",
    )


@query("sheet_ingest", f"WITH {RAW_PURCHASES} {CLEAN_PURCHASES}")
def sheet_ingest(spark, d):
    clean = clean_purchases(numbered_body(purchase_sheet(spark, d)))
    return rounded(clean, valor_total=4, valor_desconto=4)


# --- masking ----------------------------------------------------------------------------

SALT = "amostra"


def _digest_sql(name: str, key: str) -> str:
    return f"sha256('{SALT}|{name}|' || {key})"


def _draw_sql(h: str, part: int, n: int) -> str:
    return f"(CAST('0x' || substr({h}, {8 * part + 1}, 8) AS BIGINT) % {n})"


def _choose_sql(h: str, part: int, values: tuple[str, ...]) -> str:
    listed = "[" + ", ".join(f"'{v}'" for v in values) + "]"
    return f"{listed}[{_draw_sql(h, part, len(values))} + 1]"


def _uniform_sql(h: str, part: int) -> str:
    return f"((CAST('0x' || substr({h}, {8 * part + 1}, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def _masked_sql() -> str:
    def h(name: str) -> str:
        return _digest_sql(name, "\"Codigo\"")

    normal = f"sqrt(-2 * ln({_uniform_sql(h('Valor Saldo'), 0)})) * cos(2 * pi() * {_uniform_sql(h('Valor Saldo'), 1)})"
    fake = f"round({parse_money_sql('saldo')} * (1 + 0.15::DOUBLE * {normal}), 2)"
    phone, doc, cep, addr = h("Telefone"), h("CPF"), h("CEP"), h("Endereço")
    shift = f"CAST({_draw_sql(h('Dt Cadastro'), 0, 181)} - 90 AS INTEGER)"
    return f"""WITH src AS (SELECT CAST(c_custkey AS VARCHAR) AS "Codigo", c_mktsegment,
  translate(format('{{:,.2f}}', c_acctbal), ',.', '.,') saldo,
  DATE '2020-01-01' + CAST(c_custkey % 1000 AS INTEGER) joined, c_nationkey FROM customer)
SELECT 'ID' || substr(sha256('{SALT}|' || "Codigo"), 1, 16) "Codigo",
'ID' || substr(sha256('{SALT}|' || CAST(c_nationkey AS VARCHAR)), 1, 16) "Cod Master",
{_choose_sql(h("Nome"), 0, FIRST_NAMES)} || ' ' || {_choose_sql(h("Nome"), 1, LAST_NAMES)} "Nome",
'cliente' || substr({h("Email")}, 1, 12) || '@example.com' "Email",
printf('(%d) %d-%d', {_draw_sql(phone, 0, 88)} + 11, {_draw_sql(phone, 1, 9999)} + 90000, {_draw_sql(phone, 2, 8999)} + 1000) "Telefone",
printf('%03d.%03d.%03d-%02d', {_draw_sql(doc, 0, 1000)}, {_draw_sql(doc, 1, 1000)}, {_draw_sql(doc, 2, 1000)}, {_draw_sql(doc, 3, 100)}) "CPF",
printf('%d-%d', {_draw_sql(cep, 0, 89999)} + 10000, {_draw_sql(cep, 1, 899)} + 100) "CEP",
{_choose_sql(addr, 0, STREETS)} || ', ' || ({_draw_sql(addr, 1, 989)} + 10) "Endereço",
{_choose_sql(h("Cidade"), 0, CITIES)} "Cidade", {_choose_sql(h("Estado"), 0, STATES)} "Estado",
strftime(joined + {shift}, '%d/%m/%Y') "Dt Cadastro", replace(printf('%.2f', {fake}), '.', ',') "Valor Saldo",
c_mktsegment "Segmento" FROM src"""


def _personal(spark, d) -> DataFrame:
    key = F.col("c_custkey")
    text = F.lit("original")
    joined = F.date_add(F.lit("2020-01-01").cast("date"), (key % 1000).cast("int"))
    return table(spark, d, "customer").select(
        key.cast("string").alias("Codigo"),
        F.col("c_nationkey").cast("string").alias("Cod Master"),
        F.col("c_name").alias("Nome"),
        F.concat("c_name", F.lit("@mail")).alias("Email"),
        *[text.alias(n) for n in ("Telefone", "CPF", "CEP", "Endereço", "Cidade", "Estado")],
        F.date_format(joined, "dd/MM/yyyy").alias("Dt Cadastro"),
        _grouped(F.col("c_acctbal")).alias("Valor Saldo"),
        F.col("c_mktsegment").alias("Segmento"),
    )


@query("mask_customers_hidden", _masked_sql().replace(
    'c_mktsegment "Segmento"', f"""'ID' || substr(sha256('{SALT}|' || c_mktsegment), 1, 16) "Segmento\""""))
def mask_customers_hidden(spark, d):
    """Text that no rule knows is hidden too."""
    return mask_table(_personal(spark, d), SALT, ["Codigo"], hide_unknown_text=True)


@query("mask_customers", _masked_sql())
def mask_customers(spark, d):
    return mask_table(_personal(spark, d), SALT, ["Codigo"])


def _masked_sheet_sql() -> str:
    def h(column: str) -> str:
        return _digest_sql(column, "CAST(ln AS VARCHAR)")

    def ident(x: str) -> str:
        text = f"trim({x})"
        hidden = f"'ID' || substr(sha256('{SALT}|' || {text}), 1, 16)"
        return f"CASE WHEN lower({text}) IN ('', 'nan', 'none') THEN {text} ELSE {hidden} END"

    def number(column: str, x: str) -> str:
        normal = f"sqrt(-2 * ln({_uniform_sql(h(column), 0)})) * cos(2 * pi() * {_uniform_sql(h(column), 1)})"
        fake = f"round({parse_money_sql(x)} * (1 + 0.15::DOUBLE * {normal}), 2)"
        return f"coalesce(replace(printf('%.2f', {fake}), '.', ','), {x})"

    shift = f"CAST({_draw_sql(h('c6'), 0, 181)} - 90 AS INTEGER)"
    moved = f"strftime(CAST({parse_date_sql('dt')} AS DATE) + {shift}, '%d/%m/%Y')"
    head = "'OP', 'Origem', 'Cód. Cliente', 'Qtde Itens', 'Valor Total', 'Valor Desconto', 'Data', '  '"
    return f"""WITH {RAW_PURCHASES},
src AS (SELECT o_orderkey + 3 ln, ' ' || o_orderkey op, o_orderpriority pri, cust, q, v, dsc, dt, 'nota' nt FROM rp0
  UNION ALL SELECT 0, 'Relatorio de vendas', NULL, NULL, NULL, NULL, NULL, NULL, NULL
  UNION ALL SELECT 1, 'Filial 1', '2024', NULL, NULL, NULL, NULL, NULL, NULL)
SELECT ln _line, {ident("op")} c0, pri c1, {ident("cust")} c2, {number("c3", "q")} c3, {number("c4", "v")} c4,
{number("c5", "dsc")} c5, coalesce({moved}, dt) c6, nt c7 FROM src
UNION ALL SELECT 2, {head}"""


@query("mask_sheet", _masked_sheet_sql())
def mask_sheet_query(spark, d):
    """The purchase sheet with its ids, dates and amounts masked, banner and header kept."""
    return mask_sheet(purchase_sheet(spark, d), 2, SALT)


# --- addresses --------------------------------------------------------------------------

CITY = "Recife, Pernambuco, Brasil"
ADDRESS_CTE = """
ad AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN '  ' || lower(n_name) || ' '
         WHEN c_custkey % 3 = 1 THEN n_name ELSE upper(n_name) || ' ' END endereco
       FROM customer JOIN nation ON c_nationkey = n_nationkey),
pl AS (SELECT lower(n_name) endereco_norm, n_nationkey * 1.5::DOUBLE - 20 lat, 10 - n_nationkey * 2.25::DOUBLE lon, r_name
       FROM nation JOIN region ON n_regionkey = r_regionkey),
cache AS (SELECT * FROM pl WHERE r_name IN ('AFRICA', 'AMERICA', 'ASIA')),
gaz AS (SELECT * FROM pl WHERE r_name <> 'MIDDLE EAST'),
ak AS (SELECT *, lower(trim(coalesce(endereco, ''))) endereco_norm FROM ad),
ms AS (SELECT endereco_norm, min(endereco) || ', Recife, Pernambuco, Brasil' consulta FROM ak
       WHERE endereco_norm <> '' AND endereco_norm NOT IN (SELECT endereco_norm FROM cache) GROUP BY 1),
grown AS (SELECT endereco_norm, lat, lon FROM cache
          UNION ALL SELECT endereco_norm, lat, lon FROM ms JOIN gaz USING (endereco_norm))"""


def addresses(spark, d) -> DataFrame:
    key, name = F.col("c_custkey"), F.col("n_name")
    text = (
        F.when(key % 10 == 0, F.lit(None))
        .when(key % 3 == 0, F.concat(F.lit("  "), F.lower(name), F.lit(" ")))
        .when(key % 3 == 1, name)
        .otherwise(F.concat(F.upper(name), F.lit(" ")))
    )
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(nation, "c_nationkey").select("c_custkey", text.alias("endereco"))


def _places(spark, d) -> DataFrame:
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return table(spark, d, "nation").join(region, "n_regionkey").select(
        F.lower("n_name").alias("endereco_norm"),
        (F.col("n_nationkey") * F.lit(1.5) - 20).alias("lat"),
        (10 - F.col("n_nationkey") * F.lit(2.25)).alias("lon"),
        "r_name",
    )


def place_cache(spark, d) -> DataFrame:
    return _places(spark, d).filter(F.col("r_name").isin("AFRICA", "AMERICA", "ASIA")).drop("r_name")


def places_provider(spark, d):
    return gazetteer_provider(_places(spark, d).filter(F.col("r_name") != "MIDDLE EAST"))


def _grown_cache(spark, d) -> DataFrame:
    return updated_cache(addresses(spark, d), place_cache(spark, d), places_provider(spark, d))


@query("repaired_cache", """SELECT lower(n_name) endereco_norm, upper(n_name) || ' ' endereco, n_nationkey * 1.5::DOUBLE lat FROM nation""")
def repaired_cache_query(spark, d):
    """An old cache that holds addresses but no keys."""
    name = F.concat(F.upper("n_name"), F.lit(" ")).alias("endereco")
    old = table(spark, d, "nation").select(name, (F.col("n_nationkey") * F.lit(1.5)).alias("lat"))
    return repaired_cache(old, "endereco")


@query("address_misses", f"WITH {ADDRESS_CTE} SELECT * FROM ms")
def address_misses_query(spark, d):
    return address_misses(addresses(spark, d), place_cache(spark, d), city=CITY)


@query("address_cache", f"WITH {ADDRESS_CTE} SELECT * FROM grown")
def address_cache(spark, d):
    return _grown_cache(spark, d)


@query("address_enriched", f"""WITH {ADDRESS_CTE}
SELECT c_custkey, endereco, lat, lon FROM ak LEFT JOIN grown USING (endereco_norm)""")
def address_enriched(spark, d):
    return enrich_addresses(addresses(spark, d), _grown_cache(spark, d))
