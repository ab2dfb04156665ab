"""Cleaning of the three raw tables.

Each step is a projection of column expressions plus a filter, so a whole clean is one
narrow stage over the scan. The ``parse_*`` forms keep rejected rows (for the quality
checks); the ``clean_*`` forms drop them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signals.functions.text import is_blank, parse_count, parse_day_first, parse_money_or_zero, strip
from signals.operators.tables import normalise_names, rename_present

# Raw header names (after the header rule) and their names in the clean tables.
PURCHASE_NAMES = {"cod_cliente": "id_cliente", "op": "id_pedido", "data": "data_compra"}
CUSTOMER_NAMES = {
    "codigo": "id_cliente",
    "nome": "nome_cliente",
    "cod_master": "id_master",
    "nome_master": "nome_master",
    "dt_cadastro": "data_cadastro",
    "dt_ultima_compra": "data_ultima_compra",
    "qtde_itens": "qtde_itens",
    "qtde_equipe": "qtde_equipe",
    "qtde_pontos_total": "qtde_pontos_total",
    "qtde_pontos_no_mes": "qtde_pontos_mes",
    "qtde_ativacoes_no_mes": "qtde_ativacoes_mes",
}
FACTORY_NAMES = {"pedido": "id_pedido", "nome_consultor": "nome_cliente", "valor": "valor_pedido"}


def _moment(df: DataFrame, name: str) -> Column:
    """Typed dates pass through; text is parsed day first."""
    if dict(df.dtypes)[name] == "string":
        return parse_day_first(F.col(name))
    return F.col(name).cast("timestamp_ntz")


def _apply(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    return df.withColumns({name: c for name, c in changes.items() if name in df.columns})


def parse_purchases(raw: DataFrame) -> DataFrame:
    """P3 without the row filter: names, types and trimmed ids."""
    df = rename_present(normalise_names(raw), PURCHASE_NAMES)
    changes = {"id_cliente": strip(F.col("id_cliente")), "id_pedido": strip(F.col("id_pedido"))}
    if "data_compra" in df.columns:
        changes["data_compra"] = _moment(df, "data_compra")
    changes["qtde_itens"] = parse_count(F.col("qtde_itens"))
    changes["valor_total"] = parse_money_or_zero(F.col("valor_total"))
    changes["valor_desconto"] = parse_money_or_zero(F.col("valor_desconto"))
    return _apply(df, changes)


def is_usable(ids: tuple[str, ...], required: tuple[str, ...] = ()) -> Column:
    """P6, P7 as a condition: ids that are there and not blank, and required values that are there."""
    keep = F.lit(True)
    for name in ids:
        keep = keep & ~is_blank(F.col(name))
    for name in required:
        keep = keep & F.col(name).isNotNull()
    return keep


def drop_unusable(df: DataFrame, ids: tuple[str, ...], required: tuple[str, ...] = ()) -> DataFrame:
    """Drop rows with a missing or blank id, or a missing required value.

    The rows pass through a generator, below which the optimiser pushes no filter: a plain filter on parsed
    columns would be pushed under their projection and parse every value a second time.
    """
    keep = is_usable(ids, required)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.inline(F.when(keep, F.array(row))))


def clean_purchases(raw: DataFrame) -> DataFrame:
    """Purchases with a customer, an order and a date."""
    return drop_unusable(parse_purchases(raw), ("id_cliente", "id_pedido"), ("data_compra",))


def clean_customers(raw: DataFrame) -> DataFrame:
    """Customers; counters stay text as delivered."""
    df = rename_present(normalise_names(raw), CUSTOMER_NAMES)
    changes = {"id_cliente": strip(F.col("id_cliente"))}
    for name in ("data_cadastro", "data_ultima_compra"):
        if name in df.columns:
            changes[name] = _moment(df, name)
    return _apply(df, changes)


def clean_factory_orders(raw: DataFrame) -> DataFrame:
    """P5: factory orders."""
    df = rename_present(normalise_names(raw), FACTORY_NAMES)
    changes = {"valor_pedido": parse_money_or_zero(F.col("valor_pedido"))}
    if "data_pedido" in df.columns:
        changes["data_pedido"] = _moment(df, "data_pedido")
    return _apply(df, changes)
