"""Column-name parameters shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PurchaseCols:
    """Names of the four purchase columns every customer operator needs."""

    customer: str = "id_cliente"
    order: str = "id_pedido"
    time: str = "data_compra"
    value: str = "valor_total"


@dataclass(frozen=True)
class FactoryCols:
    """Names of the factory (supply) order columns."""

    order: str = "id_pedido"
    time: str = "data_pedido"
    value: str = "valor_pedido"


@dataclass(frozen=True)
class CustomerCols:
    customer: str = "id_cliente"
    name: str = "nome_cliente"
    registered: str = "data_cadastro"


# Fixed output names of the customer features, in model input order.
PROPENSITY_FEATURES = (
    "recency",
    "frequency_lookback",
    "monetary_lookback",
    "ticket_medio_lookback",
    "tendencia_gasto_lookback",
)
SNAPSHOT = "snapshot_date"
TARGET = "target_recompra_30d"
SCORE = "score_recompra_30d"

# Fixed output names of the daily indicators.
DAY = "data"
REVENUE = "faturamento_total"
DAILY_DRIVERS = ("numero_pedidos", "clientes_unicos", "valor_pedido_fabrica", "ticket_medio")
