"""Where a batch run reads and writes, and the sizes it uses (job parameters, no globals)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from signals.columns import PurchaseCols
from signals.operators.quality import ACCEPTED, REJECTED, SITUATION
from signals.sources.tables import path_exists, read_table, write_report, write_table


# Tables that are folders of another one: usable and rejected purchases are written in one pass.
PLACES = {
    "compras_clientes_clean": f"compras_clientes/{SITUATION}={ACCEPTED}",
    "compras_clientes_rejected": f"compras_clientes/{SITUATION}={REJECTED}",
}


@dataclass(frozen=True)
class Sizes:
    """Model and window sizes of a run; the defaults are the production values."""

    lookback_days: int = 90
    short_lookback_days: int = 30
    label_days: int = 30
    train_ratio: float = 0.8
    propensity_trees: int = 300
    propensity_depth: int = 8
    forest_trees: int = 500
    forest_depth: int = 12
    boost_rounds: int = 600
    boost_depth: int = 6
    forecast_days: int = 30
    interval_alpha: float = 0.1
    interval_step: int = 7
    fold_days: int = 30
    first_train_ratio: float = 0.6
    recent_days: int = 30
    campaign_size: int = 100
    leak_free: bool = False
    seed: int = 42
    parallel_fits: int = 4
    one_row_per_order: bool = False


@dataclass(frozen=True)
class Workspace:
    spark: SparkSession
    root: str
    cols: PurchaseCols = PurchaseCols()
    sizes: Sizes = Sizes()
    #: Customer columns that split the revenue into series; none makes one series.
    series: tuple[str, ...] = ()

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{PLACES.get(name, name)}"

    def has(self, name: str) -> bool:
        return path_exists(self.spark, self.path(name))

    def table(self, name: str) -> DataFrame:
        if not self.has(name):
            raise FileNotFoundError(self.path(name))
        return read_table(self.spark, self.path(name))

    def save(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        """Write a table and return a reader of it."""
        write_table(df, self.path(name), *partition_by)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def report(self, df: DataFrame, name: str, small: bool = True) -> None:
        write_report(df, self.path(name), single_file=small)
