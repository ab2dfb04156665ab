"""Command line of the weekly batch.

    python -m signals all --purchases P --customers C --factory-orders F --out OUT
    python -m signals forecast-predict --out OUT
    python -m signals mask --customers C --out OUT --salt S --row-key "Cod. Cliente" --hide-unknown-text

Inputs are parquet tables of text columns, or exported CSV sheets (a ``.csv`` file or a pattern of them). Sheets are masked by the
header of each file, banner and layout kept.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from signals.operators.masking import mask_rows
from signals.plans import forecast_step, propensity_step
from signals.plans.data_step import run_data_step
from signals.plans.monitoring_step import run_monitoring_step
from signals.plans.weekly import run_weekly
from signals.plans.workspace import Sizes, Workspace
from signals.sources.scratch import drop_scratch, scratch_run
from signals.sources.sheets import files_of, ingest_sheets, mask_sheet_files
from signals.sources.tables import path_exists

INPUTS = ("purchases", "customers", "factory_orders")
STEPS = {
    "propensity": propensity_step.run_propensity_step,
    "propensity-train": propensity_step.train,
    "propensity-score": propensity_step.score,
    "propensity-evaluate": propensity_step.evaluate,
    "forecast": forecast_step.run_forecast_step,
    "forecast-train": forecast_step.train,
    "forecast-backtest": forecast_step.backtest,
    "forecast-select": forecast_step.select,
    "forecast-predict": forecast_step.predict,
    "forecast-quick": forecast_step.train_and_predict,
    "monitoring": run_monitoring_step,
}


def read_input(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".csv"):
        return ingest_sheets(spark, path)
    return spark.read.parquet(path)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="signals")
    parser.add_argument("step", choices=["all", "data", "mask", *STEPS])
    parser.add_argument("--out", required=True)
    parser.add_argument("--salt")
    parser.add_argument("--row-key", nargs="+", help="columns that tell rows apart; by default a digest of the row")
    parser.add_argument("--hide-unknown-text", action="store_true")
    for name in INPUTS:
        parser.add_argument("--" + name.replace("_", "-"))
    for name, value in vars(Sizes()).items():
        if not isinstance(value, bool):
            parser.add_argument("--" + name.replace("_", "-"), type=type(value), default=value)
    parser.add_argument("--series", nargs="+", default=(), help="customer columns that split the revenue into series")
    parser.add_argument("--leak-free", action="store_true")
    parser.add_argument("--one-row-per-order", action="store_true")
    args = vars(parser.parse_args(argv))

    spark = SparkSession.builder.appName("signals").getOrCreate()
    ws = Workspace(spark, args["out"], sizes=Sizes(**{k: args[k] for k in vars(Sizes())}), series=tuple(args["series"]))
    if args["step"] in STEPS:
        with scratch_run() as run:
            try:
                STEPS[args["step"]](ws)
            finally:
                drop_scratch(spark, run)
        return
    if args["step"] == "mask":
        if not args["salt"]:
            parser.error("step mask needs --salt")
        # One wide projection: compiled in parts it stays within what the JVM optimises.
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
        for name in INPUTS:
            path = args[name]
            if path and (files_of(spark, path) if path.endswith(".csv") else path_exists(spark, path)):
                if path.endswith(".csv"):
                    mask_sheet_files(spark, path, ws.path(name), args["salt"])
                    continue
                raw = read_input(spark, path)
                masked = mask_rows(raw, args["salt"], args["row_key"] or (), args["hide_unknown_text"])
                masked.write.mode("overwrite").parquet(ws.path(name))
        return
    missing = [n for n in INPUTS if not args[n]]
    if missing:
        parser.error(f"step {args['step']} needs {missing}")
    tables = [read_input(spark, args[n]) for n in INPUTS]
    if args["step"] == "data":
        run_data_step(ws, *tables)
    else:
        run_weekly(ws, *tables)


if __name__ == "__main__":
    main()
