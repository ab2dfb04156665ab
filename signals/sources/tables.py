"""Parquet and CSV readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when a file or folder exists on the file system the path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, optional: bool = False) -> DataFrame:
    """Scan a parquet table; a missing optional table is an empty DataFrame."""
    if optional and not path_exists(spark, path):
        if schema is None:
            raise ValueError("an optional table needs a schema")
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_report(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Scan a CSV report with a header row and a known schema."""
    return spark.read.schema(schema).csv(path, header=True)


def write_table(df: DataFrame, path: str, *partition_by: str, dealt: bool = False) -> None:
    """Write a parquet table, replacing what was there.

    Partitioned tables are rebalanced first: few files per partition value, and a value
    with a large share of the rows is split over several tasks and files. ``dealt`` rows already lie so that a task
    holds few partition values, and are written where they lie.
    """
    if dealt:
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    elif partition_by:
        df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Write a CSV report with a header row.

    ``single_file`` is for reports whose row count is fixed by their definition
    (a top-k list, one row per model or feature); anything else stays partitioned.
    """
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)
