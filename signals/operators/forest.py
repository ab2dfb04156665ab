"""A random forest over more rows than its samples can be kept for, grown on counted cells of binned features (M2)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signals.sources.scratch import write_once

# Bins of a feature, as many as MLlib has; its edges come from about so many rows (MLlib takes 10,000).
BINS = 32
BIN_SAMPLE = 100_000
# Cells a task, and trees grown beside each other (more need more of the driver's memory).
CELLS_PER_PART = 100_000
TREES_AT_ONCE = 2
_CELL, _ROWS, _WEIGHT = "_cell", "_rows", "_weight"


def bin_edges(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> list[float]:
    """Limits between the bins of a feature: midway between all its values where they are few, else between weighted quantiles."""
    value, where = np.unique(values, return_inverse=True)
    if len(value) == 1:
        return [float(value[0])]
    between = (value[:-1] + value[1:]) / 2
    if len(between) < bins:
        return between.tolist()
    share = np.cumsum(np.bincount(where, weights))
    at = np.searchsorted(share, share[-1] * np.arange(1, bins) / bins)
    return np.unique(between[np.minimum(at, len(between) - 1)]).tolist()


def fit_binner(rows: DataFrame, total: int, features: Sequence[str], label: str, weight: Column) -> Bucketizer:
    """The bins of all features, by rows drawn by their content; equal ones are counted, so few reach the driver however many there are."""
    every = max(1, total // BIN_SAMPLE)
    drawn = rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(every)) == 0) if every > 1 else rows
    counted = drawn.groupBy(*features, label).agg((F.count(F.lit(1)) * F.first(weight)).alias(_WEIGHT)).toArrow()
    found = [counted.column(c).to_numpy().astype(float) for c in (*features, _WEIGHT)]
    edges = [bin_edges(values, found[-1]) for values in found[:-1]]
    ends = float("inf")
    return Bucketizer(inputCols=list(features), outputCols=[f"_bin_{c}" for c in features], splitsArray=[[-ends, *e, ends] for e in edges])


def tree_counts(trees: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How often a cell's rows are in the sample of each tree, drawn from the cell's own hash, wherever the cell lies.

    A bootstrap takes every row a Poisson(1) number of times, so the n rows of a cell come a Poisson(n) number of times.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, rows = (batch.column(c).to_pylist() for c in (_CELL, _ROWS))
            times = np.empty((trees, len(rows)), np.int64)
            for i, (h, n) in enumerate(zip(cell, rows, strict=True)):
                times[:, i] = np.random.default_rng([h, seed]).poisson(n, trees)
            kept = batch.drop_columns([_CELL, _ROWS])
            names = [*kept.schema.names, *(f"_n{t}" for t in range(trees))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, times)], names)

    return draw


def counted_cells(rows: DataFrame, binner: Bucketizer, label: str, trees: int, seed: int) -> DataFrame:
    """One row per cell (a bin of every feature, and the label) with its count in each tree's sample, written once."""
    bins = binner.getOutputCols()
    binned = binner.transform(rows.select(*binner.getInputCols(), label))
    plain = binned.select(*(F.col(c).cast("int").alias(c) for c in bins), F.col(label).cast("int").alias(label))
    cells = write_once(plain.groupBy(*bins, label).agg(F.count(F.lit(1)).alias(_ROWS)))
    hashed = cells.withColumn(_CELL, F.shiftrightunsigned(F.xxhash64(*bins, label), 1))
    parts = max(1, -(-cells.count() // CELLS_PER_PART))
    schema = ", ".join([*(f"`{c}` int" for c in (*bins, label)), *(f"_n{t} bigint" for t in range(trees))])
    return write_once(hashed.repartition(parts, *bins, label).mapInArrow(tree_counts(trees, seed), schema)).coalesce(parts)


def fit_by_cells(
    rows: DataFrame, total: int, positive: int, features: Sequence[str], label: str, forest: RandomForestClassifier
) -> PipelineModel:
    """The forest that ``forest`` describes, over any number of rows.

    A tree sees its rows by their bins alone, so rows of the same bins and label are one cell, which is in a tree's sample as
    often as its rows together. Cells are bounded by the bins, not by the rows. MLlib grows each tree on the cells in its
    sample, weighted by count and class; the trees make one model, behind the stage that bins. Class-balanced weights are whole
    numbers here, so sums, and with them the trees, do not depend on the order of rows.
    """
    trees, seed, share = forest.getNumTrees(), forest.getSeed(), gcd(positive, total - positive)
    weight = F.when(F.col(label) == 1, float((total - positive) // share)).otherwise(float(positive // share))
    binner = fit_binner(rows, total, features, label, weight)
    cells = counted_cells(rows, binner, label, trees, seed)
    assembler = VectorAssembler(inputCols=binner.getOutputCols(), outputCol=forest.getFeaturesCol())
    kinds = {"ml_attr": {"type": "nominal", "name": label, "vals": ["0", "1"]}}

    def grow(t: int):
        own = cells.where(F.col(f"_n{t}") > 0)
        own = own.withColumn(forest.getWeightCol(), F.col(f"_n{t}") * weight).withColumn(label, F.col(label).alias(label, metadata=kinds))
        # Bins are few, so all limits between them are tried; with more bins allowed, MLlib draws fewer rows out to find them.
        alone = forest.copy({forest.numTrees: 1, forest.bootstrap: False, forest.seed: seed + t, forest.maxBins: BINS * BINS})
        return alone.fit(assembler.transform(own.select(*assembler.getInputCols(), label, forest.getWeightCol()))).trees[0]

    spark = rows.sparkSession
    with ThreadPoolExecutor(TREES_AT_ONCE) as pool:
        grown = list(pool.map(inheritable_thread_target(spark)(grow), range(trees)))
    classes = spark.sparkContext._jvm.org.apache.spark.ml.classification
    together = spark.sparkContext._gateway.new_array(classes.DecisionTreeClassificationModel, trees)
    for t, tree in enumerate(grown):
        together[t] = tree._java_obj
    model = RandomForestClassificationModel(classes.RandomForestClassificationModel(forest.uid, together, len(features), 2))
    forest._copyValues(model)._transfer_params_to_java()
    return PipelineModel([binner, assembler, model])
