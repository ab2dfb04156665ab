"""Exact top-k search by inner product with vector-approximation files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signals.sources.scratch import write_once

#: Bits of a cell per component, and vectors and queries compared in one task.
CELL_BITS, VECTORS, QUERIES = 6, 4096, 1024


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id, v`` with every component x as floor(scale * x); vectors that are null or hold null or
    non-finite components are left out, as are those with components so large that inner products of such vectors may not
    fit 64 bits (scale * |x| over the root of 2 ** 62 / length), and second rows of an equal id and vector."""
    number = lambda x: x.cast("double")
    most = F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size(F.col("v")), F.lit(1)))
    large = lambda x: F.abs(number(x)) * F.lit(float(scale)) + 1 > most
    bad = lambda x: number(x).isNull() | F.isnan(number(x)) | large(x)
    return (
        vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
        .where(F.col("v").isNotNull() & ~F.exists("v", bad))
        .select("vec_id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * number(x)).cast("bigint")).alias("v"))
        .distinct()
    )


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(-1, width)


def top_inner_products(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest inner products with all rows but its own id.

    ``is_query`` is a condition on ``vec_id``. Scores are inner products of the integer vectors, ties go to the
    smaller id, fewer candidates give fewer rows. Only vectors of one length are compared. Vectors that are null or hold
    null, non-finite or very large components (``integer_vectors``) take no part, nor does a null id; repeated rows of an equal
    id and vector count once. Different vectors of one id are candidates each, and as queries each has a list of its own under
    that id. An empty table gives no rows; further columns are ignored.

    Equal vectors are one class with its k + 1 smallest ids, which is all that any answer can use. The
    approximation file holds a cell number per component. Blocks of queries meet blocks of cells: cells bound
    each score from both sides, and a vector stays if its upper bound reaches the k-th best lower bound of all blocks. Exact
    vectors are then read in the order of their bounds: first a few for each query, then only those whose bound
    reaches the k-th exact score found, after which the result is certain.
    """
    rows = write_once(integer_vectors(vectors.where(F.col(id_col).isNotNull()), id_col, vector_col, scale))
    by_id = Window.partitionBy("v").orderBy("vec_id")
    classes = write_once(
        rows.withColumn("nth", F.row_number().over(by_id))
        .where(F.col("nth") <= k + 1)
        .groupBy("v")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        .select(F.monotonically_increasing_id().alias("cid"), F.size("v").alias("width"), "v", "ids")
    )
    asked = write_once(
        rows.where(is_query).join(classes.select("v", "cid", "width"), "v").select(F.col("vec_id").alias("query_id"), "cid", "width")
    )
    queries = write_once(asked.select("cid").distinct().join(classes.select("cid", "width", "v"), "cid"))

    # One row per length and component, whatever the number of vectors.
    spans = (
        classes.select("width", F.posexplode("v").alias("at", "x"))
        .groupBy("width", "at")
        .agg(F.min("x").alias("low"), F.max("x").alias("high"))
        .orderBy("width", "at")
        .toPandas()
    )
    grid = {}
    for width, part in spans.groupby("width"):
        low = part["low"].to_numpy(np.int64)
        grid[int(width)] = (low, np.maximum(1, -(-(part["high"].to_numpy(np.int64) - low + 1) // (1 << CELL_BITS))))

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for width, v in zip(batch.column("width").to_pylist(), batch.column("v"), strict=True):
                low, step = grid.get(width, (np.zeros(0, np.int64), np.ones(0, np.int64)))
                cells.append(((v.values.to_numpy() - low) // step).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), batch.column("width"), pa.array(cells, pa.binary())], names=["cid", "width", "cells"]
            )

    approximations = write_once(classes.select("cid", "width", "v").mapInArrow(quantise, "cid bigint, width int, cells binary"))
    n_vectors = -(-approximations.count() // VECTORS) or 1
    n_queries = -(-queries.count() // QUERIES) or 1
    part = lambda n: F.pmod(F.xxhash64("cid"), F.lit(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = approximations.withColumn("vb", part(n_vectors)).withColumn("qb", others(n_queries))
    right = queries.withColumn("qb", part(n_queries)).withColumn("vb", others(n_vectors))

    def bounds(near: pa.Table, wanted: pa.Table) -> pa.Table:
        empty = pa.table({"query": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()), "upper": pa.array([], pa.float64()), "floor": pa.array([], pa.float64())})
        if not near.num_rows or not wanted.num_rows:
            return empty
        width = wanted["width"][0].as_py()
        low, step = grid.get(width, (np.zeros(0, np.int64), np.ones(0, np.int64)))
        cells = np.frombuffer(b"".join(near["cells"].to_pylist()), np.uint8).reshape(near.num_rows, width).astype(np.float64)
        q = _matrix(wanted["v"], width).astype(np.float64) if width else np.zeros((wanted.num_rows, 0))
        base = (q * step) @ cells.T + (q @ low.astype(np.float64))[:, None]
        # What rounding can add up to in doubles, so that bounds hold for integers of any size.
        slack = (np.abs(q) * (np.abs(low.astype(np.float64)) + step * float(1 << CELL_BITS))).sum(axis=1) * 2.0**-46
        above = (np.maximum(q, 0) * (step - 1)).sum(axis=1) + slack
        below = (np.minimum(q, 0) * (step - 1)).sum(axis=1) - slack
        # Besides its own class a query needs k vectors.
        kth = min(k + 1, base.shape[1])
        least = np.partition(base, base.shape[1] - kth, axis=1)[:, base.shape[1] - kth] + below if base.shape[1] >= k + 1 else np.full(len(q), -np.inf)
        at_q, at_v = np.nonzero(base + above[:, None] >= least[:, None])
        return pa.table(
            {
                "query": pa.array(np.asarray(wanted["cid"])[at_q]),
                "cid": pa.array(np.asarray(near["cid"])[at_v]),
                "upper": pa.array(base[at_q, at_v] + above[at_q]),
                "floor": pa.array(least[at_q]),
            }
        )

    scanned = write_once(
        left.groupBy("width", "qb", "vb")
        .cogroup(right.groupBy("width", "qb", "vb"))
        .applyInArrow(bounds, "query bigint, cid bigint, upper double, floor double")
    )
    best_floor = scanned.groupBy("query").agg(F.max("floor").alias("best"))
    in_order = Window.partitionBy("query").orderBy(F.desc("upper"), "cid")
    survivors = write_once(
        scanned.join(best_floor, "query")
        .where(F.col("upper") >= F.col("best"))
        .select("query", "cid", "upper", F.row_number().over(in_order).alias("place"))
    )
    stored = classes.select("cid", "v", "ids")
    wanted = queries.select(F.col("cid").alias("query"), F.col("v").alias("q"))

    def read_exact(pairs: DataFrame) -> DataFrame:
        score = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda a, x: a + x)
        return pairs.join(stored, "cid").join(wanted, "query").select("query", "ids", score.alias("score"))

    first = write_once(read_exact(survivors.where(F.col("place") <= 2 * (k + 1))))
    nth = Window.partitionBy("query").orderBy(F.desc("score"))
    known = (
        first.withColumn("nth", F.row_number().over(nth))
        .where(F.col("nth") == k + 1)
        .select("query", F.col("score").alias("certain"))
    )
    later = survivors.where(F.col("place") > 2 * (k + 1)).join(known, "query").where(F.col("upper") >= F.col("certain"))
    exact = first.unionByName(read_exact(later.select("query", "cid")))
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    answers = (
        exact.select("query", "score", F.explode("ids").alias("vec_id"))
        .withColumn("nth", F.row_number().over(ranked))
        .where(F.col("nth") <= k + 1)
        .groupBy("query")
        .agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("found"))
    )
    mine = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (
        asked.join(answers, F.col("cid") == F.col("query"))
        .select("query_id", F.posexplode(mine).alias("at", "x"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
    )
