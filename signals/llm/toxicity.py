"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signals.llm.batches import bound_batches
from signals.sources.scratch import write_once

#: Orders of the n-grams, and the bits of the table they are hashed into.
ORDERS = (3, 5, 7)
BITS = 20
#: Bits of the hash by which labelled documents are chosen.
SLICE_BITS = 16
#: Characters of a text hashed at once, so that a text of any length needs bounded memory.
BLOCK = 1 << 20


def gram_blocks(text: str) -> Iterator[np.ndarray]:
    """Hashed character n-grams of a lower-cased text, repeats included, in blocks; blanks count as one kind."""
    low = text.lower()
    for at in range(0, len(low), BLOCK):
        part = low[at : at + BLOCK + max(ORDERS) - 1]
        a = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        a = np.maximum(a, np.uint32(32))
        grams: dict[int, np.ndarray] = {1: a * np.uint32(0x9E3779B1)}
        for n, left, right in ((2, 1, 1), (3, 2, 1), (5, 3, 2), (7, 5, 2)):
            if len(a) < n:
                break
            size = len(a) - n + 1
            grams[n] = (grams[left][:size] * np.uint32(0x01000193)) ^ (grams[right][left : left + size] * np.uint32(0x85EBCA6B))
        for n in ORDERS:
            if n in grams:
                g = grams[n] ^ (grams[n] >> np.uint32(15))
                g = g * np.uint32(0x2C1B3C6D) + np.uint32((n * 0x9E3779B1) & 0xFFFFFFFF)
                yield (g ^ (g >> np.uint32(13))) >> np.uint32(32 - BITS)


@dataclass(frozen=True)
class ToxicityModel:
    """``weights`` of the hashed n-grams ``grams`` (log-count ratio times learned weight) and the ``bias``."""

    grams: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: str, place: np.ndarray) -> float:
        hit = [p[p >= 0] for p in (place[g] for g in gram_blocks(text))]
        seen = np.unique(np.concatenate(hit)) if hit else np.zeros(0, dtype=np.int32)
        return float(1 / (1 + np.exp(-np.clip(self.weights[seen].sum() + self.bias, -500, 500))))


def _present(text: str) -> np.ndarray:
    """The different n-grams of a text."""
    blocks = [np.unique(g) for g in gram_blocks(text)]
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, dtype=np.uint32)


def _places(grams: np.ndarray) -> np.ndarray:
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[grams] = np.arange(len(grams), dtype=np.int32)
    return place


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """``text, label`` of at most ``max_rows`` labelled documents, those of the smallest hashed ids.

    The cut is at a whole slice of the hash, of 65,536, so up to one slice fewer are taken.
    Null labels teach nothing; of several labels or texts of an id the largest label and text count.
    """
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    one = write_once(named.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col)).cast("int").alias("label")))
    # The smallest hashes are found by counts per slice of the hash, so no task gathers candidates of all others.
    slices = one.groupBy(F.shiftrightunsigned(F.xxhash64("_id"), 64 - SLICE_BITS).alias("slice")).count().orderBy("slice")
    through = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    fits = slices.withColumn("through", F.sum("count").over(through)).where(F.col("through") <= max_rows)
    last = fits.agg(F.max("slice")).first()[0]
    chosen = one.where(F.shiftrightunsigned(F.xxhash64("_id"), 64 - SLICE_BITS) <= F.lit(-1 if last is None else last))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "_id").groupBy("_id", "label").agg(F.max("text").alias("text"))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 20_000,
    max_features: int = 1_024,
    min_rows: int = 5,
    decay: float = 1e-3,
    steps: int = 300,
    balance: float = 0.5,
) -> ToxicityModel:
    """Learn from the labelled rows given.

    Whole texts are used. Presence of each n-gram is counted by class, its ratio is log((p + 1) / (P + 2)) -
    log((q + 1) / (Q + 2)), and the ``max_features`` n-grams of the largest ratio times root of rows are kept, among
    those in ``min_rows`` rows. A logistic regression learns weights for the ratios; rows count by the share of
    the other class to the power ``balance``, as toxic rows are few. ``max_rows`` bounds the sample and with ``max_features``
    what reaches the driver; more features find less, as rare n-grams fit the sample and not its kind (figures in README). Without
    rows of both classes the model is a constant, the share of toxic rows, a half of one without any. Null texts count as
    empty, labels of unknown ids teach nothing, repeated rows of an id count once.
    """
    bound_batches(docs.sparkSession)
    rows = training_rows(docs, labels, id_col, text_col, label_col, max_rows)
    sample = write_once(rows.select("label", "text"))
    n, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    clean = n - toxic
    if not toxic or not clean:
        share = (toxic + 0.25) / (n + 1) if n else 0.25
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(0, np.float32), float(np.log(share / (1 - share))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), dtype=np.int32)
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text"), strict=True):
                grams = _present(text.as_py())
                seen[0, grams] += label
                seen[1, grams] += 1
        grams = np.flatnonzero(seen[1])
        for at in range(0, len(grams), 1 << 16):
            part = grams[at : at + (1 << 16)]
            made = [pa.array(part.astype(np.int32)), pa.array(seen[0, part]), pa.array(seen[1, part])]
            yield pa.RecordBatch.from_arrays(made, names=["gram", "p", "rows"])

    ratio = F.log((F.col("p") + 1) / F.lit(toxic + 2.0)) - F.log((F.col("rows") - F.col("p") + 1) / F.lit(clean + 2.0))
    kept = (
        sample.mapInArrow(count, "gram int, p int, rows int")
        .groupBy("gram")
        .agg(F.sum("p").alias("p"), F.sum("rows").alias("rows"))
        .where(F.col("rows") >= min_rows)
        .select("gram", ratio.alias("ratio"), (F.abs(ratio) * F.sqrt("rows")).alias("rank"))
        .orderBy(F.desc("rank"), "gram")
        .limit(max_features)
        .toPandas()
    )
    names, ratios = kept["gram"].to_numpy(np.int32), kept["ratio"].to_numpy(np.float64)
    place = _places(names)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [p[p >= 0] for p in (place[_present(t.as_py())] for t in batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(held, pa.list_(pa.int32()))], names=["label", "grams"]
            )

    data = sample.mapInArrow(narrow, "label int, grams array<int>").toArrow()
    lists = data["grams"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    of_row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
    column = np.asarray(lists.flatten())
    y = data["label"].to_numpy().astype(float)
    counted = np.where(y > 0, n / (2 * toxic), n / (2 * clean)) ** balance
    weights, bias = _logistic(of_row, column, ratios, y, counted, decay, steps)
    return ToxicityModel(names, (weights * ratios).astype(np.float32), bias)


def _logistic(
    of_row: np.ndarray, column: np.ndarray, ratios: np.ndarray, y: np.ndarray, counted: np.ndarray, decay: float, steps: int
) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on counted rows with squared penalty, by Adam over all rows at once."""
    n, k = len(y), len(ratios)
    order = np.lexsort((column, of_row))
    of_row, column = of_row[order], column[order]
    value = ratios[column]
    w, first, second = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        z = np.bincount(of_row, value * w[column], n) + w[k]
        error = counted * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / counted.sum()
        slope = np.append(np.bincount(column, value * error[of_row], k) + decay * w[:k], error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        w -= 0.02 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return w[:k], float(w[k])


def score_toxicity(
    docs: DataFrame,
    model: ToxicityModel,
    text_col: str = "text",
    name: str = "score",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Adds the model's probability that a text is toxic; null and empty texts get that of the bias alone.

    Texts are scored whole, each by itself, in Arrow batches without a shuffle. An existing column of that
    name is replaced. ``keep`` names the columns to return besides, by default all.
    """
    bound_batches(docs.sparkSession)
    names = [c for c in (docs.columns if keep is None else keep) if c != name]
    read = docs.select(*names, F.col(text_col).cast("string").alias("_scored"))
    schema = docs.select(*names).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _places(model.grams)
        for batch in batches:
            scores = [model.score(t.as_py() or "", place) for t in batch.column(len(names))]
            made = [*batch.columns[: len(names)], pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(made, names=[*names, name])

    return read.mapInArrow(run, schema)


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether the CRC-32 of an id's decimal form falls into the fold that is never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == 0, F.lit(False))
