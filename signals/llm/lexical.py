"""Ranked lexical search: summed accumulators of short lists beside document-at-a-time skipping over long ones."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signals.llm.batches import bound_batches
from signals.sources.scratch import write_once

#: Runs of letters, digits and all characters beyond ASCII, on the bytes of a text.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Terms of items, repeats included, that are sought in one reading of the documents.
BLOCK_TERMS = 200_000
#: Postings held at once by a task that ranks, and documents it takes at a time.
SEGMENT, STEP = 2_000_000, 2_048
#: A list is long if it names more than this share of the documents at hand.
LONG = 1 / 16


@dataclass
class Item:
    """A query as the terms it has in a block: term numbers and the weight each occurrence sum counts for."""

    terms: np.ndarray
    weights: np.ndarray


def terms_of(data: bytes) -> list[bytes]:
    return TERM.findall(data.lower())


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, term, repeats`` over all rows of an item id."""
    read = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("_text"))
    kind = read.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for n, text in enumerate(batch.column("_text").cast(pa.binary()).to_pylist()):
                terms = terms_of(text or b"")
                rows += [n] * len(terms)
                found += terms
            ids = batch.column("item").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.binary())], names=["item", "term"])

    each = read.mapInArrow(run, f"item {kind}, term binary")
    return write_once(each.groupBy("item", "term").agg(F.count(F.lit(1)).alias("repeats")))


def _blocks(asked: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The items dealt into blocks of at most ``most`` terms each, unless one item alone has more."""
    sizes = write_once(asked.groupBy("item").agg(F.count(F.lit(1)).alias("n")))
    items, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, math.ceil(total / most))
    while True:
        place = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
        held = sizes.groupBy(place.alias("block")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("items"))
        if blocks >= 16 * max(items, 1) or held.where((F.col("n") > most) & (F.col("items") > 1)).isEmpty():
            return asked.withColumn("block", place), blocks
        blocks *= 2


def postings_of(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, counts``: all terms of a document counted, and its postings of the vocabulary's terms."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column("_text").cast(pa.binary()).to_pylist():
                found = terms_of(text or b"")
                sizes.append(len(found))
                held = Counter(filter(vocabulary.__contains__, found))
                terms.append([vocabulary[t] for t in held])
                counts.append(list(held.values()))
            made = [pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, counts array<bigint>")


class Segment:
    """Postings of some documents by term, each list in document order with what an occurrence adds to a score."""

    def __init__(self, sizes: np.ndarray, of_doc: np.ndarray, terms: np.ndarray, counts: np.ndarray, n_docs: int, n_terms: int, vocabulary: int):
        m = 25 + (75 * sizes * n_docs) // max(n_terms, 1)
        order = np.argsort(terms, kind="stable")
        self.docs = of_doc[order]
        self.gain = (1_000_000_000 * counts[order]) // (1000 * counts[order] + 8 * m[self.docs])
        self.ends = np.cumsum(np.bincount(terms, minlength=vocabulary))
        self.size = len(sizes)

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        begin = self.ends[term - 1] if term else 0
        return self.docs[begin : self.ends[term]], self.gain[begin : self.ends[term]]


def best_of(segment: Segment, item: Item, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (ascending) and scores among which are the k best of a segment, none below ``floor``.

    Short lists are summed term at a time into accumulators. These then count as one iterator whose bound is the largest
    sum, next to the long lists with a bound each. Documents are taken in steps of ascending number from the iterators
    that alone could still reach the k-th score; the others are only probed for documents whose score so far and the
    bounds left can reach it, so most of a long list is never read.
    """
    sums = np.zeros(segment.size, dtype=np.int64)
    lists = []
    for term, weight in zip(item.terms.tolist(), item.weights.tolist(), strict=True):
        docs, gain = segment.list_of(term)
        if not len(docs) or not weight:
            continue
        if len(docs) <= LONG * segment.size:
            sums[docs] += weight * gain
        else:
            lists.append((int(gain.max()) * weight, docs, gain, weight))
    held = np.flatnonzero(sums)
    values = sums[held]
    if not len(held) and not lists:
        return held, values
    threshold = max(floor, 1)
    if len(held) >= k:
        threshold = max(threshold, int(np.partition(values, len(values) - k)[len(values) - k]))
    lists.sort(key=lambda x: x[0])
    bounds = np.array([x[0] for x in lists], dtype=np.int64)
    below = np.concatenate([[0], np.cumsum(bounds)])
    top = int(values.max()) if len(held) else 0
    best_docs, best_scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    for begin in range(0, segment.size, STEP):
        end = begin + STEP
        # Lists before the first essential one cannot reach the threshold together, nor with the accumulators if those rest.
        first = int(np.searchsorted(below, threshold, side="left")) - 1
        a, b = np.searchsorted(held, (begin, end))
        rest = int(below[first])
        if first == len(lists) and rest + top < threshold:
            break  # no document of this segment can reach the threshold any more
        sources = [docs[slice(*np.searchsorted(docs, (begin, end)))] for _, docs, _, _ in lists[first:]]
        if rest + top >= threshold:
            near = values[a:b] + (below[-1] if first < len(lists) else rest) >= threshold
            sources.append(held[a:b][near])
        found = np.unique(np.concatenate(sources)) if len(sources) > 1 else sources[0]
        if not len(found):
            continue
        scores = sums[found]
        for at in range(len(lists) - 1, -1, -1):
            can = scores + below[at + 1] >= threshold
            if not can.all():
                found, scores = found[can], scores[can]
            if not len(found):
                break
            _, docs, gain, weight = lists[at]
            places = np.searchsorted(docs, found)
            places[places == len(docs)] = 0
            hit = docs[places] == found
            scores = scores + np.where(hit, weight * gain[places], 0)
        good = scores >= threshold
        if not good.any():
            continue
        best_docs = np.concatenate([best_docs, found[good]])
        best_scores = np.concatenate([best_scores, scores[good]])
        if len(best_docs) > k:
            order = np.lexsort((best_docs, -best_scores))[:k]
            best_docs, best_scores = best_docs[order], best_scores[order]
        if len(best_docs) == k:
            threshold = max(threshold, int(best_scores.min()))
    return best_docs, best_scores


def _best_rows(postings: DataFrame, items: list[Item], n_docs: int, n_terms: int, vocabulary: int, k: int) -> DataFrame:
    """``item`` (number in the block), ``doc_id, score``: of each segment the rows that can be among the k best."""
    kind = postings.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = np.zeros((len(items), k), dtype=np.int64)
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            waiting.append(batch)
            held += len(batch.column("terms").values)
            if held >= SEGMENT:
                yield ranked(waiting, reached)
                waiting, held = [], 0
        if waiting:
            yield ranked(waiting, reached)

    def ranked(waiting: list[pa.RecordBatch], reached: np.ndarray) -> pa.RecordBatch:
        table = pa.Table.from_batches(waiting).combine_chunks()
        table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending")]))
        lists = pa.concat_arrays(table.column("terms").chunks)
        counts = pc.list_flatten(pa.concat_arrays(table.column("counts").chunks)).to_numpy()
        sizes = table.column("n").to_numpy()
        of_doc = pc.list_parent_indices(lists).to_numpy()
        segment = Segment(sizes, of_doc, pc.list_flatten(lists).to_numpy(), counts, n_docs, n_terms, vocabulary)
        numbers, docs, scores = [], [], []
        for n, item in enumerate(items):
            found, values = best_of(segment, item, k, int(reached[n].min()))
            if len(found):
                reached[n] = np.sort(np.concatenate([reached[n], values]))[-k:]
                numbers.append(np.full(len(found), n, dtype=np.int32))
                docs.append(found)
                scores.append(values)
        join = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, dtype=t)
        ids = pa.concat_arrays(table.column("doc_id").chunks).take(pa.array(join(docs, np.int64)))
        made = [pa.array(join(numbers, np.int32)), ids, pa.array(join(scores, np.int64))]
        return pa.RecordBatch.from_arrays(made, names=["item", "doc_id", "score"])

    return postings.select("doc_id", "n", "terms", "counts").mapInArrow(run, f"item int, doc_id {kind}, score bigint")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The k best documents of every item: ``item_id, rank, doc_id, score``, scores above zero only.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. With N documents that have
    terms, L terms in all, df documents with a term, and n terms in one document, tf of them the term, a term adds
    ``w * ((1000000000 * tf) div (1000 * tf + 8 * m))`` for each time the item names it, where w is
    ``floor(1000 * ln((2N + 2) / (2df + 1)))`` and m is ``25 + (75 * n * N) div L``. Equal scores are ordered by id, null last.

    Items are read in blocks of at most ``block_terms`` terms, which bounds what a task holds of them; every block reads
    all documents once, writes their postings of the block's terms, and ranks them where they lie, segment by
    segment of about ``SEGMENT`` postings. Only k rows an item and segment are shuffled. A document of any length is one row of
    postings. Null and empty texts have no terms. Rows of one item id are one item, its terms added up; items that find
    nothing give no rows. Repeated documents are documents of their own; empty tables give no rows; further
    columns are ignored.
    """
    bound_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    asked, blocks = _blocks(_item_terms(items, item_id_col, item_text_col), block_terms)
    results = []
    for block in range(blocks):
        own = asked.where(F.col("block") == block)
        vocabulary = {bytes(r[0]): n for n, r in enumerate(own.select("term").distinct().orderBy("term").collect())}
        if not vocabulary:
            continue
        postings = write_once(postings_of(read, vocabulary))
        totals = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        n_docs, n_terms = int(totals[0]), int(totals[1])
        df = dict(postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        rarity = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(n, 0) + 1))) for n in range(len(vocabulary))]
        rows = own.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "repeats"))).alias("terms")).collect()
        ids, made = [], []
        for row in rows:
            ids.append(row["item"])
            terms = np.array([vocabulary[bytes(t)] for t, _ in row["terms"]], dtype=np.int64)
            made.append(Item(terms, np.array([c * rarity[n] for (_, c), n in zip(row["terms"], terms.tolist(), strict=True)], dtype=np.int64)))
        found = _best_rows(postings, made, n_docs, n_terms, len(vocabulary), k)
        kind = asked.schema["item"].dataType.simpleString()
        numbered = docs.sparkSession.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind}")
        results.append(found.join(F.broadcast(numbered), "item").select("item_id", "doc_id", "score"))
    if not results:
        id_kind, doc_kind = (d.simpleString() for d in (asked.schema["item"].dataType, read.schema["doc_id"].dataType))
        return docs.sparkSession.createDataFrame([], f"item_id {id_kind}, rank int, doc_id {doc_kind}, score bigint")
    every = results[0]
    for more in results[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
