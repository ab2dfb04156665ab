"""SimHash fingerprints and their near neighbours by pivot distance tables."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signals.llm.batches import bound_batches
from signals.llm.components import connected_components
from signals.sources.scratch import write_once

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text worked on at once, so that a text of any length needs bounded memory.
BLOCK = 1 << 20
#: Reference fingerprints of the pivot table.
PIVOTS = 16
#: Fingerprints of one bucket compared in one task; larger buckets are dealt into pairs of chunks.
CHUNK = 4096


def shingle_hashes(data: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of all word shingles of a lower-cased text, repeats included, in blocks.

    A text of fewer words is one shingle of all its words; a text without words has none.
    """
    digest = xxhash.xxh64_intdigest
    carry: list[bytes] = []
    at, some = 0, False
    while at < len(data):
        end = at + BLOCK
        if end < len(data):
            gap = SPACE.search(data, end)
            end = gap.start() if gap else len(data)
        found = carry + WORDS.findall(data[at:end].lower())
        at = end
        if len(found) < words:
            carry = found
            continue
        joined = b" ".join(found)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        stops = np.cumsum(sizes + 1) - 1
        starts = (stops - sizes)[: len(found) - words + 1].tolist()
        yield np.array(
            [digest(joined[a:b], 42) for a, b in zip(starts, stops[words - 1 :].tolist(), strict=True)], dtype=np.uint64
        )
        some = True
        carry = found[len(found) - words + 1 :]
    if not some and carry:
        yield np.array([digest(b" ".join(carry), 42)], dtype=np.uint64)


def mixed(h: np.ndarray, stream: int) -> np.ndarray:
    """An independent 64-bit hash of each hash, by stream number."""
    z = h + np.uint64((stream * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(data: bytes, words: int, lanes: int = 1, anchors: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``lanes`` times 64 bits, and the smallest hash of the shingles in each of ``anchors`` streams.

    A bit is 1 if it is set in over half the hashes. The first lane takes the hashes as they are, further
    lanes take other streams. A text without words has fingerprint and anchors zero.
    """
    ones = np.zeros((lanes, 64), dtype=np.int64)
    least = np.full(anchors, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    total = 0
    for block in shingle_hashes(data, words):
        for part in range(0, len(block), 1 << 15):
            h = block[part : part + (1 << 15)]
            total += len(h)
            for lane in range(lanes):
                ones[lane] += _bit_counts(mixed(h, lane) if lane else h)
            for k in range(anchors):
                least[k] = min(least[k], mixed(h, 1000 + k).min())
    if not total:
        return np.zeros(lanes, dtype=np.uint64), np.zeros(anchors, dtype=np.uint64)
    set_bits = (2 * ones > total).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).reshape(-1), mixed(least, 1)


def with_fingerprints(docs: DataFrame, text: str, words: int, lanes: int = 1, anchors: int = 0) -> DataFrame:
    """The other columns with ``print`` (little-endian bytes) and ``anchors``; null texts count as empty."""
    bound_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text]
    schema = docs.select(*keep).schema.add("print", "binary").add("anchors", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, low = [], []
            for value in batch.column(text).cast(pa.binary()):
                p, a = fingerprint(value.as_py() or b"", words, lanes, anchors)
                prints.append(p.astype("<u8").tobytes())
                low.append(a.view(np.int64))
            made = [pa.array(prints, pa.binary()), pa.array(low, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, names=[*keep, "print", "anchors"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def spanning_links(prints: np.ndarray, table: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A shortest spanning forest of the fingerprints (rows of uint64) that differ in at most ``most`` bits.

    ``table`` holds each fingerprint's distances to the pivots. By the triangle inequality a pair whose
    distances to some pivot differ by more than ``most`` is too far apart; only the rest is compared.
    """
    links = []
    rest = np.arange(1, len(prints))
    near = np.full(len(prints), np.iinfo(np.int64).max)
    via = np.zeros(len(prints), dtype=np.int64)
    x = 0
    while len(rest):
        maybe = rest[(np.abs(table[rest] - table[x]) <= most).all(axis=1)]
        far = np.bitwise_count(prints[maybe] ^ prints[x]).sum(axis=1, dtype=np.int64)
        closer = far < near[maybe]
        near[maybe[closer]], via[maybe[closer]] = far[closer], x
        k = int(np.argmin(near[rest]))
        x = int(rest[k])
        if near[x] <= most:
            links.append((int(via[x]), x))
        rest = np.delete(rest, k)
    return links


def pivot_table(prints: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Distances of fingerprints (rows of uint64) to the pivots (rows of uint64)."""
    return np.stack([np.bitwise_count(prints ^ p).sum(axis=1, dtype=np.int16) for p in fixed], axis=1)


def links_in_buckets(keys: DataFrame, prints: DataFrame, lanes: int, most: int) -> DataFrame:
    """Links ``a, b`` between nodes of one bucket that differ in at most ``most`` bits, as spanning forests.

    ``keys`` is (key, node), ``prints`` (node, print). Buckets of one node are dropped by a combining count before
    fingerprints move. A bucket of more than ``CHUNK`` nodes is dealt into chunks and each pair of chunks
    becomes a cell of its own, so every pair still meets and no task holds more than two chunks.
    Each cell adds its first node to the pivots that all cells share, which tells a family from its neighbours.
    """
    shared = np.stack([mixed(np.arange(lanes, dtype=np.uint64), 2000 + k) for k in range(PIVOTS)])
    many = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("chunks")).cast("int")
    cells = (
        keys.hint("merge").join(many, "key")  # rows are made by explode, so the planner's size of them is too low
        .withColumns({"chunks": chunks})
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node")
        .join(prints, "node")
        .groupBy("key", "lo", "hi")
        .agg(F.collect_list("node").alias("nodes"), F.collect_list("print").alias("prints"))
        .where(F.size("nodes") > 1)
        .select("nodes", "prints")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for nodes, held in zip(batch.column("nodes"), batch.column("prints"), strict=True):
                nodes = nodes.values.to_numpy()
                p = np.frombuffer(b"".join(held.values.to_pylist()), dtype="<u8").reshape(-1, lanes)
                if len(p) == 2:
                    table = pivot_table(p, shared)
                    if np.abs(table[0] - table[1]).max() <= most and np.bitwise_count(p[0] ^ p[1]).sum() <= most:
                        a.append(nodes[0])
                        b.append(nodes[1])
                    continue
                for i, j in spanning_links(p, pivot_table(p, np.vstack([p[:1], shared])), most):
                    a.append(nodes[i])
                    b.append(nodes[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    found = cells.mapInArrow(run, "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    max_bits: int = 2,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id, kept`` for 64-bit SimHash.

    Texts are lower-cased in A-Z and cut at ASCII white space. Fingerprints that differ in at most ``max_bits``
    bits are linked; ``component_id`` is the smallest id reachable. Equal fingerprints are one class, so copies
    are never paired. Of each component one row is ``kept``: that with the smallest id, null last, then by a hash of its text
    and of the columns in ``carry``, which are brought along in a struct ``carried``. Null and empty texts have fingerprint
    zero and link like any other. Null ids never name a component unless it has no other. Repeated rows keep a row each;
    an empty table gives none; other columns of any name are ignored.

    Candidates are complete: of the eight bytes of a fingerprint at most ``max_bits`` differ in a linked pair, so
    the pair agrees in all others and meets in the bucket of those; a bucket holds at most
    256 ** max_bits different fingerprints, whatever the number of rows.
    """
    brought = [F.struct(*carry).alias("carried")] if carry else []
    read = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.xxhash64(text_col, *carry).alias("tie"),
        F.monotonically_increasing_id().alias("row"),
        *brought,
    )
    digits = F.concat(*[F.substring(F.hex("print"), at, 2) for at in range(15, 0, -2)])
    rows = write_once(
        with_fingerprints(read, "text", words)
        .withColumn("hex", F.lower(digits))
        .withColumn("node", F.conv("hex", 16, -10).cast("bigint"))
        .drop("anchors")
    )
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "row")
    nodes = write_once(rows.groupBy("node").agg(F.min(place).alias("least"), F.min("print").alias("print")))
    kept = []
    for dropped in combinations(range(8), max_bits):
        mask = sum(0xFF << (8 * k) for k in range(8) if k not in dropped)
        kept.append(F.xxhash64(F.lit(len(kept)), F.col("node").bitwiseAND(F.lit(_signed(mask)))))
    keys = nodes.select("node", F.explode(F.array(*kept)).alias("key"))
    links = write_once(links_in_buckets(keys, nodes.select("node", "print"), 1, max_bits))
    labels = connected_components(links)
    named = write_once(nodes.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label")))
    smallest = named.groupBy("label").agg(F.min("least").alias("first"))
    of_node = named.select("node", "label").join(smallest, "label").select("node", "first")
    return rows.join(of_node, "node").select(
        "doc_id",
        F.col("hex").alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        *(["carried"] if carry else []),
    )


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def radius(similarity: float, bits: int, slack: float) -> int:
    """Bits in which fingerprints of two shingle sets of that Jaccard similarity differ.

    The cosine of the sets is 2s / (1 + s); each bit differs with the chance of their angle over pi. ``slack``
    standard deviations are added, so that pairs just at the similarity are not lost to the draw of the bits.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + slack * math.sqrt(bits * p * (1 - p)))
