"""Document fingerprints by consistent weighted sampling of weighted terms."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signals.llm.batches import bound_batches
from signals.sources.scratch import write_once

#: Samples of a fingerprint: a likeness s is estimated with a deviation of sqrt(s (1 - s) / SAMPLES).
SAMPLES = 64
#: Terms with their weights whose samples a worker remembers, and terms worked on at once.
REMEMBERED, BLOCK = 1 << 16, 1 << 12
TERM = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bytes of a text cut into terms at once.
PIECE = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: What a sample of a text without terms says; it agrees with those of other such texts.
_NONE = 0


def weighted_terms(data: bytes) -> Counter[bytes]:
    """How often each word of a text occurs, A-Z lower-cased; words are runs of anything but ASCII white space."""
    if len(data) <= PIECE:
        return Counter(TERM.findall(data.lower()))
    found: Counter[bytes] = Counter()
    at = 0
    while at < len(data):
        gap = _SPACE.search(data, at + PIECE)
        end = gap.start() if gap else len(data)
        found.update(TERM.findall(data[at:end].lower()))
        at = end
    return found


#: -ln u for the 65,536 midpoints u of a 16-bit draw, so that a sum of two draws is one from Gamma(2, 1).
_EXPONENTIAL = -np.log((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)


def _mixed(h: np.ndarray) -> np.ndarray:
    """32 well mixed bits of each number, in place."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(factor)
    h ^= h >> np.uint32(16)
    return h


def _draws(seeds: np.ndarray, words: int, stream: int) -> np.ndarray:
    """``2 * words`` 16-bit draws for each seed."""
    step = np.arange(stream << 16, (stream << 16) + words, dtype=np.uint32) * np.uint32(0x9E3779B9)
    return _mixed(seeds[:, None] ^ step[None, :]).astype("<u4", copy=False).view("<u2")


def samples_of(keys: np.ndarray, weights: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """For each term (64-bit key) and weight: the log of its rank in every sample, and its quantised weight there.

    With r and c drawn from Gamma(2, 1) and b uniform, by term and sample alone, the weight w is quantised in the log
    scale to t = floor(ln w / r + b), and the rank is c / exp(r (t - b) + r). The term of least rank and its t are a text's
    sample; two texts agree in it with the chance sum of least over sum of greatest weights.
    """
    low, high = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint32)
    drawn = _EXPONENTIAL[_draws(low, samples, 0)]
    r = drawn[:, :samples] + drawn[:, samples:]
    drawn = _EXPONENTIAL[_draws(high, samples, 1)]
    rank = np.log(drawn[:, :samples] + drawn[:, samples:])
    b = (_draws(low, (samples + 1) // 2, 2)[:, :samples] + np.float32(0.5)) / np.float32(1 << 16)
    t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + b)
    rank -= r * (t - b + np.float32(1))
    return rank, t.astype(np.int32)


class Sampler:
    """Fingerprints of texts; samples of frequent terms are remembered, as they depend on term and weight alone."""

    def __init__(self, samples: int, remembered: int = REMEMBERED) -> None:
        self.samples, self.remembered = samples, remembered
        self.place: dict[tuple[bytes, int], int] = {}
        self.rank = np.empty((remembered, samples), dtype=np.float32)
        self.step = np.empty((remembered, samples), dtype=np.int32)
        self.name = np.empty(remembered, dtype=np.uint32)
        self.columns = np.arange(samples)

    def _rows(self, terms: list[tuple[bytes, int]]) -> np.ndarray:
        """Places of at most ``BLOCK`` terms in the tables; unknown ones are computed together."""
        places = list(map(self.place.get, terms))
        new = [x for x, at in zip(terms, places, strict=True) if at is None] if None in places else []
        if len(self.place) + len(new) > self.remembered:
            self.place.clear()
            new = terms
        if new:
            keys = np.fromiter([xxhash.xxh64_intdigest(w, 42) for w, _ in new], np.uint64, len(new))
            weights = np.fromiter([n for _, n in new], np.int64, len(new))
            at = len(self.place)
            self.rank[at : at + len(new)], self.step[at : at + len(new)] = samples_of(keys, weights, self.samples)
            self.name[at : at + len(new)] = (keys >> np.uint64(32)).astype(np.uint32) ^ keys.astype(np.uint32)
            self.place.update(zip(new, range(at, at + len(new)), strict=True))
            places = list(map(self.place.__getitem__, terms))
        return np.array(places, dtype=np.int64)

    def fingerprint(self, data: bytes) -> np.ndarray:
        """One 16-bit code of the chosen term and its quantised weight per sample."""
        terms = list(weighted_terms(data).items())
        if not terms:
            return np.full(self.samples, _NONE, dtype="<u2")
        best, codes = None, None
        for at in range(0, len(terms), BLOCK):
            rows = self._rows(terms[at : at + BLOCK])
            rank = self.rank[rows]
            least = rank.argmin(axis=0)
            value, winner = rank[least, self.columns], rows[least]
            mixed = _mixed(self.name[winner] + self.step[winner, self.columns].view(np.uint32) * np.uint32(0x27D4EB2F))
            code = (mixed >> np.uint32(16)).astype("<u2")
            if best is None:
                best, codes = value, code
            else:
                codes = np.where(value < best, code, codes)
                best = np.minimum(value, best)
        return codes


def weighted_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES
) -> DataFrame:
    """One row per input row: ``doc_id, print``, the little-endian 16-bit codes of the samples of the whole text.

    The share of equal codes of two texts estimates the generalised Jaccard similarity of their weighted terms (words
    with their counts); chance agreement of codes is 2 ** -16. Null texts count as empty; texts without words agree with each
    other. Equal texts have equal fingerprints. Repeated rows keep a row each; an empty table gives none;
    further columns are ignored.
    """
    bound_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    kind = read.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for batch in batches:
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            made = pa.array([sampler.fingerprint(t or b"").tobytes() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), made], names=["doc_id", "print"])

    return read.mapInArrow(run, f"doc_id {kind}, print binary")


def likeness(a: bytes, b: bytes) -> float:
    """The share of samples in which two fingerprints agree."""
    one, other = np.frombuffer(a, "<u2"), np.frombuffer(b, "<u2")
    return float(np.count_nonzero(one == other) / len(one))


def half_replaced(text: str, following: str) -> str:
    """The text with its last half replaced by as many first characters of the following one, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES
) -> DataFrame:
    """One row per input row: ``doc_id, n_chars, edited_sha256, print, edited_print, near_edited, near_next``.

    Each text is held against an edited one, whose last half is replaced by the beginning of the next document by ascending
    id; the first follows the last. ``near_edited`` and ``near_next`` are the likeness of its fingerprint to those of the
    edited text and of the next document. Null texts count as empty. Null ids come first, rows of one id are ordered
    by the XXH64 of their texts, repeated rows follow each other. An empty table gives none; further columns are ignored.

    Rows are sorted once over all tasks by id, text hash and row number, so a hot id is cut into many parts, and read in
    order: every row meets the next one in its own task. Only the last row of each part, whose next stands in another,
    is written with its text and joined to the first row of the part that follows.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.make_valid_utf8(F.col(text_col).cast("string")), F.lit(""))
    read = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    ordered = read.orderBy("doc_id", F.xxhash64("_text"), F.monotonically_increasing_id())
    measured = "n_chars bigint, edited_sha256 string, print binary, edited_print binary, near_edited double, near_next double"
    fields = f"doc_id {kind}, {measured}, place string, part int, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        head, last, ids, part = None, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [] if last is None else [last]
            for value in batch.column("_text").to_pylist():
                same = held and held[-1][0] == value
                held.append(held[-1] if same else (value, sampler.fingerprint(value.encode()).tobytes()))
            if last is None:
                head, part, ids = (batch.column("doc_id")[:1], held[0]), batch.column("_part")[0].as_py(), batch.column("doc_id")[:0]
            ids = pa.concat_arrays([ids, batch.column("doc_id")])
            rows = [compared(a, b, sampler) for a, b in zip(held, held[1:], strict=False)]
            yield as_batch(ids[: len(rows)], rows, "inside", part, [None] * len(rows))
            last, ids = held[-1], ids[len(rows) :]
        if last is not None:
            for place, of, row in (("head", *head), ("tail", ids, last)):
                yield as_batch(of, [(len(row[0]), None, row[1], None, None, None)], place, part, [row[0]])

    made = write_once(ordered.withColumn("_part", F.spark_partition_id()).mapInArrow(run, fields))
    # One row a part: which part follows is settled on numbers alone, then the few texts are joined.
    heads = made.where(F.col("place") == "head")
    order = Window.orderBy("part")
    first = F.first("part").over(order)
    follows = heads.select("part", F.coalesce(F.lead("part").over(order), first).alias("next"))
    next_row = heads.select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("print").alias("next_print"))
    open_rows = made.where(F.col("place") == "tail").join(follows, "part").join(next_row, "next")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for batch in batches:
            texts, prints, next_texts, next_prints = (
                batch.column(c).to_pylist() for c in ("text", "print", "next_text", "next_print")
            )
            pairs = zip(zip(texts, prints, strict=True), zip(next_texts, next_prints, strict=True), strict=True)
            rows = [compared(a, b, sampler) for a, b in pairs]
            yield as_batch(batch.column("doc_id"), rows, "closed", None, [None] * len(rows))

    closed = open_rows.select("doc_id", "text", "print", "next_text", "next_print").mapInArrow(close, fields)
    return made.where(F.col("place") == "inside").union(closed).drop("place", "part", "text")


def compared(one: tuple[str, bytes], following: tuple[str, bytes], sampler: Sampler) -> tuple:
    """``n_chars, edited_sha256, print, edited_print, near_edited, near_next`` of a (text, print) and the next one."""
    edited = half_replaced(one[0], following[0]).encode()
    other = sampler.fingerprint(edited).tobytes()
    return len(one[0]), hashlib.sha256(edited).hexdigest(), one[1], other, likeness(one[1], other), likeness(one[1], following[1])


def as_batch(ids: pa.Array, rows: list[tuple], place: str, part: int | None, texts: list[str | None]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    names = ["n_chars", "edited_sha256", "print", "edited_print", "near_edited", "near_next"]
    columns = [pa.array([row[k] for row in rows], t) for k, t in enumerate(kinds)]
    more = [pa.array([place] * len(rows), pa.string()), pa.array([part] * len(rows), pa.int32()), pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays([ids, *columns, *more], names=["doc_id", *names, "place", "part", "text"])
