"""BPE encoding and decoding with the tokenizers library; long texts by tree concatenation."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from signals.llm.batches import bound_batches

#: Texts of more characters than this are cut into pieces that are encoded in parallel.
PIECE = 1 << 15
#: Characters on each side of a join in the first window, and tokens that both sides must agree on.
WINDOW, AGREE = 64, 4
#: Words whose encoding a worker remembers before it starts anew.
REMEMBERED = 150_000

# The word pattern of the pre-tokenizer that the quick way knows, and its last letter.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LAST = 0x24F


def _plain_patterns() -> tuple[re.Pattern[str], re.Pattern[str]]:
    """The word pattern over the Latin blocks, and the texts it holds for.

    In these characters composition changes nothing, lower case is one to one, and letters and digits
    have been settled for long, so the standard library's classes equal those of the tokenizer.
    """
    latin = [chr(c) for c in range(0x20, _LAST + 1)]
    letters = "".join(re.escape(c) for c in latin if unicodedata.category(c)[0] == "L")
    digits = "".join(re.escape(c) for c in latin if unicodedata.category(c)[0] == "N")
    blank = r"\t\n\x0b\x0c\r \x85\xa0"
    words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{blank}{letters}{digits}]+")
    return words, re.compile("[\\t\\n\\x0b\\x0c\\r\\x20-\\x7e\\xa1-\\u012f\\u0131-\\u024f]*")


class Codec:
    """Encodes and decodes as the library does, remembering words where words are encoded one by one."""

    def __init__(self, config: str) -> None:
        self.library = Tokenizer.from_str(config)
        self.library.no_truncation()
        self.library.no_padding()
        made = json.loads(config)
        steps = [x.get("type") for x in (made.get("normalizer") or {}).get("normalizers", [])]
        cuts = [x.get("pattern", {}).get("Regex") for x in (made.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and cuts == [_SPLIT, None]
        self.special = [x["content"] for x in made.get("added_tokens", [])]
        self.words, self.plain = _plain_patterns()
        self.known: dict[str, tuple[int, ...]] = {}
        self.tokens = None
        if made.get("decoder") is None:
            size = self.library.get_vocab_size()
            self.tokens = [self.library.id_to_token(i) or "" for i in range(size)]

    def whole(self, text: str):
        return self.library.encode(text, add_special_tokens=False)

    def encode(self, text: str) -> np.ndarray:
        if not (self.by_word and self.plain.fullmatch(text)) or any(s in text for s in self.special):
            return np.array(self.whole(text).ids, dtype=np.int32)
        found = self.words.findall(text.lower())
        known = self.known
        for word in set(found).difference(known):
            known[word] = tuple(self.whole(word).ids)
        ids = np.fromiter(chain.from_iterable(map(known.__getitem__, found)), dtype=np.int32)
        if len(known) > REMEMBERED:
            known.clear()
        return ids

    def decode(self, ids: np.ndarray) -> str:
        if self.tokens is None:
            return self.library.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(config: str) -> Codec:
    return Codec(config)


def _common(a: list[int], b: list[int]) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _agreed(one: list[tuple], other: list[tuple]) -> set[tuple]:
    """Tokens (id, start, end) in the middle of runs of ``AGREE`` tokens that both encodings have."""
    both = set(other)
    runs, run = set(), []
    for token in [*one, None]:
        if token in both:
            run.append(token)
            continue
        if len(run) >= AGREE:
            runs.update(run[1:-1])
        run = []
    return runs


def join_halves(c: Codec, left: str, a: np.ndarray, right: str, b: np.ndarray) -> np.ndarray:
    """The encoding of ``left + right`` from the encodings of both.

    A window around the join is encoded again. On each side its tokens are held against the half's
    own, by id and position; where a run of them agrees, the half is cut off and the window takes over.
    The window grows until both sides agree, at last over both halves whole.
    """
    if not left or not right:
        return b if not left else a
    size = WINDOW
    while size < max(len(left), len(right)):
        tail, head = left[-2 * size :], right[: 2 * size]
        window = c.whole(tail + head)
        middle = [(i, s, e) for i, (s, e) in zip(window.ids, window.offsets, strict=True)]
        before = c.whole(tail)
        n = _common(before.ids[::-1], a[::-1][: len(before.ids)].tolist())
        mine = [(i, s, e) for i, (s, e) in zip(before.ids, before.offsets, strict=True)]
        sure = _agreed(middle, mine[len(mine) - n :]) if n else set()
        after = c.whole(head)
        m = _common(after.ids, b[: len(after.ids)].tolist())
        theirs = [(i, s + len(tail), e + len(tail)) for i, (s, e) in zip(after.ids, after.offsets, strict=True)]
        sound = _agreed(middle, theirs[:m]) if m else set()
        if sure and sound:
            first = min(k for k, token in enumerate(middle) if token in sure)
            last = max(k for k, token in enumerate(middle) if token in sound)
            if first < last:
                keep = len(a) - (len(mine) - mine.index(middle[first]))
                drop = theirs.index(middle[last])
                return np.concatenate([a[:keep], np.array(window.ids[first:last], np.int32), b[drop:]])
        size *= 2
    return c.encode(left + right)


def join_tree(c: Codec, pieces: list[tuple[str, np.ndarray]]) -> np.ndarray:
    """Neighbouring halves joined level by level until one encoding is left."""
    while len(pieces) > 1:
        pairs = [pieces[i : i + 2] for i in range(0, len(pieces), 2)]
        pieces = [
            p[0] if len(p) == 1 else (p[0][0] + p[1][0], join_halves(c, p[0][0], p[0][1], p[1][0], p[1][1])) for p in pairs
        ]
    return pieces[0][1]


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def encode_texts(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    piece: int = PIECE,
) -> DataFrame:
    """One row per input row: ``doc_id, ids, decoded``.

    ``ids`` is what the library gives for the whole text with ``add_special_tokens=False``, without truncation or
    padding; ``decoded`` is its ``decode(ids, skip_special_tokens=False)``. Null and empty texts have no ids. Repeated rows
    keep a row each; an empty table gives none; further columns are ignored.

    Texts of up to ``piece`` characters are encoded where they are read. Longer ones are cut into pieces, the pieces
    are dealt out and encoded in parallel, and the halves of each text are joined as a tree: its
    encodings meet in one task, as they are one value of the result. The file is read once by the driver and its
    text is broadcast; it does not grow with the data.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    config = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(config.value)
        for batch in batches:
            ids = [c.encode(t.as_py()) for t in batch.column("text")]
            decoded = pa.array([c.decode(i) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(ids), decoded], names=["doc_id", "ids", "decoded"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (row, key) in enumerate(zip(batch.column("row"), batch.column("key"), strict=True)):
                value = batch.column("text")[i].as_py()
                parts = [value[at : at + piece] for at in range(0, len(value), piece)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("doc_id")[i].as_py()] * n, batch.column("doc_id").type),
                        pa.array([row.as_py()] * n, pa.int64()),
                        pa.array([key.as_py()] * n, pa.int64()),
                        pa.array(range(n), pa.int32()),
                        pa.array(parts, pa.string()),
                    ],
                    names=["doc_id", "row", "key", "place", "text"],
                )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(config.value)
        for batch in batches:
            ids = [c.encode(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(ids)], names=["doc_id", "row", "key", "place", "text", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(config.value)
        for batch in batches:
            for i in range(batch.num_rows):
                parts = batch.column("parts")[i]
                halves = [(p["text"].as_py(), p["ids"].values.to_numpy()) for p in parts]
                ids = join_tree(c, halves)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, 1), _lists([ids]), pa.array([c.decode(ids)], pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    few, many = F.length("text") <= piece, F.length("text") > piece
    result = f"doc_id {kind}, ids array<int>, decoded string"
    keyed = f"doc_id {kind}, row bigint, key bigint, place int, text string"
    long = read.where(many).withColumns({"row": F.monotonically_increasing_id(), "key": F.xxhash64("text")})
    encoded = (
        long.mapInArrow(cut, keyed)
        .repartition("row", "key", "place")
        .mapInArrow(pieces, f"{keyed}, ids array<int>")
    )
    trees = encoded.groupBy("row", "key").agg(
        F.first("doc_id").alias("doc_id"),
        F.array_sort(F.collect_list(F.struct("place", "text", "ids"))).alias("parts"),
    )
    return read.where(few).mapInArrow(short, result).unionByName(trees.select("doc_id", "parts").mapInArrow(joined, result))


def decode_ids(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the decoded text of an id list; a null list is an empty one."""
    config = df.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    names = [c for c in df.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(config.value)
        for batch in batches:
            lists = batch.column(names.index(ids_col))
            out = [c.decode(np.array(x.as_py() or [], dtype=np.int32)) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*names, name])

    schema = df.select(*names).schema.add(name, "string")
    return df.select(*names).mapInArrow(run, schema)
