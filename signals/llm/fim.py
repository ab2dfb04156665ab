"""Fill-in-middle transformation of texts as one pipeline of pyarrow.compute calls per Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signals.llm.batches import bound_batches

#: What opens the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Parts of a hundred of the texts that are cut at all, and of those that put the suffix first.
RATE, SUFFIX_FIRST = 50, 80
#: A unit ends where white space follows another byte, so cutting there leaves blanks at the front of words.
_UNIT_END = r"([^\x20\x09-\x0D])([\x20\x09-\x0D])"
#: No byte of valid UTF-8 text, so it cannot occur in one.
_MARK = b"\xff"
_DRAWS = ("_h1", "_h2", "_h3", "_h4")


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit draws: the first digits of the SHA-256 of seed and key; a null key is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint").alias(n) for k, n in enumerate(_DRAWS)]


def _modulo(value: pa.Array, by: pa.Array) -> pa.Array:
    return pc.subtract(value, pc.multiply(pc.divide(value, by), by))


def _joined(units: pa.Array, of_row: pa.Array, chosen: pa.Array, rows: int) -> pa.Array:
    """The chosen units of each row in one piece: lists are built again from the parents and joined."""
    parents = pc.filter(of_row, chosen)
    ends = np.cumsum(np.bincount(parents.to_numpy(zero_copy_only=False), minlength=rows))
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pc.filter(units, chosen)), pa.scalar(b"", pa.binary()))


def transform(text: pa.Array, h: list[pa.Array], sentinels: tuple[str, str, str], rate: int, suffix_first: int) -> list[pa.Array]:
    """``n, form, prefix_chars, middle_chars, output`` of a batch of texts without nulls."""
    rows = len(text)
    raw = text.cast(pa.binary())
    lists = pc.split_pattern(pc.replace_substring_regex(raw, pattern=_UNIT_END, replacement=b"\\1" + _MARK + b"\\2"), pattern=_MARK)
    empty = pc.equal(pc.binary_length(raw), 0)
    n = pc.if_else(empty, 0, pc.list_value_length(lists).cast(pa.int64()))

    plain = pc.or_(empty, pc.greater_equal(_modulo(h[2], pa.scalar(100, pa.int64())), rate))
    for s in sentinels:
        plain = pc.or_(plain, pc.match_substring(raw, pattern=s))
    spm = pc.less(_modulo(h[3], pa.scalar(100, pa.int64())), suffix_first)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))

    places = pc.add(n, 1)
    one, other = _modulo(h[0], places), _modulo(h[1], places)
    low, high = pc.min_element_wise(one, other), pc.max_element_wise(one, other)

    units, of_row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    begins = pc.subtract(pc.cumulative_sum(pc.list_value_length(lists).cast(pa.int64())), pc.list_value_length(lists).cast(pa.int64()))
    ordinal = pc.subtract(pa.array(np.arange(len(units), dtype=np.int64)), pc.take(begins, of_row))
    cut = pc.invert(pc.take(plain, of_row))
    first = pc.and_(cut, pc.less(ordinal, pc.take(low, of_row)))
    last = pc.and_(cut, pc.greater_equal(ordinal, pc.take(high, of_row)))
    middle = pc.and_(cut, pc.invert(pc.or_(first, last)))
    p, m, s = (_joined(units, of_row, chosen, rows) for chosen in (first, middle, last))

    mark = [pa.scalar(x.encode(), pa.binary()) for x in sentinels]
    nothing = pa.scalar(b"", pa.binary())
    psm = pc.binary_join_element_wise(mark[0], p, mark[1], s, mark[2], m, nothing)
    spm_out = pc.binary_join_element_wise(mark[1], s, mark[0], p, mark[2], m, nothing)
    output = pc.if_else(plain, raw, pc.if_else(spm, spm_out, psm)).cast(pa.string())
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x.cast(pa.string())).cast(pa.int64())) for x in (p, m)]
    return [n, form, *chars, output]


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 42,
    sentinels: tuple[str, str, str] = SENTINELS,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """One row per input row: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    A text is cut into n units, words with the white space before them and a blank end as a unit of its own. Two draws
    by seed and id place the cuts between prefix, middle and suffix. ``form`` is ``plain`` for the text as it is, ``psm``
    (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle); each piece follows its sentinel. Empty texts, texts that
    hold a sentinel, and those not drawn are plain, and their lengths (code points) are null.

    Null texts count as empty; bytes that are no UTF-8 are replaced first. Rows of one id draw alike, a null id
    is empty. Repeated rows keep a row each; an empty table gives none; further columns are ignored. Everything
    stays in the row's own batch; a text of any length is worked on whole, with about twelve bytes a unit and
    four copies of the text beside it.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.make_valid_utf8(F.col(text_col).cast("string")), F.lit(""))
    read = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), *draws(F.col(id_col), seed))
    kind = read.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = transform(batch.column("_text"), [batch.column(n) for n in _DRAWS], sentinels, rate, suffix_first)
                names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=names)

    return read.mapInArrow(
        run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    )


def restored(form: Column, output: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of; pieces hold no sentinel, so the output splits at exactly three."""
    quoted = "|".join("\\Q" + s + "\\E" for s in sentinels)
    part = lambda k: F.element_at(F.split(output, quoted), k)
    return (
        F.when(form == "psm", F.concat(part(2), part(4), part(3)))
        .when(form == "spm", F.concat(part(3), part(4), part(2)))
        .otherwise(output)
    )
