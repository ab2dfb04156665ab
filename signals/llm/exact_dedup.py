"""Exact duplicates with a heavy-hitter split, in DataFrame operations only.

Texts that fill a large part of a corpus are found by a Misra-Gries pass, which keeps a fixed number
of counters per task. Their winners are settled by one combining aggregate, checked against the
support that bounds their number, and broadcast: rows of frequent texts never meet in one task. All
other digests go through an ordinary shuffle, where no group can exceed the support.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signals.sources.scratch import write_once


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    support: float = 0.002,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows belong together when their normalised texts are identical (SHA-256 of the UTF-8 bytes); of a
    group the row with the largest id stays. ``support`` is the share of rows from which a digest
    counts as frequent; at most ``1 / support`` digests can be, which bounds what is broadcast.

    Null texts count as empty. A null id loses against any other. When the kept id occurs on several
    equal rows, one of them stays. An empty table gives no rows; further columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(normalise(text) if normalise else text, 256))
    rows = write_once(
        docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest")).select(
            "*", F.xxhash64("digest").alias("tag"), F.monotonically_increasing_id().alias("row")
        )
    )
    candidates = rows.stat.freqItems(["tag"], support).select(F.explode("tag_freqItems").alias("tag"))
    least = F.lit(support * rows.count())
    member = F.struct(F.col("doc_id"), F.col("row"))
    settle = (F.max(member).alias("winner"), F.count(F.lit(1)).alias("group_size"))

    # At most 1 / support rows each: Misra-Gries keeps no more counters, and the exact count is checked.
    frequent = write_once(
        rows.join(F.broadcast(candidates), "tag").groupBy("digest").agg(*settle).where(F.col("group_size") >= least)
    )
    here = rows.join(F.broadcast(frequent), "digest")
    other = rows.join(F.broadcast(frequent.select("digest")), "digest", "left_anti")
    there = other.join(other.groupBy("digest").agg(*settle), "digest")
    return here.unionByName(there).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
