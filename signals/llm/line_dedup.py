"""Cross-site boilerplate lines, found by the spread of distinct sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signals.llm.components import connected_components
from signals.llm.simhash import radius, with_fingerprints
from signals.sources.scratch import write_once

#: log2 of the registers of a sketch; its relative error is about 1.04 / sqrt(4096), or 1.6 %.
LG_K = 12
#: A line of ``MIN_WORDS`` words or more is boilerplate on this share of all sites, 3 at least and ``MIN_SITES`` at most.
SITE_SHARE, MIN_SITES, MIN_WORDS = 0.25, 10, 4
#: Shorter lines repeat by chance: they must be on this share of the sites and in this share of the different texts.
SHORT_SHARE, SHORT_TEXTS = 0.9, 0.005


def line_key(line: Column) -> Column:
    """128 bits of a line without blanks at its ends."""
    trimmed = F.trim(line, F.lit(" \t\r"))
    return F.struct(F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit("#"), trimmed).alias("b"))


def has_words(line: Column, words: int) -> Column:
    """Whether a line has that many words of anything but ASCII white space."""
    blank = r"[\x20\x09-\x0D]"
    return line.rlike(rf"^{blank}*([^\x20\x09-\x0D]+{blank}+){{{words - 1}}}[^\x20\x09-\x0D]")


def copy_groups(docs: DataFrame, text_col: str = "text", words: int = 5, similarity: float = 0.8, anchors: int = 4) -> DataFrame:
    """``text_key, group`` of texts that are near copies of others, for counting them once.

    Each text has a 64-bit fingerprint and the smallest hash of its word shingles in each of ``anchors`` streams. Texts that
    share an anchor meet the smallest key of that bucket, nothing else, and are linked if their fingerprints
    are within a deviation of that similarity; groups are the components. Cost grows with the texts: a family of n near
    copies makes n links a stream. Texts without links are not returned, and null texts have none.
    """
    read = docs.where(F.col(text_col).isNotNull()).select(
        F.xxhash64(F.col(text_col).cast("string")).alias("text_key"), F.col(text_col).cast("string").alias("_text")
    )
    prints = with_fingerprints(read, "_text", words, 1, anchors)
    bits = F.conv(F.hex(F.col("print")), 16, -10).cast("bigint")
    texts = write_once(prints.groupBy("text_key").agg(F.min(bits).alias("print"), F.min("anchors").alias("anchors")))
    keys = texts.select(F.struct("text_key", "print").alias("t"), F.posexplode("anchors").alias("k", "anchor"))
    centres = keys.groupBy("k", "anchor").agg(F.min("t").alias("c"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    apart = F.bit_count(F.col("t.print").bitwiseXOR(F.col("c.print")))
    links = (
        keys.join(centres, ["k", "anchor"])
        .where((F.col("t.text_key") != F.col("c.text_key")) & (apart <= radius(similarity, 64, 1.0)))
        .select(F.col("t.text_key").alias("a"), F.col("c.text_key").alias("b"))
    )
    return connected_components(write_once(links)).select(F.col("node").alias("text_key"), F.col("label").alias("group"))


def remove_spread_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    site_share: float = SITE_SHARE,
    min_sites: int = MIN_SITES,
    min_words: int = MIN_WORDS,
    short_share: float = SHORT_SHARE,
    short_texts: float = SHORT_TEXTS,
    band: float = 0.1,
    near_copies: bool = False,
) -> DataFrame:
    """The rows given, with boilerplate lines taken out of ``text``.

    A line is boilerplate if it stands on enough distinct sites and in as many different texts, so that the
    copies of one document, on however many sites, keep their lines. Enough is ``site_share`` of all sites, but
    at least 3 and at most ``min_sites``. Lines of fewer than ``min_words`` words need ``short_share`` of the sites (3 to
    ``10 * min_sites``) and ``short_texts`` of all different texts besides. With ``near_copies`` the near copies of a
    text (``copy_groups``) count as one text. Blank lines are never removed.

    All columns come back, of any names, with ``lines`` and ``lines_removed`` added (existing columns of these names are
    replaced). Lines end at line feeds and are compared without blanks at their ends. Null sites are no site; null texts
    stay null and have no lines; a text may become empty. Repeated rows keep a row each; an empty table gives
    none; with fewer than 3 sites nothing is removed.

    HyperLogLog sketches per line hash, of sites and then of texts, are merged by aggregation, so a line that holds a third of
    all rows costs one sketch per task. Lines whose estimates are further than ``band`` (over six standard errors) from the
    thresholds are decided by them; the few others get exact distinct counts. The lines to remove are joined, not
    broadcast by hint: their number has no proven bound. A text of any length is split whole; its cost is its lines times the
    different lines removed from it.
    """
    names = [c for c in docs.columns if c not in ("lines", "lines_removed")]
    read = docs.select(
        F.struct(*names).alias("all"),
        F.xxhash64(id_col, text_col).alias("row_a"),
        F.xxhash64(F.lit("#"), id_col, text_col).alias("row_b"),
        F.col(site_col).cast("string").alias("site"),
        F.col(text_col).cast("string").alias("text"),
        F.xxhash64(F.col(text_col).cast("string")).alias("text_key"),
    )
    each = read.select("row_a", "row_b", "site", "text_key", F.explode(F.split("text", "\n")).alias("line")).where(
        has_words(F.col("line"), 1)
    )
    lines = each.select(
        "row_a", "row_b", "site", "text_key", line_key(F.col("line")).alias("key"), has_words(F.col("line"), min_words).alias("long")
    )
    n_sites = read.where(F.col("site").isNotNull()).select("site").distinct().count()
    n_texts = read.where(F.col("text").isNotNull()).select("text_key").distinct().count()
    few = F.least(F.lit(min_sites), F.greatest(F.lit(3), F.ceil(F.lit(site_share * n_sites))))
    many = F.least(F.lit(10 * min_sites), F.greatest(F.lit(3), F.ceil(F.lit(short_share * n_sites))))
    need_sites = F.when(F.col("long"), few).otherwise(many)
    need_texts = F.when(F.col("long"), few).otherwise(F.greatest(many, F.ceil(F.lit(short_texts * n_texts))))
    maybe = lambda count, need: count >= F.floor(need * F.lit(1 - band))
    sure = lambda count, need: count > F.ceil(need * F.lit(1 + band))
    sketch = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(LG_K)))

    spread = lines.groupBy("key", "long").agg(sketch("site").alias("sites"))
    wide = write_once(spread.where(maybe(F.col("sites"), need_sites)))
    held = lines.join(wide.select("key"), "key", "left_semi").select("key", "long", "site", "text_key")
    if near_copies:
        groups = copy_groups(docs.select(F.col(text_col).alias("text")), "text")
        once = held.groupBy("key", "long", "site", "text_key").agg(F.lit(1).alias("one"))
        held = once.join(groups, "text_key", "left").select("key", "long", "site", F.coalesce("group", "text_key").alias("text_key"))
        held = write_once(held)
    deep = held.groupBy("key").agg(sketch("text_key").alias("texts"))
    found = write_once(wide.join(deep, "key").where(maybe(F.col("texts"), need_texts)))
    certain = sure(F.col("sites"), need_sites) & sure(F.col("texts"), need_texts)
    exact = (
        held.join(found.where(~certain).select("key"), "key", "left_semi")
        .groupBy("key", "long")
        .agg(F.count_distinct("site").alias("sites"), F.count_distinct("text_key").alias("texts"))
        .where((F.col("sites") >= need_sites) & (F.col("texts") >= need_texts))
    )
    boilerplate = write_once(found.where(certain).select("key").union(exact.select("key")))
    hits = write_once(
        lines.join(boilerplate, "key", "left_semi").groupBy("row_a", "row_b").agg(F.collect_set("key").alias("drop"))
    )
    split = F.split("text", "\n")
    left = F.filter(split, lambda x: ~(F.array_contains("drop", line_key(x)) & has_words(x, 1)))
    kept = F.when(F.col("drop").isNotNull(), left).otherwise(split)
    return (
        read.join(hits, ["row_a", "row_b"], "left")
        .withColumn("kept", kept)
        .select(
            *[F.array_join("kept", "\n").alias(c) if c == text_col else F.col("all").getField(c).alias(c) for c in names],
            F.coalesce(F.size(split), F.lit(0)).cast("long").alias("lines"),
            F.coalesce(F.size(split) - F.size("kept"), F.lit(0)).cast("long").alias("lines_removed"),
        )
    )
