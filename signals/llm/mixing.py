"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signals.operators.ranking import ordered_blocks
from signals.sources.scratch import write_once

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Times the documents that still fit are ranked again after the first that did not.
PASSES = 3
#: A source's order is first cut into this many slices; only one slice per source is sorted.
SLICES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """A repeatable draw in (0, 1) from the decimal form of a key."""
    digits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13), 16, 10)
    return (digits.cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sources: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """Adds ``target``: all words shared by weight, at most ``cap`` times each source's own size.

    ``sources`` is (source, source_size), one row each. Weights repeat along the code point order of the
    names, null last. What a capped source cannot take is shared again by weight among the others,
    until none is above its cap; each pass is one aggregate over the small table of sources.
    """
    blocks = ordered_blocks(sources, [F.col("source").isNull(), F.col("source")])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.groupBy("_block").count()
    offsets = offsets.select("_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    place = (F.col("_offset") + F.col("_position") - 1) % len(weights)
    weighted = blocks.join(F.broadcast(offsets), "_block").select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place + 1).cast("int")).alias("weight"),
        (F.lit(int(cap)) * F.col("source_size")).alias("most"),
    )
    total, share = weighted.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (total / share if share else 0.0), -1
    while True:
        capped = F.col("most") <= F.lit(level) * F.col("weight")
        n, held, rest = weighted.agg(
            F.count_if(capped),
            F.coalesce(F.sum(F.when(capped, F.col("most"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)),
        ).first()
        if n == full or not rest:
            break
        full, level = n, (total - held) / rest
    target = F.when(capped, F.col("most").cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return weighted.select("source", "source_size", target.alias("target"))


def expected_copies(classes: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """``source, weight, source_size, target, whole, p, gap0`` for each size class of a source.

    ``classes`` is (source, weight, words), ``sources`` (source, source_size, target). A document's expected copies grow with
    the weight of its size class, so that the source's expected words are its target, and stop at ``cap``: heavier classes that
    reach it are held there and the rest of the target is spread over the lighter ones. Of the expected copies the
    whole part is certain and the rest ``p`` the chance of one more; ``gap0`` is what certain copies leave of the target.
    """
    named = _with(classes, sources)
    by_weight = Window.partitionBy("source").orderBy(F.desc("weight"))
    heavier = by_weight.rowsBetween(Window.unboundedPreceding, -1)
    lighter = by_weight.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("target") - F.lit(int(cap)) * F.coalesce(F.sum("words").over(heavier), F.lit(0))
    level = F.try_divide(left, F.sum(F.col("words") * F.col("weight")).over(lighter).cast("double"))
    levels = named.withColumn("level", level)
    first = F.max_by("level", F.when(F.col("level") * F.col("weight") <= cap, F.col("weight"))).alias("level")
    full = (F.col("target") >= F.lit(int(cap)) * F.col("source_size")) | F.col("level").isNull()
    expected = (
        F.when(F.col("source_size") == 0, F.lit(0.0))
        .when(full, F.lit(float(cap)))
        .otherwise(F.least(F.lit(float(cap)), F.col("level") * F.col("weight")))
    )
    certain = F.sum(F.col("words") * F.col("whole")).over(Window.partitionBy("source"))
    return (
        _with(named, levels.groupBy("source").agg(first))
        .withColumn("expected", expected)
        .withColumn("whole", F.floor("expected"))
        .withColumn("p", F.col("expected") - F.col("whole"))
        .withColumn("gap0", F.greatest(F.col("target") - certain, F.lit(0.0)))
        .select("source", "weight", "source_size", "target", "whole", "p", "gap0")
    )


def pareto_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    cap: int = 3,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, copies, taken, row``.

    ``carry`` names columns to bring along in a struct ``carried``, so that copies need no join to be made.

    A document's expected copies grow with the bit length of its size (``expected_copies``): longer documents are
    likelier, as they hold more connected text, but only by steps of one for each doubling. The whole part is
    certain copies; the fraction p is the inclusion chance of one more: the documents of a source are ranked by the odds of a
    repeatable uniform draw divided by the odds of their own p, and taken in that order while their words fit
    the rest of the target, so the sample's size is fixed in words. Documents larger than what is left are passed
    over and the ranking goes on with those that fit, ``PASSES`` times; at last one closing document is added if its
    size brings the source nearer to its target. ``taken`` is size times copies, at most ``cap`` of them.

    Sizes are words; null and empty texts have none and add nothing. Null sources form one
    source, ranked last. Equal ranks are ordered by draw, id, size and a hash of the row, so the result does not depend on
    the order of rows; rows that agree in all of these are interchangeable. Repeated rows are rows of their own.
    An empty table gives no rows; further columns are ignored. ``row`` numbers the input rows.

    A source's order is cut into slices of the rank. Whole slices are settled by a combining aggregate with
    a fixed number of rows per source; only the slice that holds the end of the sample is sorted, about
    one in ``SLICES`` of a source's documents.
    """
    size = word_count(F.col(text_col))
    read = write_once(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            size.alias("size"),
            F.length(F.bin(size)).alias("weight"),
            uniform(F.col(id_col)).alias("draw"),
            F.xxhash64(text_col, *carry).alias("tie"),
            F.monotonically_increasing_id().alias("row"),
            *([F.struct(*carry).alias("carried")] if carry else []),
        )
    )
    classes = write_once(read.groupBy("source", "weight").agg(F.sum("size").alias("words")))
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    plan = write_once(expected_copies(classes, targets, cap))
    state = plan.groupBy("source").agg(F.first("gap0").alias("gap0"))
    own = plan.select(F.col("source").alias("_of"), F.col("weight").alias("_weight"), "source_size", "target", "whole", "p")
    odds = F.try_divide(F.col("draw") / (1 - F.col("draw")), F.try_divide(F.col("p"), 1 - F.col("p")))
    rows = (
        read.join(own, F.col("source").eqNullSafe(F.col("_of")) & (F.col("weight") == F.col("_weight")))
        .withColumn("xi", odds)
        .withColumn("slice", F.floor(SLICES * (1 - 1 / (1 + F.col("xi")))).cast("int"))
    )
    place = F.struct("xi", "draw", "doc_id", "size", "tie", "row")
    taken = F.lit(False)
    for n in range(1, PASSES + 1):
        fits = (F.col("p") > 0) & ~taken & (F.col("size") <= F.col(f"gap{n - 1}"))
        state = write_once(_one_pass(rows, state, fits, place, n))
        cut, end = F.col(f"cut{n}"), F.col(f"end{n}")
        taken = taken | (
            (F.col("p") > 0)
            & (F.col("size") <= F.col(f"gap{n - 1}"))
            & (cut.isNull() | (F.col("slice") < cut) | ((F.col("slice") == cut) & F.coalesce(place <= end, F.lit(False))))
        )
    gap = F.col(f"gap{PASSES}")
    off = F.abs(F.col("size") - gap)
    closing = (
        _with(rows, state)
        .where((F.col("p") > 0) & ~taken & (off < gap))
        .groupBy("source")
        .agg(F.min(F.struct(off.alias("off"), "doc_id", "size", "tie", "row")).alias("c"))
        .select("source", F.col("c.row").alias("closing_row"))
    )
    closes = F.coalesce(F.col("row") == F.col("closing_row"), F.lit(False))
    return (
        _with(rows, write_once(_with(state, closing, "left")))
        .withColumn("copies", F.col("whole") + taken.cast("long") + closes.cast("long"))
        .withColumn("taken", F.col("size") * F.col("copies"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", "taken", "row", *(["carried"] if carry else []))
    )


def _one_pass(rows: DataFrame, state: DataFrame, fits: Column, place: Column, n: int) -> DataFrame:
    """The state with ``cut, end, gap`` of pass n: of the documents that ``fits`` holds for, ranked by odds, those whose
    words together stay within the gap before are all in slices before the cut, or in it up to the end.

    No cut means that all of them fit.
    """
    gap = F.col(f"gap{n - 1}")
    slices = _with(rows, state).where(fits).groupBy("source", "slice").agg(F.sum("size").alias("words"))
    so_far = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    over = _with(slices.withColumn("after", F.sum("words").over(so_far)), state)
    first = F.min(F.when(F.col("after") > gap, F.struct("slice", (F.col("after") - F.col("words")).alias("before"))))
    cuts = write_once(
        over.groupBy("source")
        .agg(first.alias("c"), F.sum("words").alias("_all"))
        .select("source", F.col("c.slice").alias(f"cut{n}"), F.col("c.before").alias("_before"), "_all")
    )
    state = _with(state, cuts, "left")
    order = Window.partitionBy("source").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        _with(rows, state)
        .where(fits & (F.col("slice") == F.col(f"cut{n}")))
        .withColumn("_through", F.col("_before") + F.sum("size").over(order))
        .where(F.col("_through") <= gap)
        .groupBy("source")
        .agg(F.max("_through").alias("_through"), F.max(place).alias(f"end{n}"))
    )
    words = F.coalesce("_through", "_before", "_all", F.lit(0))
    return _with(state, ends, "left").withColumn(f"gap{n}", gap - words).drop("_through", "_before", "_all")


def _with(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on ``source`` where null equals null."""
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")
