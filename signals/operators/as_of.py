"""Attributes as they were known at a moment: an as-of join without a range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signals.operators.ranking import ordered_blocks


def attributes_as_of(
    rows: DataFrame,
    history: DataFrame,
    key: str,
    at: str,
    since: str,
    attributes: Sequence[str],
    history_key: str | None = None,
    order: Sequence[str] = (),
    max_age_days: int | None = None,
    known_at: str | None = None,
) -> DataFrame:
    """All ``rows`` with the attributes of the newest ``history`` row of their key at or before ``at``.

    ``since`` is when a history row became known; of several of one moment the largest by ``order``, then by the attributes
    counts. Attributes are null where nothing was known, and, with ``max_age_days``, where it is older. ``known_at`` names a column
    for the moment itself. Null keys and moments match nothing; repeated rows keep a row each.

    Rows and history are sorted together into blocks by (key, moment), history first, and the last known value is carried
    forward inside a block; what a block starts with comes from the last history row of the blocks before. A key with a
    third of all rows fills many blocks, and no row meets more than one value.
    """
    clash = [c for c in (*attributes, *([known_at] if known_at else [])) if c in rows.columns]
    if clash:
        raise ValueError(f"columns {clash} are there already")
    moment = lambda c: F.col(c).cast("timestamp_ntz")
    value = F.struct(moment(since).alias("_at"), *attributes)
    named = history.where(F.col(history_key or key).isNotNull() & F.col(since).isNotNull())
    newest = named.groupBy(F.col(history_key or key).alias("_key"), moment(since).alias("_time")).agg(
        F.max_by(value, F.struct(*order, *attributes)).alias("_value")
    )
    asked = rows.select(F.col(key).alias("_key"), moment(at).alias("_time"), F.struct(*rows.columns).alias("_row"))
    kind, held = asked.schema["_row"].dataType, newest.schema["_value"].dataType
    both = newest.select("_key", "_time", F.lit(0).alias("_side"), F.lit(None).cast(kind).alias("_row"), "_value").unionByName(
        asked.select("_key", "_time", F.lit(1).alias("_side"), "_row", F.lit(None).cast(held).alias("_value"))
    )
    blocks = ordered_blocks(both, [F.col("_key"), F.col("_time"), F.col("_side")])
    inside = Window.partitionBy("_key", "_block").orderBy("_position").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = blocks.groupBy("_key", "_block").agg(
        F.max_by("_value", F.when(F.col("_side") == 0, F.col("_position"))).alias("_end")
    )
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).where(F.col("_carried").isNotNull())
    known = blocks.withColumn("_own", F.last("_value", ignorenulls=True).over(inside)).where(F.col("_side") == 1)
    found = known.join(carried.select("_key", "_block", "_carried"), ["_key", "_block"], "left").withColumn(
        "_found", F.coalesce("_own", "_carried")
    )
    usable = F.col("_key").isNotNull() & F.col("_time").isNotNull() & F.col("_found").isNotNull()
    if max_age_days is not None:
        oldest = F.col("_time") - F.make_dt_interval(F.lit(max_age_days))
        usable = usable & (F.col("_found._at") >= oldest)
    picked = [F.when(usable, F.col(f"_found.{c}")).alias(c) for c in attributes]
    if known_at:
        picked.append(F.when(usable, F.col("_found._at")).alias(known_at))
    return found.select("_row.*", *picked)
