"""Ordered blocks, global ranks and ranking quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signals.functions.numeric import ratio
from signals.sources.scratch import write_once

_POSITION_BITS = (1 << 33) - 1


def recency_score(df: DataFrame, recency: str = "recency", name: str = "score_baseline") -> DataFrame:
    """M1: baseline score, larger for more recent customers, over the given set."""
    top = df.agg(F.max(recency).alias("m")).scalar()
    return df.withColumn(name, (top - F.col(recency)).cast("double"))


def ordered_blocks(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Globally sort into blocks and tag each row with ``_block`` and ``_position``.

    A range shuffle gives every task one contiguous block of the total order; with a key
    in ``order`` even a score shared by a third of the rows is cut into many blocks. The
    sampled block limits could differ between two evaluations, so the tagged rows are
    written once and every later step reads the same blocks.
    """
    tagged = df.orderBy(*order).withColumns(
        {
            "_block": F.spark_partition_id(),
            "_position": F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_BITS)) + 1,
        }
    )
    return write_once(tagged)


def full_ranking(df: DataFrame, score: str, key: str, name: str = "rank") -> DataFrame:
    """Rank 1..N by score descending, ties by key, without a single-task sort.

    Rank is the block's offset plus the position inside the block. The offsets are one row
    per block, that is at most one per shuffle partition, so they are safe to broadcast.
    """
    blocks = ordered_blocks(df, [F.col(score).desc(), F.col(key).asc()])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocks.groupBy("_block")
        .count()
        .select("_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        blocks.join(F.broadcast(offsets), "_block")
        .withColumn(name, F.col("_offset") + F.col("_position"))
        .select(name, *df.columns)
    )


def top_k(df: DataFrame, score: str, key: str, k: int, name: str = "rank") -> DataFrame:
    """O2: the k best rows with their rank: the score floor drops all rows that cannot be among them, the rest is ranked."""
    whole = df.withColumn("_all", F.lit(1))
    best = over_floor(whole, ["_all"], score, k).drop("_all")
    return full_ranking(best, score, key, name).where(F.col(name) <= k)


def long_scores(df: DataFrame, scores: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """One row per (row, strategy) from several score columns."""
    pairs = [F.struct(F.lit(s).alias("strategy"), F.col(c).cast("double").alias("score")) for s, c in scores.items()]
    return df.select(*keep, F.inline(F.array(*pairs)))


def rank_areas(df: DataFrame, label: str, score: str = "score", by: str = "strategy") -> DataFrame:
    """Average precision and ROC area of each strategy, ties grouped.

    Rows are first reduced to one per (strategy, distinct score), which takes care of
    heavily shared scores; the reduced rows are sorted into blocks, and running counts are
    block offsets (one row per strategy and block) plus running counts inside a block.
    ROC area is null when a class is absent; average precision is 0 without positives.
    """
    per_score = df.groupBy(by, score).agg(
        F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("n")
    )
    blocks = ordered_blocks(per_score, [F.col(by).asc(), F.col(score).desc()])
    whole = Window.partitionBy(by)
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocks.groupBy(by, "_block")
        .agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
        .select(
            by,
            "_block",
            F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("p_before"),
            F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n_before"),
            F.sum("bp").over(whole).alias("p_all"),
            F.sum("bn").over(whole).alias("n_all"),
        )
    )
    inside = (
        Window.partitionBy(by, "_block")
        .orderBy(F.col(score).desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = (
        blocks.withColumns({"tp": F.sum("p").over(inside), "nn": F.sum("n").over(inside)})
        .join(F.broadcast(offsets), [by, "_block"])
        .withColumns({"tp": F.col("tp") + F.col("p_before"), "nn": F.col("nn") + F.col("n_before")})
    )
    p, n, tp, nn, pos, all_ = (F.col(c).cast("double") for c in ("p", "n", "tp", "nn", "p_all", "n_all"))
    return running.groupBy(by).agg(
        F.coalesce(F.sum(ratio(p * tp, pos * nn)), F.lit(0.0)).alias("pr_auc"),
        F.sum(ratio((n - p) * (tp - p / 2), (all_ - pos) * pos)).alias("roc_auc"),
    )


def group_ranking(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "_rn") -> DataFrame:
    """Rank 1..n inside every group without sorting a whole group in one task.

    Rows are sorted into blocks by group and order, so a hot group covers many blocks. A
    rank is the group's rows in earlier blocks plus the place inside this block's part of
    the group. The part table has one row per (group, block) that meet.
    """
    blocks = ordered_blocks(df, [*[F.col(c).asc() for c in by], *order])
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        blocks.groupBy(*by, "_block")
        .agg(F.count(F.lit(1)).alias("_size"), F.min("_position").alias("_first"))
        .withColumn("_shift", F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first") + 1)
        .select(*by, "_block", "_shift")
    )
    ranked = _match(blocks, parts, [*by, "_block"]).withColumn(name, F.col("_position") + F.col("_shift"))
    return ranked.select(*df.columns, name)


def score_floors(
    df: DataFrame, by: Sequence[str], score: str, k: int, bins: int = 256, rounds: int = 6, spare: int = 100_000
) -> DataFrame:
    """``by, floor`` for each group of more than k scores: at least k rows of the group have that score or more.

    The interval that holds the k-th score starts as a group's whole range. Each round is one combining aggregate, a
    histogram of the scores in the interval, and narrows it to the bin with the k-th score, by that bin's own
    least and greatest score. Rounds end when the rows over all floors are at most twice those wanted and ``spare`` more, or
    when every interval is a single score. More rounds make the floor tighter and change nothing else.
    """
    value = F.col(score).cast("double")
    state = write_once(
        df.where(F.col(score).isNotNull() & ~F.isnan(value))
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("held"), F.min(value).alias("low"), F.max(value).alias("high"))
        .where(F.col("held") > k)
        .withColumn("above", F.lit(0).cast("long"))
    )
    for _ in range(rounds):
        held, groups, open_ = state.agg(F.coalesce(F.sum("held"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("low") < F.col("high"))).first()
        if not open_ or held <= 2 * k * groups + spare:
            break
        width = F.col("high") - F.col("low")
        place = F.least(F.lit(bins - 1), F.floor(F.try_divide((value - F.col("low")) * bins, width)))
        inside = _match(df.select(*by, score), state, by).where(value.between(F.col("low"), F.col("high")))
        counts = inside.groupBy(*by, F.coalesce(place, F.lit(0)).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.first("above").alias("above")
        )
        down = Window.partitionBy(*by).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        running = counts.withColumn("held", F.col("above") + F.sum("n").over(down))
        found = F.struct("low", "high", "held", (F.col("held") - F.col("n")).alias("above"))
        state = write_once(
            running.groupBy(*by).agg(F.max_by(found, F.when(F.col("held") >= k, F.col("bin"))).alias("f")).select(*by, "f.*")
        )
    return state.select(*by, F.col("low").alias("floor"))


def over_floor(df: DataFrame, by: Sequence[str], score: str, k: int) -> DataFrame:
    """The rows that can be among the k best of their group: all of a small group, else those on or over its score floor."""
    floors = score_floors(df, by, score, k)
    near = _match(df, floors, by, "left").where(F.col("floor").isNull() | (F.col(score).cast("double") >= F.col("floor")))
    return near.select(*df.columns)


def _match(df: DataFrame, groups: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on the group columns where null equals null; the group's other columns are added."""
    other = groups.withColumnsRenamed({c: f"_of_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return df.join(other, same, how).drop(*[f"_of_{c}" for c in by])


def top_rows(df: DataFrame, by: Sequence[str], score: str, key: Sequence[str], k: int) -> DataFrame:
    """O3: the k best rows of every group, numbered ``_rn``.

    A floor found by refining score histograms leaves about k rows a group and those that share the k-th score; these are
    ranked in blocks. So neither a group of all rows nor a score that a third of them share meets in one task.
    """
    order = [F.col(score).desc(), *[F.col(c).asc() for c in key]]
    return group_ranking(over_floor(df, by, score, k), by, order).filter(F.col("_rn") <= k)
