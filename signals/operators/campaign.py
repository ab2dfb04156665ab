"""Propensity model and the weekly campaign list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signals.columns import PROPENSITY_FEATURES, SCORE, TARGET, CustomerCols
from signals.functions.numeric import labelled_bin
from signals.operators.forest import fit_by_cells
from signals.operators.ranking import full_ranking, top_k
from signals.operators.tables import first_by_key, present, require_columns
from signals.sources.models import feature_list
from signals.sources.scratch import write_once

# Priority limits, labels and suggested actions of the campaign list.
PRIORITY_EDGES = (-1.0, 0.35, 0.60, 1.0)
PRIORITY_LABELS = ("Baixa", "Media", "Alta")
ACTION_DEFAULT = "Contato padrao"
ACTION_RELATIONSHIP = "Campanha de relacionamento"
ACTION_PREMIUM = "Oferta premium"
ACTION_WIN_BACK = "Reativacao imediata"
PREMIUM_MAX_RECENCY = 14
CAMPAIGN_SIZE = 100
# Training rows are dealt into this many parts at least, and into more from so many sample counts (one a row and tree) a part.
TRAINING_PARTS = 32
COUNTS_PER_PART = 15_000_000
# With more sample counts than this the forest is grown on counted cells instead of rows.
COUNTS_OF_ROWS = 100_000_000


def training_parts(rows: int, trees: int) -> int:
    """Parts of the training rows: the forest keeps a count for each tree with each row, and every part sends sums of every tree."""
    return max(TRAINING_PARTS, -(-rows * trees // COUNTS_PER_PART))


def fit_propensity(
    train: DataFrame,
    features: Sequence[str] = PROPENSITY_FEATURES,
    label: str = TARGET,
    trees: int = 300,
    depth: int = 8,
    seed: int = 42,
) -> PipelineModel:
    """M2: random forest on class-balanced weights ``n / (2 * n_class)``.

    Up to ``COUNTS_OF_ROWS`` the used columns are written once, so that the passes of the fit read them and not the whole plan.
    Rows are dealt by content into parts whose number follows from the rows and trees alone, which keeps a part bounded, all
    slots busy and the trees' samples the same on any cluster. Above that, equal rows after binning are counted (``fit_by_cells``):
    nothing as long as the rows is kept, and the rows are read three times, so ``train`` should be a stored table.
    """
    used = present(train, features)
    total, positive = train.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p")).alias("c")
    ).first()["c"]
    if not positive or positive == total:
        raise ValueError("training needs rows of both classes")
    forest = RandomForestClassifier(
        featuresCol="_features",
        labelCol=label,
        weightCol="_weight",
        numTrees=trees,
        maxDepth=depth,
        seed=seed,
        featureSubsetStrategy="sqrt",
    )
    if total * trees > COUNTS_OF_ROWS:
        return fit_by_cells(train, total, positive, used, label, forest)
    weight = F.when(F.col(label) == 1, total / (2.0 * positive)).otherwise(total / (2.0 * (total - positive)))
    stages = [VectorAssembler(inputCols=used, outputCol="_features"), forest]
    dealt = write_once(train.select(*used, label)).repartition(training_parts(total, trees), *used, label)
    return Pipeline(stages=stages).fit(dealt.withColumn("_weight", weight))


def score_with(model: PipelineModel, df: DataFrame, name: str = SCORE) -> DataFrame:
    """M3: probability of the positive class as one more column.

    A copy of the model scores. A forest just fitted holds its training summary and, in it, the session, which would travel with
    every task and can no longer be sent once anything was observed in that session; a copy holds neither.
    """
    require_columns(df, feature_list(model))
    out = model.copy().transform(df)
    return out.select(*df.columns, vector_to_array("probability")[1].alias(name))


def priority(score: Column) -> Column:
    """M5: Baixa, Media or Alta; null outside (-1, 1]."""
    return labelled_bin(score, PRIORITY_EDGES, PRIORITY_LABELS)


def suggested_action(level: Column, recency: Column) -> Column:
    """M6: the action for a priority; high priority splits at two weeks of recency."""
    return (
        F.when((level == "Alta") & (recency <= PREMIUM_MAX_RECENCY), ACTION_PREMIUM)
        .when((level == "Alta") & (recency > PREMIUM_MAX_RECENCY), ACTION_WIN_BACK)
        .when(level == "Media", ACTION_RELATIONSHIP)
        .otherwise(ACTION_DEFAULT)
    )


def _list_columns(df: DataFrame, key: str, name: str, score: str, features: Sequence[str]) -> DataFrame:
    level = priority(F.col(score))
    return df.withColumns(
        {"prioridade": level, "acao_sugerida": suggested_action(level, F.col("recency"))}
    ).select("rank", key, name, score, "prioridade", "acao_sugerida", *features)


def campaign_list(
    scored: DataFrame,
    customers: DataFrame,
    size: int = CAMPAIGN_SIZE,
    key: str = "id_cliente",
    score: str = SCORE,
    cols: CustomerCols = CustomerCols(),
    features: Sequence[str] = PROPENSITY_FEATURES,
) -> DataFrame:
    """M7: the ranked, named and segmented top of the list.

    Scores are ranked before names are looked up. The list is written once, its keys filter the customer
    scan, and only the matching names are deduplicated and joined; whether a side is broadcast is left to Spark, which
    knows the written list's size.
    """
    top = write_once(top_k(scored, score, key, size))
    wanted = top.select(F.col(key).alias(cols.customer))
    found = customers.select(cols.customer, cols.name).join(wanted, cols.customer, "left_semi")
    names = first_by_key(found, [cols.customer]).withColumnRenamed(cols.customer, key)
    return _list_columns(top.join(names, key, "left"), key, cols.name, score, features)


def scored_list(
    scored: DataFrame,
    customers: DataFrame,
    key: str = "id_cliente",
    score: str = SCORE,
    cols: CustomerCols = CustomerCols(),
    features: Sequence[str] = PROPENSITY_FEATURES,
) -> DataFrame:
    """The same columns for every scored customer (the whole scoring report)."""
    names = first_by_key(customers.select(cols.customer, cols.name), [cols.customer])
    ranked = full_ranking(scored, score, key)
    named = ranked.join(names.withColumnRenamed(cols.customer, key), key, "left")
    return _list_columns(named, key, cols.name, score, features)
