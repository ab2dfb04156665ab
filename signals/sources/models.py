"""Model files."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, VectorAssembler


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def feature_list(model: PipelineModel, default: tuple[str, ...] = ()) -> list[str]:
    """M4: the input columns travel inside the model as its assembler stage, or as the stage that bins them before."""
    for stage in model.stages:
        if isinstance(stage, (Bucketizer, VectorAssembler)):
            return list(stage.getInputCols())
    return list(default)
