"""Saving and loading fitted models."""

from __future__ import annotations

import logging

from pyspark.ml import PipelineModel

log = logging.getLogger(__name__)


def artifact_name(model_name: str) -> str:
    """Folder name for a model, e.g. ``baseline_random_forest``."""
    return "baseline_" + model_name.lower().replace(" ", "_")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def try_load_model(path: str) -> PipelineModel | None:
    """The model, or None (with the reason logged) when it cannot be loaded."""
    try:
        return load_model(path)
    except Exception as err:
        log.error("model not loaded from %s: %s", path, err)
        return None
