"""Fitted parameters on streaming frames: every transform is a stateless projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from statframe.operators import prep


def transform_stream(stream: DataFrame, models: Sequence) -> DataFrame:
    """Apply fitted models (scaler, clipper, PCA, VIF selector) in order."""
    for m in models:
        stream = m.transform(stream)
    return stream


def predict_stream(stream: DataFrame, fit, recipe: dict | None = None, **kw) -> DataFrame:
    """Predictions of an OLS or logit fit, after an optional recipe of derived columns."""
    return fit.predict(prep.apply_recipe(stream, recipe) if recipe else stream, **kw)
