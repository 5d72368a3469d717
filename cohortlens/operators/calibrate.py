"""Isotonic calibration over folds.

Pools of equal calibrated score are found range by range of the raw score, and merge: two neighbouring
ranges become one whose pools are those of both, with what is out of order at the seam pooled. Ranges
merge in pairs, level by level, each pair in a task of its own; the driver sees the steps of the curve only.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Model, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from cohortlens.operators.models import Builder, fit_together, pass_probability, prepare, score
from cohortlens.operators.ordered import bucket_count, with_buckets
from cohortlens.operators.split import with_folds
from cohortlens.schema import LABEL
from cohortlens.session import materialize, share_package

POOLS = "range long, low array<double>, high array<double>, mass array<double>, weight array<double>"


class Curve(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """A rising curve: straight between its points, level beyond them. Null scores, and all scores of a curve without points, give null."""

    scores = Param(Params._dummy(), "scores", "ascending scores", TypeConverters.toListFloat)
    values = Param(Params._dummy(), "values", "values at these scores", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, scores: list[float] | None = None, values: list[float] | None = None) -> None:
        super().__init__()
        self._set(featuresCol="probability", predictionCol="prediction", **{k: v for k, v in self._input_kwargs.items() if v is not None})

    def setFeaturesCol(self, name: str) -> Curve:
        return self._set(featuresCol=name)

    def setPredictionCol(self, name: str) -> Curve:
        return self._set(predictionCol=name)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x, y = np.array(self.getOrDefault(self.scores)), np.array(self.getOrDefault(self.values))
        share_package(dataset.sparkSession)

        @F.pandas_udf("double")
        def read(scores: pd.Series) -> pd.Series:
            found = np.interp(scores.to_numpy(float), x, y) if len(x) else np.full(len(scores), np.nan)
            return pd.Series(found).where(scores.notna().to_numpy() & bool(len(x)), None)

        return dataset.withColumn(self.getPredictionCol(), read(F.col(self.getFeaturesCol()).cast("double")))


def pooled(low: list, high: list, mass: list, weight: list) -> tuple[list, list, list, list]:
    """Merge neighbours, in the order of their scores, until means rise."""
    out: list[list[float]] = []
    for pool in zip(low, high, mass, weight):
        out.append(list(pool))
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, top, m, w = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = top, out[-1][2] + m, out[-1][3] + w
    return tuple(list(c) for c in zip(*out)) if out else ([], [], [], [])


@dataclass
class CalibratedModel:
    """Pairs of base model and calibration curve; the score is their mean."""

    parts: list[tuple[PipelineModel, Curve]]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability``, the mean calibrated score. One pass over the rows, no join."""
        keep = df.columns
        for i, (base, curve) in enumerate(self.parts):
            scored = base.transform(df).select(*df.columns, pass_probability().alias("__raw"))
            df = curve.setFeaturesCol("__raw").setPredictionCol(f"__p{i}").transform(scored).drop("__raw")
        mean = sum((F.col(f"__p{i}") for i in range(1, len(self.parts))), F.col("__p0")) / len(self.parts)
        return df.select(*keep, mean.alias("probability"))

    def save(self, path: str) -> None:
        for i, (base, curve) in enumerate(self.parts):
            base.write().overwrite().save(f"{path}/base-{i}")
            curve.write().overwrite().save(f"{path}/curve-{i}")

    @classmethod
    def load(cls, path: str, folds: int = 3) -> CalibratedModel:
        return cls([(PipelineModel.load(f"{path}/base-{i}"), Curve.load(f"{path}/curve-{i}"))
                    for i in range(folds)])


def fit_curve(scored: DataFrame, label: str = LABEL, probability: str = "probability", ranges: int | None = None) -> Curve:
    """Isotonic curve of label on score; rows without either are left out.

    Rows of one score fold into a weighted point before anything else, so ties and hot scores are one point.
    """
    spark = scored.sparkSession
    share_package(spark)
    ranges = ranges or bucket_count(scored)
    points = scored.filter(F.col(probability).isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col(probability).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("double")).alias("mass"), F.count(F.lit(1)).cast("double").alias("weight"))

    def pool(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("score")
        found = pooled(rows["score"], rows["score"], rows["mass"], rows["weight"])
        return pd.DataFrame({"range": [rows["bucket"].iloc[0]], **{n: [c] for n, c in zip(("low", "high", "mass", "weight"), found)}})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("range")
        joined = [np.concatenate(rows[n].tolist()) for n in ("low", "high", "mass", "weight")]
        return pd.DataFrame({"range": [rows["range"].iloc[0] // 2], **{n: [c] for n, c in zip(("low", "high", "mass", "weight"), pooled(*joined))}})

    bucketed = with_buckets(points, "score", ["weight"], buckets=ranges).select("bucket", "score", "mass", "weight")
    pools = bucketed.groupBy("bucket").applyInPandas(pool, POOLS)
    for _ in range(max(0, (ranges - 1).bit_length())):
        pools = pools.groupBy(F.expr("range div 2").alias("pair")).applyInPandas(merge, POOLS)
    last = pools.collect()  # one row: the steps of the curve
    if not last:
        return Curve(scores=[], values=[])
    row = last[0]
    scores, values = [], []
    for low, high, mass, weight in zip(row["low"], row["high"], row["mass"], row["weight"]):
        scores += [low] if low == high else [low, high]
        values += [mass / weight] * (1 if low == high else 2)
    return Curve(scores=scores, values=values)


def fit_calibrated(df: DataFrame, key: str, build: Builder, label: str = LABEL, folds: int = 3) -> CalibratedModel:
    """Per fold: the base model learns from the other folds, its curve from this one. The base models of all folds are fitted together."""
    table = materialize(with_folds(df, label, key, folds, name="__fold"), "folds", partition_by="__fold")
    # Each step is a chain of short jobs, so the folds run side by side.
    with ThreadPoolExecutor(min(folds, 4)) as pool:
        prepared = dict(enumerate(pool.map(
            lambda fold: prepare(table.filter(F.col("__fold") != fold).drop("__fold"), label, store=True), range(folds))))
        fitted = fit_together(prepared, {"base": build})

        def calibrated(fold: int) -> tuple[PipelineModel, Curve]:
            base = fitted["base", fold]
            # Stored, as limits and pools both read it.
            held_out = materialize(score(base, table.filter(F.col("__fold") == fold), [label]), "held-out")
            return base, fit_curve(held_out, label)

        return CalibratedModel(list(pool.map(calibrated, range(folds))))
