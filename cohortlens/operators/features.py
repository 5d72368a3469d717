"""Feature engineering and preprocessing as Spark ML stages.

Every stage is made of column expressions. Fitting reads small aggregates (medians,
modes, moments, levels) into the model; applying it is one projection, and a join with its stored
dictionary for each category of many levels.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions.columns import add_all, clip, row_std
from cohortlens.operators.ordered import bucket_count
from cohortlens.operators.profile import long_texts, medians
from cohortlens.operators.project import clip_columns
from cohortlens.schema import (CATEGORICAL_FEATURES, CLIP_RANGES, CONSISTENCY_COLUMNS, ENGAGEMENT_CAPS, ENGAGEMENT_PCT,
                               NUMERIC_FEATURES)
from cohortlens.session import materialize, shared_dir

ENGINEERED = ["attendance_study_interaction", "performance_consistency", "engagement_score"]
#: Levels up to which a category is one column each; beyond it a stored dictionary numbers them for sparse vectors.
DENSE_LEVELS = 1000


class _Stage(DefaultParamsReadable, DefaultParamsWritable):
    """Parameters that survive saving."""


class FeatureSelector(Transformer, _Stage):
    """Keep the named columns, in that order."""

    columns = Param(Params._dummy(), "columns", "columns to keep", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.select(*self.getOrDefault(self.columns))


class OutlierClipper(Transformer, _Stage):
    """Bound columns to fixed ranges; columns the table lacks are skipped."""

    ranges = Param(Params._dummy(), "ranges", "JSON of column -> [low, high]", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, ranges: str | None = None) -> None:
        super().__init__()
        self._setDefault(ranges=json.dumps(CLIP_RANGES))
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return clip_columns(dataset, json.loads(self.getOrDefault(self.ranges)))


def interaction() -> Column:
    return F.col("attendance_pct") * F.col("study_hours_wk") / 100


def consistency(columns: Sequence[str] = tuple(CONSISTENCY_COLUMNS)) -> Column:
    """Sample standard deviation of the marks of one row."""
    return row_std([F.col(c) for c in columns])


def engagement(columns: Sequence[str]) -> Column:
    """Mean of the available activity shares; the submission share is not bounded."""
    parts = [clip(F.col(c) / cap, 0.0, 1.0) for c, cap in ENGAGEMENT_CAPS.items() if c in columns]
    if ENGAGEMENT_PCT in columns:
        parts.append(F.col(ENGAGEMENT_PCT) / 100)
    return add_all(parts) / len(parts)


class FeatureEngineer(Transformer, _Stage):
    """Add the engineered columns whose inputs exist."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        have = dataset.columns
        new = {}
        if "attendance_pct" in have and "study_hours_wk" in have:
            new["attendance_study_interaction"] = interaction()
        marks = [c for c in CONSISTENCY_COLUMNS if c in have]
        if len(marks) >= 2:
            new["performance_consistency"] = consistency(marks)
        if any(c in have for c in [*ENGAGEMENT_CAPS, ENGAGEMENT_PCT]):
            new["engagement_score"] = engagement(have)
        return dataset.withColumns(new) if new else dataset


def flat_name(column: str, level: str | None = None) -> str:
    return column if level is None else f"{column}_{level}"


def store_levels(values: DataFrame) -> str:
    """Number distinct ``value`` from 0 without gaps and store (value, id); the folder's path.

    Values are dealt into ranges of a hash, numbered inside each, and each range starts where those before it end.
    """
    spread = values.select("value", F.pmod(F.xxhash64("value"), F.lit(bucket_count(values))).cast("int").alias("bucket"))
    starts = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("start"))
    first = F.element_at(starts.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "start")))).scalar(), F.col("bucket"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("value"))
    path = shared_dir(values.sparkSession, "level-ids")
    spread.withColumn("start", first).select("value", (F.col("start") + inside - 1).alias("id")).write.parquet(path)
    return path


class _PreprocessorParams(Params):
    numeric = Param(Params._dummy(), "numeric", "numeric columns", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "categorical columns", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)


class Preprocessor(Estimator, _PreprocessorParams, _Stage):
    """Clip, impute by the median and standardize; impute by the mode and one-hot encode."""

    @keyword_only
    def __init__(self, *, numeric: list[str] | None = None, categorical: list[str] | None = None,
                 outputCol: str | None = None) -> None:
        super().__init__()
        self._setDefault(numeric=NUMERIC_FEATURES, categorical=CATEGORICAL_FEATURES, outputCol="features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> PreprocessorModel:
        numeric, categorical = self.getOrDefault(self.numeric), self.getOrDefault(self.categorical)
        missing = [c for c in [*numeric, *categorical] if c not in dataset.columns]
        if missing:
            raise ValueError(f"Missing feature columns: {missing}")
        fitted: dict[str, dict] = {}
        if numeric:
            clipped = clip_columns(dataset.select(*numeric))
            middle = {r.feature: r.median for r in medians(clipped, numeric).collect()}
            empty = [c for c in numeric if c not in middle]
            if empty:
                raise ValueError(f"No values to fit in: {empty}")
            filled = clipped.select(*[F.coalesce(F.col(c).cast("double"), F.lit(middle[c])).alias(c) for c in numeric])
            stats = filled.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(numeric)],
                               *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(numeric)]).first()
            for i, c in enumerate(numeric):
                # A constant column is only centred.
                fitted[c] = {"median": middle[c], "mean": stats[f"m{i}"], "std": stats[f"s{i}"] or 1.0}
        if categorical:
            counts = materialize(long_texts(dataset, categorical).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")), "levels")
            modes = {r["feature"]: r for r in counts.groupBy("feature").agg(
                F.count(F.lit(1)).alias("size"), F.min(F.struct((-F.col("n")).alias("rank"), "value")).alias("best")).collect()}
            missing = [c for c in categorical if c not in modes]
            if missing:
                raise ValueError(f"No values to fit in: {missing}")
            few = [c for c in categorical if modes[c]["size"] <= DENSE_LEVELS]
            # At most DENSE_LEVELS rows for each column.
            levels = counts.filter(F.col("feature").isin(few)).collect() if few else []
            for c in categorical:
                fitted[c] = {"mode": modes[c]["best"]["value"]}
                if c in few:
                    fitted[c]["levels"] = sorted(r["value"] for r in levels if r["feature"] == c)
                else:
                    fitted[c] |= {"table": store_levels(counts.filter(F.col("feature") == c)), "size": modes[c]["size"]}
        model = PreprocessorModel(numeric=numeric, categorical=categorical, outputCol=self.getOrDefault(self.outputCol),
                                  fitted=json.dumps(fitted))
        return model


class PreprocessorModel(Model, _PreprocessorParams, _Stage):
    """Fitted constants as JSON; ``flat`` gives one column per feature, ``transform`` a vector."""

    fitted = Param(Params._dummy(), "fitted", "JSON of fitted constants", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, numeric: list[str] | None = None, categorical: list[str] | None = None,
                 outputCol: str | None = None, fitted: str | None = None) -> None:
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def constants(self) -> dict[str, dict]:
        return json.loads(self.getOrDefault(self.fitted))

    def imputed(self) -> dict[str, Column]:
        """Clipped and filled numeric columns, filled categorical ones."""
        fitted = self.constants()
        out = {}
        for c in self.getOrDefault(self.numeric):
            value = F.col(c).cast("double")
            bounded = clip(value, *CLIP_RANGES[c]) if c in CLIP_RANGES else value
            out[c] = F.coalesce(bounded, F.lit(fitted[c]["median"]))
        for c in self.getOrDefault(self.categorical):
            out[c] = F.coalesce(F.col(c), F.lit(fitted[c]["mode"]))
        return out

    def feature_columns(self) -> dict[str, Column]:
        """Feature name -> expression: standardized numbers, then one flag per level."""
        fitted, filled = self.constants(), self.imputed()
        out = {}
        for c in self.getOrDefault(self.numeric):
            out[c] = (filled[c] - fitted[c]["mean"]) / fitted[c]["std"]
        for c in self.getOrDefault(self.categorical):
            for level in fitted[c].get("levels", []):
                out[flat_name(c, level)] = (filled[c] == level).cast("double")
        return out

    def numbered(self) -> dict[str, dict]:
        """Categories whose levels are numbered by a stored dictionary."""
        return {c: fact for c, fact in self.constants().items() if "table" in fact}

    def feature_names(self) -> list[str]:
        """Names behind the vector; a category with a dictionary has one name for its whole part of it."""
        return [*self.feature_columns(), *[f"{c}[{fact['size']}]" for c, fact in self.numbered().items()]]

    def flat(self, dataset: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        if self.numbered():
            raise ValueError(f"too many levels for a column each: {list(self.numbered())}; use transform")
        return dataset.select(*keep, *[col.alias(name) for name, col in self.feature_columns().items()])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns, filled = self.feature_columns(), self.imputed()
        names = [f"__f{i}" for i in range(len(columns))]
        wide = dataset.select("*", *[col.alias(n) for n, col in zip(names, columns.values())])
        for i, (c, fact) in enumerate(self.numbered().items()):
            # An unknown level has the number after the last, which the encoder drops: a part of zeros.
            table = dataset.sparkSession.read.parquet(fact["table"]).select(F.col("value").alias(f"__v{i}"), F.col("id").alias(f"__i{i}"))
            place = F.coalesce(F.col(f"__i{i}"), F.lit(fact["size"])).cast("double")
            nominal = {"ml_attr": {"type": "nominal", "num_vals": fact["size"] + 1}}
            wide = wide.withColumn(f"__v{i}_", filled[c].cast("string")).join(table, F.col(f"__v{i}_") == F.col(f"__v{i}"), "left").withColumn(
                f"__n{i}", place.alias(f"__n{i}", metadata=nominal)).drop(f"__v{i}", f"__v{i}_", f"__i{i}")
            encoder = OneHotEncoder(inputCol=f"__n{i}", outputCol=f"__s{i}", dropLast=True)
            wide = encoder.fit(wide).transform(wide).drop(f"__n{i}")
            names.append(f"__s{i}")
        return VectorAssembler(inputCols=names, outputCol=self.getOrDefault(self.outputCol)).transform(wide).drop(*names)
