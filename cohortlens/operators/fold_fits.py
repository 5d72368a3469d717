"""Naive Bayes and logistic regression of all folds from shared sums.

A fold's training rows are all rows less its own, so sums kept by fold and class give every fold's
moments at once. Missing numbers enter a fold's sums as so many times its median, so the sums need no
imputed copy of the table. Logistic regression takes Newton steps on weighted Gram matrices, one scan of
the prepared rows for each step of all fits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.functions.columns import add_all, clip
from cohortlens.operators.ordered import quantiles
from cohortlens.schema import CLIP_RANGES
from cohortlens.session import share_package

#: Added to every variance, as a share of the largest.
SMOOTHING = 1e-9
#: Newton steps end when the loss falls by less than this share of itself.
TOLERANCE = 1e-12


def moment_columns(columns: Sequence[str]) -> list[Column]:
    """Count, mean and mean square distance of each bounded number."""
    out = []
    for i, c in enumerate(columns):
        value = F.col(c).cast("double")
        bounded = clip(value, *CLIP_RANGES[c]) if c in CLIP_RANGES else value
        out += [F.count(bounded).alias(f"n{i}"), F.avg(bounded).alias(f"m{i}"), F.var_pop(bounded).alias(f"v{i}")]
    return out


def pooled(n: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Moments of several groups of rows together; the first axis is the group."""
    total = n.sum(axis=0)
    centre = np.divide((n * mean).sum(axis=0), total, out=np.zeros(mean.shape[1:]), where=total > 0)
    spread = (n * (var + (mean - centre) ** 2)).sum(axis=0)
    return total, centre, np.divide(spread, total, out=np.zeros(mean.shape[1:]), where=total > 0)


def naive_bayes_folds(df: DataFrame, fold: str, label: str, numeric: Sequence[str], levels: dict[str, list[str]]) -> DataFrame:
    """(all columns, probability): each row scored by the Gaussian naive Bayes fit on the other folds.

    One scan sums by fold and class, one finds the medians without each fold. Numbers are bounded and
    imputed by the median, categories by the most frequent level of the fold's training rows; ``levels``
    lists the levels that are flags. Rows without a label are scored, not learned from. Affine scaling changes
    nothing but the smoothing, which takes the largest variance after standardising.
    """
    labelled = df.filter(F.col(label).isNotNull())
    flags = [(c, level) for c, own in levels.items() for level in own]
    counts = labelled.groupBy(fold, label).agg(
        F.count(F.lit(1)).alias("n"), *moment_columns(numeric),
        *[F.count_if(F.col(c) == level).alias(f"l{i}") for i, (c, level) in enumerate(flags)]).collect()  # folds times classes
    folds = sorted({r[fold] for r in counts})
    if len(folds) < 2:
        raise ValueError("need two folds to learn from the others")
    others = F.array_remove(F.array(*map(F.lit, folds)), F.col(fold))
    bounded = [(clip(F.col(c).cast("double"), *CLIP_RANGES[c]) if c in CLIP_RANGES else F.col(c).cast("double")).alias(c) for c in numeric]
    middle = {(r["without"], r["feature"]): r["q0"] for r in quantiles(
        labelled.select(*bounded, F.explode(others).alias("without")), numeric, [0.5], ["without"]).collect()}
    models = {f: fold_model([r for r in counts if r[fold] != f], label, numeric, flags, {c: middle.get((f, c), 0.0) for c in numeric})
              for f in folds}
    return df.withColumn("probability", fold_probability(models, fold, numeric, flags))


def fold_model(rows: list, label: str, numeric: Sequence[str], flags: list[tuple[str, str]], median: dict[str, float]) -> dict:
    """Means, variances and log share of each class, and what missing values become."""
    size = len(numeric)
    classes = sorted({r[label] for r in rows})
    total_levels = {cl: sum(r[f"l{i}"] for r in rows) for i, cl in enumerate(flags)}
    mode = {}
    for c, level in flags:
        if c not in mode or total_levels[c, level] > total_levels[c, mode[c]]:
            mode[c] = level
    fill = np.array([median[c] for c in numeric])
    parts = []
    for row in rows:
        n = float(row["n"])
        have = np.array([row[f"n{i}"] for i in range(size)], float)
        mean = np.array([row[f"m{i}"] or 0.0 for i in range(size)])
        var = np.array([row[f"v{i}"] or 0.0 for i in range(size)])
        _, m, v = pooled(np.stack([have, n - have]), np.stack([mean, fill]), np.stack([var, np.zeros(size)]))
        share = np.array([row[f"l{i}"] for i in range(len(flags))], float)
        for c in mode:
            own = [i for i, (name, _) in enumerate(flags) if name == c]
            share[flags.index((c, mode[c]))] += n - share[own].sum()
        share /= n
        parts.append((row[label], n, np.concatenate([m, share]), np.concatenate([v, share * (1 - share)])))
    every = lambda own: pooled(*(np.stack([np.broadcast_to(p[i], p[2].shape) for p in own]) for i in (1, 2, 3)))
    _, centre, spread = every(parts)
    # Numbers are standardised by the moments of all training rows; flags stay as they are.
    scale = np.where(np.arange(len(centre)) < size, np.where(spread > 0, np.sqrt(spread), 1.0), 1.0)
    smooth = SMOOTHING * (spread / scale**2).max()
    whole = sum(p[1] for p in parts)
    out = {"median": fill, "mode": mode, "scale": scale, "classes": {}}
    for k in classes:
        own = [p for p in parts if p[0] == k]
        _, mean, var = every(own)
        out["classes"][int(k)] = (mean, var / scale**2 + smooth, math.log(sum(p[1] for p in own) / whole))
    return out


def fold_probability(models: dict, fold: str, numeric: Sequence[str], flags: list[tuple[str, str]]) -> Column:
    """Probability of class 1 by the model of the row's fold; the constants of a fold are arrays."""
    def value(model: dict, i: int) -> Column:
        if i < len(numeric):
            c = numeric[i]
            number = F.col(c).cast("double")
            return F.coalesce(clip(number, *CLIP_RANGES[c]) if c in CLIP_RANGES else number, F.lit(float(model["median"][i])))
        c, level = flags[i - len(numeric)]
        return (F.coalesce(F.col(c), F.lit(model["mode"][c])) == level).cast("double")

    def log_odds(model: dict) -> Column:
        if set(model["classes"]) != {0, 1}:
            return F.lit(700.0 if 1 in model["classes"] else -700.0)
        logs = {}
        for k, (mean, var, share) in model["classes"].items():
            terms = []
            for i in range(len(mean)):
                off = (value(model, i) - float(mean[i])) / float(model["scale"][i])
                terms.append(off * off / float(var[i]) + math.log(var[i]))
            logs[k] = F.lit(share) - add_all(terms) / 2
        return F.greatest(F.least(logs[1] - logs[0], F.lit(700.0)), F.lit(-700.0))

    out = None
    for f, model in models.items():
        chance = 1 / (1 + F.exp(-log_odds(model)))
        out = F.when(F.col(fold) == f, chance) if out is None else out.when(F.col(fold) == f, chance)
    return out


class LinearModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` of both classes to rows with a feature vector, by expressions."""

    weights = Param(Params._dummy(), "weights", "coefficients, the intercept last", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, weights: list[float] | None = None, featuresCol: str = "features") -> None:
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def margin(self) -> Column:
        *coefficients, intercept = self.getOrDefault(self.weights)
        products = F.zip_with(vector_to_array(F.col(self.getFeaturesCol())), F.array(*map(F.lit, coefficients)), lambda x, b: x * b)
        return F.aggregate(products, F.lit(intercept), lambda a, x: a + x)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        bounded = F.greatest(F.least(self.margin(), F.lit(700.0)), F.lit(-700.0))
        p = 1 / (1 + F.exp(-bounded))
        return dataset.withColumn("probability", array_to_vector(F.array(1 - p, p)))


class NewtonLogistic(Estimator, HasFeaturesCol, HasLabelCol, HasMaxIter, HasWeightCol):
    """L2 logistic regression as a pipeline stage: the summed weighted loss plus |coefficients|^2 / (2 C). ``fit_logistic`` fits many together."""

    def __init__(self, c: float, iterations: int, labelCol: str, weightCol: str, featuresCol: str = "features") -> None:
        super().__init__()
        self.c = c
        self._set(maxIter=iterations, labelCol=labelCol, weightCol=weightCol, featuresCol=featuresCol)

    def _fit(self, dataset: DataFrame) -> LinearModel:
        return fit_logistic([dataset], self)[0]


def fit_logistic(tables: Sequence[DataFrame], stage: NewtonLogistic) -> list[LinearModel]:
    """One model for each table; every scan serves a Newton step of all that have not converged."""
    share_package(tables[0].sparkSession)
    rows = None
    for tag, table in enumerate(tables):
        own = table.select(F.lit(tag).alias("tag"), F.col(stage.getLabelCol()).cast("double").alias("y"),
                           F.col(stage.getWeightCol()).cast("double").alias("w"), vector_to_array(F.col(stage.getFeaturesCol())).alias("x"))
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.filter("y IS NOT NULL AND w IS NOT NULL AND x IS NOT NULL")
    widths = {r["tag"]: r["width"] for r in rows.groupBy("tag").agg(F.max(F.size("x")).alias("width")).collect()}
    beta = {t: np.zeros(w + 1) for t, w in widths.items()}
    best: dict[int, tuple[float, np.ndarray]] = {}
    step = {t: np.zeros(w + 1) for t, w in widths.items()}
    live = set(widths)
    for _ in range(stage.getMaxIter()):
        if not live:
            break
        sums = gram_sums(rows.filter(F.col("tag").isin(sorted(live))), {t: beta[t] for t in live})
        for t in sorted(live):
            loss, gradient, gram = sums[t]
            penalty = np.append(np.full(widths[t], 1 / stage.c), 0.0)
            loss += (penalty * beta[t] ** 2).sum() / 2
            if t in best and loss > best[t][0]:
                # Too far: half the step, from the last good point.
                step[t] = step[t] / 2
                if np.abs(step[t]).max() < 1e-12:
                    beta[t], live = best[t][1], live - {t}
                else:
                    beta[t] = best[t][1] - step[t]
                continue
            settled = t in best and best[t][0] - loss <= TOLERANCE * max(abs(loss), 1.0)
            best[t] = loss, beta[t]
            if settled:
                live = live - {t}
                continue
            step[t] = np.linalg.lstsq(gram + np.diag(penalty), gradient + penalty * beta[t], rcond=None)[0]
            beta[t] = beta[t] - step[t]
    return [LinearModel(weights=best[t][1].tolist(), featuresCol=stage.getFeaturesCol()) for t in range(len(tables))]


def gram_sums(rows: DataFrame, beta: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Loss, gradient and weighted Gram matrix of each table at its coefficients, in one scan."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            tags, y, w = (batch.column(c).to_numpy() for c in ("tag", "y", "w"))
            lists = batch.column("x")
            values, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for tag in np.unique(tags):
                at = np.flatnonzero(tags == tag)
                x = np.column_stack([np.stack([values[offsets[i] : offsets[i + 1]] for i in at]), np.ones(len(at))])
                margin = x @ beta[int(tag)]
                p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
                loss = (w[at] * (np.logaddexp(0, margin) - y[at] * margin)).sum()
                part = np.concatenate([[loss], x.T @ (w[at] * (p - y[at])), ((x * (w[at] * p * (1 - p))[:, None]).T @ x).ravel()])
                sums[int(tag)] = sums.get(int(tag), 0) + part
        for tag, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), tag, np.int32)), pa.array(np.arange(len(part), dtype=np.int32)),
                                              pa.array(part)], names=["tag", "cell", "value"])

    cells = rows.mapInArrow(add_up, "tag int, cell int, value double").groupBy("tag", "cell").agg(F.sum("value").alias("value"))
    found = cells.toPandas()  # (width + 1)^2 + width + 2 numbers a table
    out = {}
    for tag, own in found.groupby("tag"):
        flat = own.sort_values("cell")["value"].to_numpy()
        size = len(beta[int(tag)])
        out[int(tag)] = flat[0], flat[1 : size + 1], flat[size + 1 :].reshape(size, size)
    return out
