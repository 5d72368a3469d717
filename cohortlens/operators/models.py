"""Baseline classifiers, cross-validation, holdout comparison and the parameter sweep."""

from __future__ import annotations

import logging
import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, LogisticRegressionModel, NaiveBayes
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.operators import boosting as grow
from cohortlens.operators import metrics
from cohortlens.operators.fold_fits import NewtonLogistic, fit_logistic
from cohortlens.operators.forests import Forest
from cohortlens.operators.features import FeatureEngineer, Preprocessor, ENGINEERED
from cohortlens.operators.split import with_folds, with_holdout
from cohortlens.schema import LABEL, NUMERIC_FEATURES
from cohortlens.session import ensure_checkpoint_dir, materialize, shared_dir

log = logging.getLogger(__name__)

# Stages of a classifier, given the number of training rows.
Builder = Callable[[int], list]

WEIGHT = "class_weight"
SCORES = ["f1", "roc_auc", "accuracy", "precision", "recall"]

# Settings of the baseline models and of the tuned booster (fixed values).
LOGISTIC_ITERATIONS = 1000
LOGISTIC_C = 1.0
FOREST_TREES = 400
FOREST_DEPTH = 30
BOOST_ROUNDS = 300
BOOST_RATE = 0.1
BOOST_DEPTH = 4
SEED = 42
# Parameter space of the sweep: low, high, kind; and the parameters of the tuned booster where nothing was swept (fixed values).
SEARCH_SPACE = {
    "n_estimators": (200, 1000, "int"),
    "max_depth": (3, 10, "int"),
    "learning_rate": (0.01, 0.3, "log"),
    "subsample": (0.6, 1.0, "float"),
    "colsample_bytree": (0.6, 1.0, "float"),
    "reg_lambda": (0.0, 10.0, "float"),
    "reg_alpha": (0.0, 5.0, "float"),
    "min_child_weight": (1, 10, "int"),
    "gamma": (0.0, 5.0, "float"),
}
TUNED_DEFAULTS = {
    "n_estimators": 600,
    "max_depth": 6,
    "learning_rate": 0.05,
    "subsample": 0.8,
    "colsample_bytree": 0.9,
    "reg_lambda": 1.5,
    "reg_alpha": 0.5,
    "min_child_weight": 1,
    "gamma": 0.0,
}
MARGIN_FOLDS = 3
#: Quarters of the slots that a forest takes while other fits run beside it.
FOREST_SHARE = 3


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced weight per class: n / (classes * n_class)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    classes = counts.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", total / (classes * F.col("n")))


def preprocessing(engineered: bool = False) -> list:
    """Stages before a classifier; engineered columns join the numeric features on request."""
    if engineered:
        return [FeatureEngineer(), Preprocessor(numeric=[*NUMERIC_FEATURES, *ENGINEERED])]
    return [Preprocessor()]


def logistic(n_rows: int, label: str = LABEL) -> list:
    """L2 logistic regression on balanced classes; the penalty constant C weighs the summed loss."""
    return [NewtonLogistic(LOGISTIC_C, LOGISTIC_ITERATIONS, label, WEIGHT)]


def forest(trees: int = FOREST_TREES, depth: int = FOREST_DEPTH, label: str = LABEL) -> list:
    """Random forest on balanced classes; 30 is the deepest tree it grows."""
    return [Forest(trees, depth, label, WEIGHT, SEED)]


def boosting(rounds: int = BOOST_ROUNDS, rate: float = BOOST_RATE, depth: int = BOOST_DEPTH, label: str = LABEL) -> list:
    """Trees on the squared error of the gradients, with Newton steps in the leaves."""
    return [grow.Booster(grow.Settings(rounds, depth, rate, seed=SEED), labelCol=label)]


class MarginClassifier(Estimator):
    """Linear margin classifier with a logistic curve from margin to probability.

    The curve learns from margins of rows that their classifier did not see: the rows are dealt into
    ``MARGIN_FOLDS`` folds, each scored by a classifier of the others. The final classifier learns from all.
    """

    def __init__(self, n_rows: int, label: str = LABEL, iterations: int = 100):
        super().__init__()
        self.label = label
        # A cost of C = 1 a row is a penalty of 1 / n on the mean loss.
        self.margin = LinearSVC(labelCol=label, weightCol=WEIGHT, maxIter=iterations, regParam=1.0 / max(n_rows, 1),
                                rawPredictionCol="margins", predictionCol="svm_prediction")
        self.slicer = VectorSlicer(inputCol="margins", outputCol="margin", indices=[1])

    def deal(self, rows: DataFrame) -> DataFrame:
        """The rows with a fold, stored: all four classifiers learn from them."""
        keyed = rows.withColumn("row_key", F.xxhash64(vector_to_array("features")))
        return materialize(with_folds(keyed, self.label, "row_key", MARGIN_FOLDS, name="margin_fold"), "margin_folds")

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        dealt = self.deal(dataset)
        # Each fit is a chain of short jobs, so the chains run side by side; the last learns from all rows.
        subsets = [*(dealt.filter(F.col("margin_fold") != fold) for fold in range(MARGIN_FOLDS)), dealt]
        with ThreadPoolExecutor(len(subsets)) as pool:
            # Training summaries hold the session, which cannot go to tasks once a table was observed; copies have none.
            *classifiers, final = pool.map(lambda rows: self.margin.fit(rows).copy(), subsets)
        held_out = union_all([
            self.slicer.transform(classifier.transform(dealt.filter(F.col("margin_fold") == fold))).select(self.label, "margin")
            for fold, classifier in enumerate(classifiers)])
        path = shared_dir(dataset.sparkSession, "margin-curve")
        # A copy of this one keeps its summary, a stored one has none.
        LogisticRegression(labelCol=self.label, featuresCol="margin", maxIter=100).fit(held_out).save(path)
        return PipelineModel([final, self.slicer, LogisticRegressionModel.load(path)])


def linear_svm(n_rows: int, label: str = LABEL, iterations: int = 100) -> list:
    """Linear margins with probabilities. Spark has no kernel machine; the boundary is linear here."""
    return [MarginClassifier(n_rows, label, iterations)]


def naive_bayes(label: str = LABEL) -> list:
    return [NaiveBayes(labelCol=label, modelType="gaussian")]


def baselines(label: str = LABEL, trees: int = FOREST_TREES, rounds: int = BOOST_ROUNDS,
              forest_depth: int = FOREST_DEPTH) -> dict[str, Builder]:
    return {
        "Logistic Regression": lambda n: logistic(n, label),
        "Random Forest": lambda n: forest(trees, forest_depth, label),
        "Gradient Boosting": lambda n: boosting(rounds, label=label),
        "SVM": lambda n: linear_svm(n, label),
        "Naive Bayes": lambda n: naive_bayes(label),
    }


@dataclass
class Prepared:
    """Fitted preprocessing and the training rows it gives: label, class weight and features."""

    stages: list
    rows: DataFrame
    n: int

    def fit(self, build: Builder) -> PipelineModel:
        """Fit one classifier; the result scores raw rows."""
        return PipelineModel([*self.stages, *Pipeline(stages=build(self.n)).fit(self.rows).stages])


def prepare(df: DataFrame, label: str = LABEL, engineered: bool = False, store: bool = False) -> Prepared:
    """Fit the preprocessing on the labelled rows, once for however many classifiers.

    The table is read a few times; pass one that is cheap to read (see ``materialize``).
    With ``store`` the prepared rows are written, for when several classifiers read them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    weights = class_weights(df, label)
    facts = weights.agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n")).first()
    if facts["classes"] < 2:
        raise ValueError(f"{label} needs two classes to learn from, found {facts['classes']}")
    labelled = df.filter(F.col(label).isNotNull())
    prep = Pipeline(stages=preprocessing(engineered)).fit(labelled)
    rows = prep.transform(labelled).join(weights.select(label, F.col("weight").alias(WEIGHT)), label).select(
        label, WEIGHT, "features")
    return Prepared(prep.stages, materialize(rows, "prepared") if store else rows, facts["n"])


def fit(df: DataFrame, build: Builder, label: str = LABEL, engineered: bool = False) -> PipelineModel:
    """Fit preprocessing and one classifier."""
    return prepare(df, label, engineered).fit(build)


def pass_probability() -> Column:
    return F.get(vector_to_array(F.col("probability")), F.lit(1))


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., probability): all rows in one distributed pass."""
    return model.transform(df).select(*keep, pass_probability().alias("probability"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def score_table(predictions: DataFrame, by: Sequence[str], label: str = LABEL) -> DataFrame:
    """The five metrics per group in long form, from one table of predictions.

    Undefined ratios score 0, as does a group whose labels hold one class only.
    """
    rates = metrics.binary_metrics(predictions, by, label)
    areas = metrics.roc_auc(predictions, by, label).select(*by, "roc_auc")
    wide = rates.join(areas, list(by), "left").na.fill(0.0, SCORES)
    return wide.unpivot(list(by), SCORES, "metric", "score")


def fit_together(prepared: dict, builders: dict[str, Builder], parallelism: int = 4,
                 failed: dict[tuple, Exception] | None = None) -> dict[tuple, PipelineModel]:
    """(name, key) -> model of every builder on every prepared table.

    A fit that fails is an error, raised when the others have ended; with ``failed`` it is noted there and left out.
    A step that several fits share is no single fit's to fail, so it is an error either way.

    All boosters grow together, whatever their table and settings, and logistic regressions of one name take their steps
    together. Those and the other fits run ``parallelism`` at a time: boosters keep few tasks busy, linear fits are chains of short jobs.
    """
    stages, own, shared = {}, {}, []
    for key, table in prepared.items():
        for name, build in builders.items():
            try:
                stages[name, key] = build(table.n)
            except Exception as err:
                log.warning("%s on %s failed: %s", name, key, err)
                own[name, key] = err
    kind = lambda job: type(stages[job][0]) if len(stages[job]) == 1 else None
    boosted = [job for job in stages if kind(job) is grow.Booster]
    linear = [job for job in stages if kind(job) is NewtonLogistic]
    out = {}

    def take(jobs: list[tuple], models: Callable[[], list]) -> None:
        try:
            out.update({job: PipelineModel([*prepared[job[1]].stages, model]) for job, model in zip(jobs, models())})
        except Exception as err:
            log.error("%s failed: %s", jobs, err)
            shared.append(err)

    def boost() -> None:
        keys = list(dict.fromkeys(key for _, key in boosted))
        take(boosted, lambda: grow.fit_all([prepared[key].rows for key in keys],
                                           [grow.Job(keys.index(key), stages[name, key][0].settings) for name, key in boosted],
                                           stages[boosted[0]][0].getLabelCol()))

    def step(name: str) -> None:
        jobs = [job for job in linear if job[0] == name]
        take(jobs, lambda: fit_logistic([prepared[key].rows for _, key in jobs], stages[jobs[0]][0]))

    def run(job: tuple) -> None:
        try:
            out[job] = PipelineModel([*prepared[job[1]].stages, *Pipeline(stages=stages[job]).fit(prepared[job[1]].rows).stages])
        except Exception as err:
            log.warning("%s on %s failed: %s", *job, err)
            own[job] = err

    others = [job for job in stages if job not in boosted and job not in linear]
    forests = [job for job in others if kind(job) is Forest]
    work = [*([boost] if boosted else []), *[partial(step, name) for name in dict.fromkeys(name for name, _ in linear)],
            *[partial(run, job) for job in others if job not in forests]]
    if work:
        # Forests would fill every slot and hold up the short jobs beside them.
        slots = max(1, FOREST_SHARE * next(iter(prepared.values())).rows.sparkSession.sparkContext.defaultParallelism // 4)
        for job in forests:
            stages[job][0].tasks = slots
    with ThreadPoolExecutor(parallelism) as pool:
        for part in [pool.submit(part) for part in [*work, *[partial(run, job) for job in forests]]]:
            part.result()
    if shared:
        raise shared[0]
    if own and failed is None:
        (name, key), err = next(iter(own.items()))
        raise RuntimeError(f"{name} on {key} could not be fitted") from err
    if failed is not None:
        failed.update(own)
    # In the order of the jobs, whichever ended first.
    return {job: out[job] for job in [*boosted, *linear, *others] if job in out}


def cross_validate(df: DataFrame, key: str, builders: dict[str, Builder], label: str = LABEL, folds: int = 5,
                   parallelism: int = 4) -> DataFrame:
    """Long table (model, fold, metric, score).

    Preprocessing is fitted once per fold and each model once per fold; all five metrics
    come from one scoring of the held-out rows. A fit that fails scores 0 on its fold.
    """
    table = materialize(with_folds(df, label, key, folds), "folds", partition_by="fold")

    def ready(fold: int) -> Prepared | None:
        try:
            return prepare(table.filter(F.col("fold") != fold).drop("fold"), label, store=True)
        except Exception as err:
            log.warning("preprocessing failed on fold %d: %s", fold, err)
            return None

    with ThreadPoolExecutor(parallelism) as pool:
        prepared = {fold: p for fold, p in enumerate(pool.map(ready, range(folds))) if p is not None}
    fitted = fit_together(prepared, builders, parallelism, failed={})

    def predict(job: tuple) -> DataFrame:
        name, fold = job
        held_out = score(fitted[job], table.filter(F.col("fold") == fold), [label])
        return held_out.select(F.lit(name).alias("model"), F.lit(fold).alias("fold"), label, "probability")

    # Forests store what they score.
    with ThreadPoolExecutor(parallelism) as pool:
        done = list(pool.map(predict, fitted))
    failed = [(name, fold, m, 0.0) for name in builders for fold in range(folds) if (name, fold) not in fitted for m in SCORES]
    parts = []
    if done:
        # Stored, as rates and AUC both read the predictions.
        parts.append(score_table(materialize(union_all(done), "predictions"), ["model", "fold"], label))
    if failed:
        parts.append(df.sparkSession.createDataFrame(failed, "model string, fold int, metric string, score double"))
    return union_all(parts)


def holdout_predictions(df: DataFrame, key: str, builders: dict[str, Builder], label: str = LABEL,
                        test_share: float = 0.2) -> DataFrame:
    """(label, probability, model) of each model on held-out rows, stored: each model scores once. A model that cannot be fitted is an error."""
    table = materialize(with_holdout(df, label, key, test_share), "holdout", partition_by="is_test")
    train, test = table.filter("NOT is_test").drop("is_test"), table.filter("is_test")
    prepared = prepare(train, label, store=True)
    fitted = fit_together({"train": prepared}, builders)
    # All models read the same features, so these are made once.
    ready = materialize(PipelineModel(prepared.stages).transform(test).select(label, "features"), "prepared_test")
    frames = [score(PipelineModel(model.stages[len(prepared.stages):]), ready, [label]).withColumn("model", F.lit(name))
              for (name, _), model in fitted.items()]
    return materialize(union_all(frames), "predictions")


def compare_on_holdout(df: DataFrame, key: str, builders: dict[str, Builder], label: str = LABEL,
                       test_share: float = 0.2) -> DataFrame:
    """F1, AUC, accuracy, precision, recall and the confusion counts of each model on held-out rows.

    ``metrics.classification_report(holdout_predictions(...), label, ["model"])`` has the report by class.
    """
    predictions = holdout_predictions(df, key, builders, label, test_share)
    # One row per model.
    areas = F.broadcast(metrics.roc_auc(predictions, ["model"], label).select("model", "roc_auc"))
    hits = F.broadcast(metrics.confusion_counts(predictions, ["model"], label))
    return metrics.binary_metrics(predictions, ["model"], label).join(areas, "model").join(hits, "model")


def fit_best(df: DataFrame, builders: dict[str, Builder], scores: DataFrame, label: str = LABEL) -> tuple[str, PipelineModel]:
    """Refit the model with the best mean F1 on all rows."""
    summary = metrics.fold_summary(scores).filter("metric = 'f1'")
    name = metrics.best_by(summary, "model", "mean").first()["model"]
    return name, fit(df, builders[name], label)


def fit_all(df: DataFrame, builders: dict[str, Builder], label: str = LABEL) -> dict[str, PipelineModel]:
    return {name: model for (name, _), model in fit_together({"all": prepare(df, label, store=True)}, builders).items()}


def draw_params(trials: int, seed: int = SEED, space: dict = SEARCH_SPACE) -> list[dict]:
    """Seeded random draws; the learning rate is drawn on a log scale."""
    rng = random.Random(seed)
    out = []
    for _ in range(trials):
        params = {}
        for name, (low, high, kind) in space.items():
            if kind == "int":
                params[name] = rng.randint(low, high)
            elif kind == "log":
                params[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
            else:
                params[name] = rng.uniform(low, high)
        out.append(params)
    return out


def tuned_booster(params: dict, label: str = LABEL) -> Builder:
    """Second-order booster with swept parameters: L1 and L2 penalties of leaves, least hessian and least gain of splits."""
    settings = grow.Settings(
        rounds=params["n_estimators"], depth=params["max_depth"], rate=params["learning_rate"], subsample=params["subsample"],
        colsample=params["colsample_bytree"], min_child_weight=params["min_child_weight"], gamma=params["gamma"],
        reg_lambda=params["reg_lambda"], reg_alpha=params["reg_alpha"], newton=True, seed=SEED)
    return lambda n: [grow.Booster(settings, labelCol=label)]


def sweep(df: DataFrame, key: str, trials: Sequence[dict], label: str = LABEL, test_share: float = 0.2,
          parallelism: int = 4, build: Callable[[dict, str], Builder] = tuned_booster) -> DataFrame:
    """One row per trial: its parameters, validation F1 and AUC. A failed trial scores 0."""
    spark = df.sparkSession
    table = materialize(with_holdout(df, label, key, test_share), "holdout", partition_by="is_test")
    train, valid = table.filter("NOT is_test").drop("is_test"), table.filter("is_test")
    # A builder that fails does so as its trial.
    builders = {trial: (lambda n, params=params: build(params, label)(n)) for trial, params in enumerate(trials)}
    fitted = fit_together({"train": prepare(train, label, store=True)}, builders, parallelism, failed={})
    frames = [score(model, valid, [label]).withColumn("trial", F.lit(trial)) for (trial, _), model in fitted.items()]
    # One row per trial: the list of trials is the caller's and short.
    names = list(trials[0])
    columns = ", ".join(["trial int", *[f"{n} double" for n in names]])
    table = spark.createDataFrame([(i, *[float(t[n]) for n in names]) for i, t in enumerate(trials)], columns)
    if not frames:
        return table.withColumns({"f1": F.lit(0.0), "roc_auc": F.lit(0.0)})
    predictions = materialize(union_all(frames), "predictions")
    rates = metrics.binary_metrics(predictions, ["trial"], label).select("trial", "f1")
    areas = metrics.roc_auc(predictions, ["trial"], label).select("trial", "roc_auc")
    return table.join(rates, "trial", "left").join(areas, "trial", "left").na.fill(0.0, ["f1", "roc_auc"])
