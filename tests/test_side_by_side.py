"""Fits that do not need each other run at the same time, with the results they have alone."""

import threading

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Observation, functions as F

from cohortlens.operators import features, forests, models
from cohortlens.session import materialize


@pytest.fixture(scope="module")
def ready(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(240, 3)), 2)
    y = (x[:, 0] - x[:, 1] + rng.normal(0, 0.5, 240) > 0).astype(int)
    table = spark.createDataFrame([(int(b), 1.0, [float(v) for v in a]) for a, b in zip(x, y)], f"y int, {models.WEIGHT} double, x array<double>")
    return materialize(table.select("y", models.WEIGHT, array_to_vector("x").alias("features")), "ready")


def test_boosters_and_linear_fits_meet(ready, monkeypatch):
    meet = threading.Barrier(2)

    def late(tables, *rest):
        meet.wait(20)
        return [None] * len(tables)

    monkeypatch.setattr(models.grow, "fit_all", late)
    monkeypatch.setattr(models, "fit_logistic", late)
    builders = {"linear": lambda n: models.logistic(n, "y"), "boosted": lambda n: models.boosting(2, label="y")}
    out = models.fit_together({"t": models.Prepared([], ready, 240)}, builders)
    assert set(out) == {("linear", "t"), ("boosted", "t")}


def test_margin_fits_meet(ready, monkeypatch):
    meet, fit = threading.Barrier(models.MARGIN_FOLDS + 1), models.LinearSVC.fit

    def late(self, *args):
        meet.wait(20)
        return fit(self, *args)

    monkeypatch.setattr(models.LinearSVC, "fit", late)
    model = models.MarginClassifier(240, "y", 5).fit(ready)
    assert model.transform(ready).filter("prediction = y").count() > 180


def test_margins_score_after_a_table_was_observed(ready):
    """An observation makes the session unfit for tasks, and training summaries hold the session."""
    seen = Observation("rows")
    assert ready.observe(seen, F.count(F.lit(1)).alias("n")).count() == seen.get["n"] == 240
    model = models.MarginClassifier(240, "y", 5).fit(ready)
    assert model.transform(ready).filter("prediction = y").count() > 180
    assert not any(stage.hasSummary for stage in (model.stages[0], model.stages[2]))


def test_forest_leaves_slots_to_others(ready):
    made = []

    def build(n):
        made.append(forests.Forest(20, 6, "y", models.WEIGHT))
        return made[-1:]

    prepared = {"t": models.Prepared([], ready, 240)}
    stored = lambda model: {r.tree: bytes(r.nodes) for r in model.stages[0].trees.collect()}
    beside = models.fit_together(prepared, {"forest": build, "bayes": lambda n: models.naive_bayes("y")})["forest", "t"]
    alone = models.fit_together(prepared, {"forest": build})["forest", "t"]
    assert [stage.tasks for stage in made] == [3, None]  # of four slots
    made[1].tasks = 1
    assert stored(beside) == stored(alone) == {r.tree: bytes(r.nodes) for r in made[1].fit(ready).trees.collect()}
    assert len(stored(alone)) == 20


def test_sums_of_both_sides_in_one_pass():
    rng = np.random.default_rng(1)
    bins, both = rng.integers(0, forests.MAX_BINS, (300, 6)).astype(np.uint8), rng.integers(1, 1 << 27, 300).astype(float)
    label, rows = rng.random(300) < 0.4, rng.permutation(300)[:200]
    at, tried = rng.integers(0, 3, 200), np.array([[0, 2, 5], [1, 3, 4], [0, 1, 2]])
    one, total = forests.sides_by_cell(bins, rows, at, tried, label, both)
    for got, want in zip((one, total), forests.sums_by_cell(bins, rows, at, tried, np.where(label, both, 0.0), both)):
        assert (got == want).all()
    assert total.sum() == 3 * both[rows].sum()


def test_held_out_features_are_made_once(spark, monkeypatch):
    rows = spark.range(400).select(
        F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias(models.LABEL),
        *[((F.col("id") * (7 + i) % 101) / 3.0).alias(c) for i, c in enumerate(features.NUMERIC_FEATURES)],
        *[F.concat(F.lit("v"), F.col("id") % (2 + i)).alias(c) for i, c in enumerate(features.CATEGORICAL_FEATURES)])
    seen, transform = [], features.PreprocessorModel._transform
    monkeypatch.setattr(features.PreprocessorModel, "_transform", lambda self, df: (seen.append(1), transform(self, df))[1])
    builders = {"a": lambda n: models.naive_bayes(), "b": models.logistic, "c": lambda n: models.boosting(2)}
    out = models.holdout_predictions(rows, "k", builders)
    assert len(seen) == 2  # training and held-out rows
    held_out = models.with_holdout(rows, models.LABEL, "k").filter("is_test").count()
    assert {r["model"]: r["count"] for r in out.groupBy("model").count().collect()} == dict.fromkeys("abc", held_out)


def test_a_model_that_fails_is_not_left_out_of_a_comparison(spark):
    rows = spark.range(60).select(
        F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias(models.LABEL),
        *[((F.col("id") * (7 + i) % 101) / 3.0).alias(c) for i, c in enumerate(features.NUMERIC_FEATURES)],
        *[F.concat(F.lit("v"), F.col("id") % (2 + i)).alias(c) for i, c in enumerate(features.CATEGORICAL_FEATURES)])

    def broken(n):
        raise ArithmeticError("no")

    class Unfit(models.Estimator):
        def _fit(self, dataset):
            raise ArithmeticError("no")

    for bad in (broken, lambda n: [Unfit()]):
        with pytest.raises(RuntimeError, match="bad on train could not be fitted"):
            models.compare_on_holdout(rows, "k", {"good": lambda n: models.naive_bayes(), "bad": bad})


def test_a_shared_step_that_fails_is_an_error(ready, monkeypatch):
    def lost(*_):
        raise ArithmeticError("executor lost")

    monkeypatch.setattr(models.grow, "fit_all", lost)
    prepared, builders = {"t": models.Prepared([], ready, 240)}, {"boosted": lambda n: models.boosting(2, label="y")}
    for failed in (None, {}):
        with pytest.raises(ArithmeticError, match="executor lost"):
            models.fit_together(prepared, builders, failed=failed)
