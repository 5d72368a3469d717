"""Isotonic curves from merged pools against plain pooling."""

import threading

import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from cohortlens.operators import calibrate


def plain(score, label):
    """The greatest of the least means over spans of distinct scores around each."""
    points = np.unique(score)
    mass = np.array([label[score == p].sum() for p in points])
    weight = np.array([(score == p).sum() for p in points])
    m, w = np.concatenate([[0], mass.cumsum()]), np.concatenate([[0], weight.cumsum()])
    mean = lambda a, b: (m[b + 1] - m[a]) / (w[b + 1] - w[a])
    return points, [max(min(mean(a, b) for b in range(i, len(points))) for a in range(i + 1)) for i in range(len(points))]


def cases():
    rng = np.random.default_rng(6)
    smooth = rng.random(150)
    yield "continuous", smooth, (rng.random(150) < smooth).astype(float)
    ties = rng.integers(0, 12, 400) / 12
    yield "ties", ties, (rng.random(400) < ties**2).astype(float)
    yield "falling", np.arange(40) / 40, (np.arange(40) < 20).astype(float)
    yield "rising", np.arange(40) / 40, (np.arange(40) >= 20).astype(float)
    yield "hot", np.concatenate([np.full(300, 0.5), rng.random(60)]), rng.integers(0, 2, 360).astype(float)
    yield "one", np.array([0.4]), np.array([1.0])


@pytest.mark.parametrize("name,score,label", cases(), ids=[c[0] for c in cases()])
@pytest.mark.parametrize("ranges", [2, 16])
def test_equal_to_plain_pooling(spark, name, score, label, ranges):
    df = spark.createDataFrame([(float(p), float(y)) for p, y in zip(score, label)] + [(None, 1.0), (0.3, None)], "probability double, y double")
    curve = calibrate.fit_curve(df.repartition(3), "y", ranges=ranges)
    points, want = plain(score, label)
    got = {r.probability: r.prediction for r in curve.transform(df.select("probability").distinct()).collect()}
    assert got[None] is None if None in got else True
    assert [got[p] for p in points] == pytest.approx(want)


def test_between_points_as_the_other_solver(spark):
    rng = np.random.default_rng(7)
    score = rng.random(300)
    df = spark.createDataFrame([(float(p), float(rng.random() < p)) for p in score], "probability double, label double")
    curve = calibrate.fit_curve(df, "label")
    other = IsotonicRegression(featuresCol="probability", labelCol="label").fit(df)
    asked = spark.createDataFrame([(float(p),) for p in np.linspace(-0.2, 1.2, 200)], "probability double")
    read = lambda m: [r.prediction for r in m.transform(asked).orderBy("probability").collect()]
    assert read(curve) == pytest.approx(read(other), abs=1e-9)


def test_curve_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "probability double, label double")
    curve = calibrate.fit_curve(df, "label")
    assert curve.transform(spark.createDataFrame([(0.5,)], "probability double")).first().prediction is None
    curve = calibrate.fit_curve(spark.createDataFrame([(0.1, 0.0), (0.9, 1.0)], "probability double, label double"), "label")
    curve.write().overwrite().save(f"{tmp_path}/curve")
    again = calibrate.Curve.load(f"{tmp_path}/curve").setFeaturesCol("p").setPredictionCol("q")
    assert again.transform(spark.createDataFrame([(0.5,)], "p double")).first().q == pytest.approx(0.5)


def test_folds_are_calibrated_side_by_side(spark, monkeypatch):
    """Preparing, scoring and pooling of a fold wait for no other fold, and the parts come in the order of the folds."""
    meet, made = threading.Barrier(3), []

    def late(rows, *args, **named):
        meet.wait(20)
        return rows

    monkeypatch.setattr(calibrate, "prepare", late)
    monkeypatch.setattr(calibrate, "fit_together", lambda prepared, _: made.append(prepared) or {("base", f): f for f in prepared})
    monkeypatch.setattr(calibrate, "score", lambda base, rows, keep: late(rows.select(*keep, F.lit(base / 4.0).alias("probability"))))
    rows = spark.range(90).select(F.col("id").alias("k"), (F.col("id") % 2).alias("passed"))
    parts = calibrate.fit_calibrated(rows, "k", None, "passed").parts
    assert sorted(made[0]) == [base for base, _ in parts] == [0, 1, 2]
    assert [curve.getOrDefault("scores") for _, curve in parts] == [[0.0], [0.25], [0.5]]
