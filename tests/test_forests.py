"""Forests against plain trees, grown both ways, saved and scored by blocks."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortlens.operators import forests
from cohortlens.sources import artifacts
from cohortlens.session import materialize
from pyspark.ml import PipelineModel


@pytest.fixture(scope="module")
def rows(spark):
    """Rows with a noisy label, some of them alike, one without a label."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(600, 5)), 1)
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(0, 0.7, 600) > 1).astype(int)
    data = [(int(b), 1.0 + int(b), [float(v) for v in a]) for a, b in zip(x, y)]
    table = spark.createDataFrame(data + data[:50] + [(None, 1.0, [0.0] * 5)], "label int, weight double, x array<double>")
    return materialize(table.select("label", "weight", array_to_vector("x").alias("features")), "forest_input")


def fitted(rows, trees=9, depth=30):
    return forests.Forest(trees, depth, "label", "weight").fit(rows)


def chances(model, rows):
    out = model.transform(rows).select(vector_to_array("features").alias("x"), vector_to_array("probability").alias("p"), "prediction")
    return {tuple(r.x): (round(r.p[1], 9), r.prediction) for r in out.collect()}


def stored(model):
    return {r.tree: bytes(r.nodes) for r in model.trees.collect()}


def plain(bins, one, both, path, level, depth, seed, tree, row):
    """Weights (class 1, both) of the leaf that ``row`` reaches, by recursion."""
    if level == depth or not 0 < one.sum() < both.sum():
        return one.sum(), both.sum()
    impure = lambda a, b: 2 * a * (b - a) / b if b else 0.0
    best = (1e-12, None, None)
    for f in forests.tried_features(np.array([path], np.uint64), bins.shape[1], seed, tree)[0]:
        for cut in range(forests.MAX_BINS - 1):
            low = bins[:, f] <= cut
            if low.any() and not low.all():
                drop = (impure(one.sum(), both.sum()) - impure(one[low].sum(), both[low].sum())
                        - impure(one[~low].sum(), both[~low].sum())) / both.sum()
                if drop > best[0]:
                    best = (drop, f, cut)
    if best[1] is None:
        return one.sum(), both.sum()
    right = row[best[1]] > best[2]
    side = (bins[:, best[1]] > best[2]) == right
    return plain(bins[side], one[side], both[side], 2 * path + int(right), level + 1, depth, seed, tree, row)


def test_equal_to_plain_recursion():
    rng = np.random.default_rng(0)
    bins = rng.integers(0, 6, (120, 7)).astype(np.uint8)
    both = rng.integers(1, 4, 120).astype(float)
    one = np.where(bins[:, 0] + rng.integers(0, 6, 120) > 5, both, 0.0)
    nodes = forests.grow(bins, one, both, 1, 0, 6, 42, 3)
    at = forests.settled(bins, (nodes["feature"], nodes["cut"], nodes["left"].astype(np.int64), None))
    for i in range(0, 120, 7):
        assert (nodes["one"][at[i]], nodes["both"][at[i]]) == plain(bins, one, both, 1, 0, 6, 42, 3, bins[i])


def test_sister_leaves_of_one_class_are_one():
    nodes = np.array([(0, 1, 1, 6.0, 10.0), (0, forests.LEAF, 1, 0.0, 3.0), (1, 0, 3, 6.0, 7.0), (0, forests.LEAF, 3, 2.0, 3.0),
                      (0, forests.LEAF, 4, 4.0, 4.0)], forests.GROWN)
    out = forests.pruned(nodes)
    assert out["left"].tolist() == [1, 1, 2]
    assert [v / forests.VOTE for v in out["vote"]] == pytest.approx([0.6, 0.0, 6 / 7])


def test_draws_follow_the_poisson_law():
    hashes = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    for copies in (1, 7, 3000):
        times = forests.drawn(hashes, np.full(20_000, copies), 42, 5)
        assert times.mean() == pytest.approx(copies, rel=0.03) and times.var() == pytest.approx(copies, rel=0.06)


def test_large_tables_grow_the_same_trees(rows, monkeypatch):
    whole = fitted(rows)
    monkeypatch.setattr(forests, "LOCAL_ROWS", 60)
    parts = fitted(rows)
    assert stored(whole) == stored(parts) and len(stored(whole)) == 9
    monkeypatch.setattr(forests, "MAX_CELLS", 300)
    assert stored(fitted(rows, 3)) == {t: n for t, n in stored(whole).items() if t < 3}


def test_trees_do_not_depend_on_the_layout(rows):
    assert stored(fitted(rows)) == stored(fitted(rows.repartition(5, F.rand(1))))


def test_scores_in_blocks_and_after_saving(rows, monkeypatch, tmp_path):
    model = fitted(rows, 20)
    scores = chances(model, rows)
    assert all(0 <= p <= 1 and said == float(p > 0.5) for p, said in scores.values())
    artifacts.save_model(PipelineModel([model]), f"{tmp_path}/forest")
    assert chances(artifacts.load_model(f"{tmp_path}/forest").stages[0], rows) == scores
    monkeypatch.setattr(forests, "LOCAL_ROWS", 100)
    monkeypatch.setattr(forests, "TASK_BYTES", 1)
    assert chances(model, rows) == scores
    assert model.transform(rows).count() == rows.count()


def test_trees_stay_out_of_the_driver(rows):
    """The model holds a stored table: its own size does not grow with rows or trees."""
    model = fitted(rows, 20)
    assert model.trees.inputFiles() and not hasattr(model, "_java_obj")
    assert sum(len(n) for n in stored(model).values()) > 20 * forests.STORED.itemsize


def test_one_class_and_wrong_labels(spark, rows):
    ones = rows.filter("label = 1")
    assert {p for p, _ in chances(fitted(ones), ones).values()} == {1.0}
    with pytest.raises(ValueError, match="no labelled rows"):
        fitted(rows.filter("label IS NULL"))
    with pytest.raises(ValueError, match="other values"):
        fitted(rows.withColumn("label", F.lit(2)))
