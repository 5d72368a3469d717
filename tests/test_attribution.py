"""Contributions of trees against all subsets; fits of folds against plain ones."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohortlens.operators import boosting, fold_fits, tree_attribution
from cohortlens.operators.boosting import Job, Settings


@pytest.fixture(scope="module")
def grown(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=300).round(1), rng.integers(0, 3, 300), rng.random(300).round(2), rng.normal(size=300).round(1)])
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.4 * x[:, 3] + rng.normal(size=300) * 0.4 > 1).astype(float)
    df = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x, y)], ["label", "features"])
    return boosting.fit_all([df], [Job(0, Settings(6, 4, 0.3))])[0], df, x


def known_value(ensemble, bins, known):
    """Expected margin when only the features in ``known`` are seen, by walking the trees."""
    feature, cut, left, value, cover = (ensemble.parts[n] for n in ("feature", "cut", "left", "value", "cover"))

    def walk(node):
        if left[node] == node:
            return value[node]
        a, b = left[node], left[node] + 1
        if feature[node] in known:
            return walk(b if bins[feature[node]] > cut[node] else a)
        return (cover[a] * walk(a) + cover[b] * walk(b)) / cover[node]

    return ensemble.prior + sum(walk(r) for r in ensemble.parts["first"][:-1])


def test_contributions_equal_all_subsets(grown):
    model, _, x = grown
    ensemble = model.ensemble()
    some = x[:12]
    got = tree_attribution.contributions(ensemble, some)
    assert got.sum(axis=1) == pytest.approx(ensemble.margins(some))
    m = x.shape[1]
    for row, bins in zip(got, ensemble.bins(some)):
        assert row[-1] == pytest.approx(known_value(ensemble, bins, ()))
        for f in range(m):
            others = [g for g in range(m) if g != f]
            want = sum(math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) * (
                known_value(ensemble, bins, (*s, f)) - known_value(ensemble, bins, s))
                for k in range(m) for s in itertools.combinations(others, k))
            assert row[f] == pytest.approx(want, abs=1e-9)


def test_contribution_columns(grown):
    model, df, x = grown
    out = tree_attribution.tree_contributions(model, df, ["a", "b", "c", "d"], ["label"])
    assert out.columns == ["label", "a", "b", "c", "d", "base"]
    rows = np.array([[r.a, r.b, r.c, r.d, r.base] for r in out.collect()])
    assert sorted(rows.sum(axis=1)) == pytest.approx(sorted(model.ensemble().margins(x)))
    assert tree_attribution.tree_contributions(model, df.limit(0), ["a", "b", "c", "d"]).count() == 0


def test_logistic_equals_the_other_solver(spark):
    rng = np.random.default_rng(4)
    tables = []
    for n in (200, 150):
        x = rng.normal(size=(n, 3))
        y = (x @ [1.0, -2.0, 0.0] + rng.normal(size=n) > 0.2).astype(float)
        w = rng.random(n) + 0.5
        tables.append(spark.createDataFrame([(float(b), float(c), Vectors.dense(a)) for a, b, c in zip(x, y, w)], ["label", "w", "features"]))
    stage = fold_fits.NewtonLogistic(0.5, 100, "label", "w")
    for table, model in zip(tables, fold_fits.fit_logistic(tables, stage)):
        total = table.agg(F.sum("w")).first()[0]
        want = LogisticRegression(weightCol="w", regParam=1 / (0.5 * total), standardization=False, maxIter=500, tol=1e-12).fit(table)
        assert model.getOrDefault("weights") == pytest.approx([*want.coefficients, want.intercept], abs=1e-4)
        p = [r.probability[1] for r in model.transform(table).collect()]
        assert p == pytest.approx([r.probability[1] for r in want.transform(table).collect()], abs=1e-4)
    apart = spark.createDataFrame([(0.0, 1.0, Vectors.dense([-1.0])), (1.0, 1.0, Vectors.dense([1.0]))], ["label", "w", "features"])
    assert fold_fits.fit_logistic([apart], stage)[0].getOrDefault("weights")[0] > 0


def test_fold_bayes_without_a_class(spark):
    """A fold whose others know one class only scores 0 or 1; rows without a label are scored."""
    df = spark.createDataFrame([(0, 1, 1.0, "a"), (0, 1, 2.0, "b"), (1, 0, 3.0, None), (1, None, None, "a")], "fold int, y int, x double, c string")
    got = [(r.fold, r.y, round(r.probability, 6)) for r in fold_fits.naive_bayes_folds(df, "fold", "y", ["x"], {"c": ["a", "b"]}).collect()]
    assert sorted(got, key=str) == sorted([(0, 1, 0.0), (0, 1, 0.0), (1, 0, 1.0), (1, None, 1.0)], key=str)
    with pytest.raises(ValueError, match="two folds"):
        fold_fits.naive_bayes_folds(df.filter("fold = 0"), "fold", "y", ["x"], {})


def test_values_of_many_paths_are_those_of_each(monkeypatch):
    """Tables of all patterns are made once for many paths; long paths look only at patterns that occur."""
    rng = np.random.default_rng(4)
    share = rng.random((5, 3))
    share[2, 1] = 0.0
    every = tree_attribution.patterns(3)
    assert sorted(map(tuple, every)) == sorted(itertools.product((0.0, 1.0), repeat=3))
    together = tree_attribution.path_values(every, share)
    for own, values in zip(share, together):
        assert values == pytest.approx(tree_attribution.path_values(every, own))
        for passes, found in zip(every, values):
            worth = lambda known: math.prod(passes[j] if j in known else own[j] for j in range(3))
            for j in range(3):
                rest = [k for k in range(3) if k != j]
                want = sum(math.factorial(r) * math.factorial(2 - r) / 6 * (worth({*s, j}) - worth(set(s)))
                           for r in range(3) for s in itertools.combinations(rest, r))
                assert found[j] == pytest.approx(want)
    x = rng.normal(size=(500, 4))
    growth = boosting.grow_here(boosting.binned(x, [np.linspace(-1, 1, 9)] * 4), (x[:, 0] * x[:, 1] > x[:, 2]).astype(float), np.ones(500),
                                np.arange(500, dtype=np.uint64), Settings(3, 4, 0.3), 0.1)
    ensemble = boosting.Ensemble.of(growth, [np.linspace(-1, 1, 9)] * 4)
    tables = tree_attribution.contributions(ensemble, x)
    monkeypatch.setattr(tree_attribution, "PATTERN_BITS", 1)
    assert tree_attribution.contributions(ensemble, x) == pytest.approx(tables)
    assert tables.sum(axis=1) == pytest.approx(ensemble.margins(x))
