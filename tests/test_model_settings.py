"""Registered queries fit models at the library's settings."""

import inspect

import pytest

from cohortlens.operators import models
from cohortlens.plans import model_queries


@pytest.fixture
def calls(monkeypatch, spark):
    """What the queries would fit, without fitting."""
    seen = []
    monkeypatch.setattr(model_queries, "prepared", lambda *_: None)
    for name in ("cross_validate", "compare_on_holdout", "sweep"):
        shape = inspect.signature(getattr(models, name))

        def record(*args, shape=shape, **named):
            bound = shape.bind(*args, **named)
            bound.apply_defaults()
            seen.append(bound.arguments)

        monkeypatch.setattr(models, name, record)
    monkeypatch.setattr(model_queries, "holdout_metrics", lambda s, sf, build: seen.append({"build": build}))
    return seen


def full_baselines(builders):
    forest, boosted = builders["Random Forest"](100)[0], builders["Gradient Boosting"](100)[0]
    return (len(builders), forest.getNumTrees(), forest.getMaxDepth(), boosted.getMaxIter()) == (5, 400, 30, 300)


def test_settings(calls):
    for query in (model_queries.q_cv, model_queries.q_compare, model_queries.q_sweep, model_queries.q_gbt, model_queries.q_tuned):
        query(None, None)
    cv, compare, sweep, boosted, tuned = calls
    assert full_baselines(cv["builders"]) and cv["folds"] == 5 and full_baselines(compare["builders"])
    assert len(sweep["trials"]) == 30
    low, high, _ = models.SEARCH_SPACE["n_estimators"]
    assert all(low <= t["n_estimators"] <= high and 3 <= t["max_depth"] <= 10 for t in sweep["trials"])
    assert any(t["max_depth"] > 5 for t in sweep["trials"])
    assert boosted["build"](100)[0].getMaxIter() == 300
    assert low <= tuned["build"](100)[0].getMaxIter() <= high
