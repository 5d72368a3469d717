import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from cohortlens.operators import drift, metrics, ordered, profile, split

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def scores():
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.random(700), np.full(500, 0.25), rng.integers(0, 5, 300) / 4])
    y = (rng.random(len(p)) < 0.2 + 0.5 * p).astype(int)
    return y, p


def table(spark, y, p):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "label bigint, probability double")


def test_auc_with_a_hot_score(spark, scores):
    y, p = scores
    row = metrics.roc_auc(table(spark, y, p)).first()
    assert row.roc_auc == pytest.approx(brute_auc(y, p), abs=1e-12)
    assert (row.n_pos, row.n_neg) == (y.sum(), len(y) - y.sum())


def test_auc_by_hand(spark):
    assert metrics.roc_auc(table(spark, [1, 0, 1, 0], [0.8, 0.8, 0.4, 0.1])).first().roc_auc == pytest.approx(0.625)


def test_auc_of_one_class_is_null(spark):
    assert metrics.roc_auc(table(spark, [1, 1], [0.3, 0.6])).first().roc_auc is None


def test_curves_end_at_one(spark, scores):
    y, p = scores
    points = sorted((r.fpr, r.tpr) for r in metrics.roc_points(table(spark, y, p)).collect())
    assert points[-1] == (1.0, 1.0)
    xs, ys = np.array([(0.0, 0.0), *points]).T
    assert np.sum(np.diff(xs) * (ys[1:] + ys[:-1]) / 2) == pytest.approx(brute_auc(y, p))
    last = max(metrics.pr_points(table(spark, y, p)).collect(), key=lambda r: r.recall)
    assert last.recall == 1.0


@SLOW
@given(st.lists(st.one_of(st.integers(-3, 3).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([("x", v) for v in values], "feature string, value double")
    row = ordered.exact_quantiles(df, ["feature"], "value", [0.25, 0.5, 0.75], buckets=8).first()
    want = np.quantile(np.array(values), [0.25, 0.5, 0.75])
    assert [row.q0, row.q1, row.q2] == pytest.approx(list(want), rel=1e-9, abs=1e-9)


def test_quantiles_of_large_groups_come_from_brackets(spark, monkeypatch):
    """With a coarse sketch, most rows lie outside the brackets; hot values and nulls included."""
    monkeypatch.setattr(ordered, "SKETCH", 100)
    rng = np.random.default_rng(5)
    a = np.concatenate([rng.lognormal(size=3000), np.full(900, 1.0)])
    b = rng.integers(0, 3, len(a)).astype(float)
    group = rng.integers(0, 2, len(a))
    df = spark.createDataFrame([(int(g), float(x), float(y)) for g, x, y in zip(group, a, b)] + [(0, None, float("nan")), (1, None, None)],
                               "g int, a double, b double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    for by, own in ((["g"], lambda g, v: v[group == g]), ([], lambda g, v: v)):
        got = {(r["g"] if by else None, r["feature"]): [r[f"q{i}"] for i in range(len(probs))]
               for r in ordered.quantiles(df, ["a", "b"], probs, by).collect()}
        assert len(got) == 4 if by else 2
        for (g, name), found in got.items():
            assert found == pytest.approx(list(np.quantile(own(g, {"a": a, "b": b}[name]), probs)), rel=1e-12)
    plan = ordered.quantiles(df, ["a"], [0.5], ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_buckets_hold_about_equal_shares(spark):
    df = spark.range(20000).select((F.exp(F.col("id") / 2000.0)).alias("v"))
    counts = ordered.distinct_counts(df, [], "v", n=F.count(F.lit(1)))
    sizes = [r["count"] for r in ordered.with_buckets(counts, "v", ["n"], buckets=50).groupBy("bucket").count().collect()]
    assert len(sizes) == 50 and max(sizes) < 2 * 400


def brute_ks(a, b):
    points = np.concatenate([a, b])
    f = lambda x: np.searchsorted(np.sort(x), points, side="right") / len(x)
    return np.abs(f(a) - f(b)).max()


def test_ks_statistic(spark):
    rng = np.random.default_rng(3)
    sides = {"u": (rng.normal(0, 1, 900), rng.normal(0.3, 1.2, 700)), "v": (np.full(500, 2.0), rng.integers(0, 4, 200).astype(float))}
    rows = [(f, s, float(x)) for f, (a, b) in sides.items() for s, xs in (("reference", a), ("current", b)) for x in xs]
    long = spark.createDataFrame(rows, "feature string, side string, value double")
    got = {r.feature: r.ks_statistic for r in drift.ks_from_counts(drift.side_counts(long)).collect()}
    assert got == pytest.approx({f: brute_ks(a, b) for f, (a, b) in sides.items()}, abs=1e-12)


@pytest.mark.parametrize("ranges", [4, 64])
def test_ks_by_bounds_equals_brute_force(spark, ranges):
    rng = np.random.default_rng(8)
    sides = {"u": (rng.normal(0, 1, 900), rng.normal(0.05, 1.0, 700)), "v": (np.full(900, 2.0), rng.integers(0, 4, 700).astype(float)),
             "w": (rng.lognormal(size=900), rng.lognormal(size=700) + 3)}
    rows = [("reference", *map(float, r)) for r in zip(*(sides[c][0] for c in "uvw"))] + [
        ("current", *map(float, r)) for r in zip(*(sides[c][1] for c in "uvw"))]
    df = spark.createDataFrame(rows, "side string, u double, v double, w double").withColumn(
        "x", F.when(F.col("side") == "current", F.lit(1.0))).repartition(3)
    got = {r["feature"]: r for r in drift.ks_statistics(df, ["u", "v", "w", "x"], ranges).collect()}
    assert set(got) == {"u", "v", "w"}
    for name, (a, b) in sides.items():
        r = got[name]
        assert r["ks_statistic"] == pytest.approx(brute_ks(a, b), abs=1e-12)
        assert (r["size_ref"], r["size_cur"]) == (900, 700)
        assert [r["ref_mean"], r["cur_mean"]] == pytest.approx([a.mean(), b.mean()])
        assert [r["ref_std"], r["cur_std"]] == pytest.approx([a.std(ddof=1), b.std(ddof=1)], abs=1e-12)


def test_ks_skips_a_feature_with_one_side(spark):
    long = spark.createDataFrame([("u", "reference", 1.0), ("v", "reference", 1.0), ("v", "current", 2.0)],
                                 "feature string, side string, value double")
    assert [r.feature for r in drift.ks_from_counts(drift.side_counts(long)).collect()] == ["v"]


def test_box_whiskers(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(v, 1) for v in values], "quiz_avg double, passed int")
    row = profile.box_stats(df, ["quiz_avg"]).first()
    assert (row.q1, row.median, row.q3, row.whisker_low, row.whisker_high, row.n_outliers) == (2.0, 3.0, 4.0, 1.0, 4.0, 1)


def test_mode_prefers_the_smallest_on_a_tie(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "c string")
    assert profile.modes(df, ["c"]).first()["mode"] == "a"


def test_holdout_is_stratified(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 10 < 3).cast("int").alias("y"))
    out = split.with_holdout(df, "y", "k", 0.2)
    sizes = {r.y: r.n for r in out.filter("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 140, 1: 60}
    again = split.with_holdout(df.repartition(7), "y", "k", 0.2)
    assert again.filter("is_test").select("k").exceptAll(out.filter("is_test").select("k")).count() == 0


@pytest.mark.parametrize("n,folds", [(100, 5), (103, 5), (3, 5), (7, 3)])
def test_fold_sizes(spark, n, folds):
    df = spark.range(n).select(F.col("id").alias("k"), F.lit(1).alias("y"))
    sizes = [r["count"] for r in split.with_folds(df, "y", "k", folds).groupBy("fold").count().collect()]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_rows_of_one_key_stay_together(spark):
    df = spark.range(900).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id")).alias("k"), F.lit(1).alias("y"))
    parts = split.with_folds(df, "y", "k", 3).filter("k = 0").select("fold").distinct().count()
    assert parts == 1


def test_text_keys(spark):
    df = spark.range(200).select(F.format_string("STU_%06d", "id").alias("k"), F.lit(0).alias("y"))
    assert split.with_holdout(df, "y", "k", 0.3).filter("is_test").count() == 60
    assert split.sample_n(df, "k", 50).count() == 50
    assert split.sample_n(df, "k", 500).count() == 200
