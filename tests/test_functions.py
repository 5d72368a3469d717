import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from cohortlens.functions import columns, distributions

CHECKS = [HealthCheck.function_scoped_fixture]


@settings(max_examples=6, deadline=None, suppress_health_check=CHECKS)
@given(st.lists(st.one_of(st.floats(0, 1000), st.integers(0, 4000).map(lambda i: i / 40)), min_size=50, max_size=200))
def test_fixed_text_equals_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", columns.fixed_text(F.col("v"), 1).alias("one"), columns.fixed_text(F.col("v"), 0).alias("none"))
    for row in df.collect():
        assert row.one == f"{row.v:.1f}"
        assert row.none == f"{row.v:.0f}"


def test_fixed_text_ties(spark):
    df = spark.createDataFrame([(v,) for v in (0.25, 0.35, 1.15, 2.5, 0.05, 74.95)], "v double")
    got = [r[0] for r in df.select(columns.fixed_text(F.col("v"), 1)).collect()]
    assert got == [f"{v:.1f}" for v in (0.25, 0.35, 1.15, 2.5, 0.05, 74.95)]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (5.0,), (None,)], "v double")
    assert [r[0] for r in df.select(columns.clip(F.col("v"), 0.0, 4.0)).collect()] == [0.0, 4.0, None]


def test_row_std(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0), (1.0, None, 4.0), (None, None, 4.0)], "a double, b double, c double")
    got = [r[0] for r in df.select(columns.row_std([F.col(c) for c in "abc"])).collect()]
    assert got[:2] == pytest.approx([np.std([1, 2, 4], ddof=1), np.std([1, 4], ddof=1)])
    assert got[2] is None


def test_hash_is_a_bijection_on_small_keys(spark):
    df = spark.range(50000).select(columns.portable_hash(F.col("id"), 42).alias("h"))
    assert df.distinct().count() == 50000
    low, high = df.agg(F.min("h"), F.max("h")).first()
    assert low >= 0 and high < columns.HASH_MODULUS
    big = spark.createDataFrame([(2**62,), (-(2**62),)], "id bigint").select(columns.portable_hash(F.col("id"), 1))
    assert all(r[0] >= 0 for r in big.collect())


def test_chi_square_tails():
    assert distributions.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert distributions.chi_square_tail(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-12)
    assert distributions.chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-12)
    assert distributions.chi_square_tail(0.0, 3) == 1.0
    assert distributions.chi_square_tail(2.0, 4) == pytest.approx(math.exp(-1) * 2, abs=1e-14)
    assert distributions.chi_square_tail(7.0, 0) == 1.0


def enumerate_ks(d, m, n):
    """P(D >= d) by walking every lattice path."""
    from itertools import combinations

    total = hits = 0
    for ups in combinations(range(m + n), m):
        x = y = 0
        worst = 0.0
        steps = set(ups)
        for i in range(m + n):
            x, y = (x + 1, y) if i in steps else (x, y + 1)
            worst = max(worst, abs(x / m - y / n))
        total += 1
        hits += worst >= d - 1e-12
    return hits / total


@pytest.mark.parametrize("m,n", [(3, 3), (4, 6), (5, 7), (6, 2)])
def test_exact_ks(m, n):
    for d in sorted({abs(i / m - j / n) for i in range(m + 1) for j in range(n + 1)}):
        assert distributions.ks_exact_tail(d, m, n) == pytest.approx(enumerate_ks(d, m, n), abs=1e-12)


def test_exact_and_asymptotic_agree_for_large_samples(spark):
    df = spark.createDataFrame([(0.02, 9000, 8000), (0.03, 9000, 8000)], "d double, m bigint, n bigint")
    rows = df.select("d", "m", "n", distributions.ks_asymptotic(F.col("d"), F.col("m"), F.col("n")).alias("p"),
                     distributions.ks_p(F.col("d"), F.col("m"), F.col("n"), "exact").alias("exact")).collect()
    for row in rows:
        assert row.exact == pytest.approx(distributions.ks_exact_tail(row.d, row.m, row.n))
        assert row.p == pytest.approx(row.exact, rel=0.05)


def test_dates_are_drift_categories(spark):
    from cohortlens.operators import drift

    df = spark.sql("SELECT 1 AS n, 'a' AS t, DATE '2024-01-01' AS d, TIMESTAMP '2024-01-01 00:00:00' AS s, true AS b")
    assert drift.feature_kinds(df) == (["n"], ["t", "d", "s", "b"])
    with pytest.raises(ValueError):
        drift.feature_kinds(spark.sql("SELECT array(1) AS a"))


def test_histogram_leaves_nan_out(spark):
    from cohortlens.operators.profile import histogram

    df = spark.createDataFrame([(0.0,), (1.0,), (float("nan"),), (None,)], "x double")
    assert sorted((r.bin, r.n) for r in histogram(df, ["x"], bins=2).collect()) == [(0, 1), (1, 1)]
