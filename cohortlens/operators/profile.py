"""Profiles, correlations, histograms, box statistics and fitted constants."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions.columns import add_all, count_where, one_row_to_long, to_long
from cohortlens.operators.gram import correlations
from cohortlens.operators.ordered import by_group, number, quantiles
from cohortlens.schema import (BOX_FEATURES, HIGH_CORRELATION, HISTOGRAM_BINS, LABEL, LEAKAGE_CORRELATION)

#: Columns from which pairs are no longer written out.
WIDE = 24


def long_numbers(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature, value) of the numeric cells that hold a number; NaN counts as missing."""
    return to_long(df, columns, keep, "double").filter(~F.isnan("value"))


def long_texts(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return to_long(df, columns, keep, "string")


def overview(df: DataFrame, label: str = LABEL, score: str = "final_score") -> DataFrame:
    missing = add_all(F.col(c).isNull().cast("bigint") for c in df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.sum(missing).alias("missing_values"), F.avg(F.col(label).cast("double")).alias("pass_rate"),
        F.avg(score).alias("score_mean"), F.stddev_samp(score).alias("score_std"))


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    facts = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.agg(*[fn(c).alias(f"{c}__{name}") for c in columns for name, fn in facts.items()])
    return one_row_to_long(row, [
        {"feature": F.lit(c), **{name: F.col(f"{c}__{name}").cast("double") for name in facts}} for c in columns])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, most frequent first; null is not a value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), column)


def class_balance(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares per class, in class order."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total).orderBy(column)


def categorical_distributions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return long_texts(df, columns).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def target_correlation(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Absolute correlation of each column with the target, strongest first."""
    features = [c for c in columns if c != target]
    row = df.agg(*[F.abs(F.corr(c, target)).alias(c) for c in features])
    long = one_row_to_long(row, [{"feature": F.lit(c), "abs_corr": F.col(c)} for c in features])
    return long.orderBy(F.desc("abs_corr"), "feature")


def leakage_flags(df: DataFrame, columns: Sequence[str], target: str, limit: float = LEAKAGE_CORRELATION) -> DataFrame:
    return target_correlation(df, columns, target).filter(F.col("abs_corr") > limit)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Upper triangle in long form; each pair uses the rows where both are present.

    Few columns are one expression for each pair, in one aggregate; more than ``WIDE`` go through blocks of a Gram matrix.
    """
    if len(columns) > WIDE:
        return correlations(df, columns)
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return one_row_to_long(row, [
        {"feature_a": F.lit(a), "feature_b": F.lit(b), "corr": F.col(f"p{i}")} for i, (a, b) in enumerate(pairs)])


def high_correlation_pairs(df: DataFrame, columns: Sequence[str], limit: float = HIGH_CORRELATION) -> DataFrame:
    return correlation_matrix(df, columns).filter(F.abs("corr") > limit)


def histogram(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), bins: int = HISTOGRAM_BINS,
              shared_range: bool = False) -> DataFrame:
    """Equal-width bins over min..max per feature (and group); the last bin is closed.

    Returns every non-empty bin with its edges, count and density. A constant feature
    gets the range value +- 0.5. The ends are a scalar, and rows find their bins by projection:
    two scans, and the exchange carries counts per bin.
    """
    by, names = list(by), [f"c{i}" for i in range(len(columns))]
    over = [] if shared_range else by
    wide = df.select(*by, *[number(c).alias(n) for c, n in zip(columns, names)])
    ends = wide.groupBy(*over).agg(*[F.min(n).alias(f"lo_{n}") for n in names], *[F.max(n).alias(f"hi_{n}") for n in names])
    same = lambda n: F.col(f"facts.lo_{n}") == F.col(f"facts.hi_{n}")
    low = lambda n: F.when(same(n), F.col(f"facts.lo_{n}") - 0.5).otherwise(F.col(f"facts.lo_{n}"))
    high = lambda n: F.when(same(n), F.col(f"facts.hi_{n}") + 0.5).otherwise(F.col(f"facts.hi_{n}"))
    placed = wide.withColumn("facts", by_group(ends, over, ends.columns[len(over):])).select(
        *by, *names, *[low(n).alias(f"lo_{n}") for n in names], *[high(n).alias(f"hi_{n}") for n in names])

    def cell(k: int, name: str) -> Column:
        lo, hi = F.col(f"lo_{name}"), F.col(f"hi_{name}")
        spot = F.floor((F.col(name) - lo) / (hi - lo) * bins)
        return F.when(F.col(name).isNotNull(), F.struct(
            F.lit(columns[k]).alias("feature"), lo.alias("low"), hi.alias("high"), F.least(spot, F.lit(bins - 1)).alias("bin")))

    cells = placed.select(*by, F.inline(F.array_compact(F.array(*[cell(k, n) for k, n in enumerate(names)]))))
    counts = cells.groupBy(*by, "feature", "low", "high", "bin").agg(F.count(F.lit(1)).alias("n"))
    # At most ``bins`` rows for each group and feature.
    size = F.sum("n").over(Window.partitionBy(*by, "feature"))
    width = (F.col("high") - F.col("low")) / bins
    return counts.select(
        *by, "feature", "bin", (F.col("low") + width * F.col("bin")).alias("bin_start"),
        (F.col("low") + width * (F.col("bin") + 1)).alias("bin_end"), "n", (F.col("n") / (size * width)).alias("density"))


def box_stats(df: DataFrame, columns: Sequence[str] = tuple(BOX_FEATURES), label: str = LABEL) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 IQR) and outlier count per feature and class.

    Fences are a scalar, so whiskers and outliers are one aggregate of the wide rows.
    """
    names = [f"c{i}" for i in range(len(columns))]
    labelled = df.filter(F.col(label).isNotNull())
    spread = F.col("q2") - F.col("q0")
    fences = quantiles(labelled, columns, [0.25, 0.5, 0.75], [label]).select(
        label, "feature", "q0", "q1", "q2", (F.col("q0") - 1.5 * spread).alias("lo"), (F.col("q2") + 1.5 * spread).alias("hi"))
    # A few numbers for each class and feature.
    facts = ["q0", "q1", "q2", "lo", "hi"]
    row = fences.groupBy(label).agg(*[
        F.max(F.when(F.col("feature") == c, F.struct(*facts))).alias(f"f_{n}") for c, n in zip(columns, names)])
    fenced = labelled.select(label, *[number(c).alias(n) for c, n in zip(columns, names)]).withColumn(
        "facts", by_group(row, [label], row.columns[1:]))
    flat = fenced.select(label, *names, *[F.col(f"facts.f_{n}.{f}").alias(f"{f}_{n}") for n in names for f in facts])
    inside = lambda n: F.col(n).between(F.col(f"lo_{n}"), F.col(f"hi_{n}"))
    totals = flat.groupBy(label).agg(*[col for n in names for col in (
        F.count(n).alias(f"n_{n}"), *[F.max(f"{q}_{n}").alias(f"{q}_{n}") for q in ("q0", "q1", "q2")],
        F.min(F.when(inside(n), F.col(n))).alias(f"low_{n}"), F.max(F.when(inside(n), F.col(n))).alias(f"high_{n}"),
        count_where(~inside(n)).alias(f"out_{n}"))])
    return one_row_to_long(totals, [
        {"feature": F.lit(c), "n": F.col(f"n_{n}"), "q1": F.col(f"q0_{n}"), "median": F.col(f"q1_{n}"), "q3": F.col(f"q2_{n}"),
         "whisker_low": F.col(f"low_{n}"), "whisker_high": F.col(f"high_{n}"), "n_outliers": F.col(f"out_{n}")}
        for c, n in zip(columns, names)], [label]).filter("n > 0")


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return quantiles(df, columns, [0.5]).select("feature", F.col("q0").alias("median"))


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value, the smallest on a tie."""
    counts = categorical_distributions(df, columns)
    best = counts.groupBy("feature").agg(F.min(F.struct((-F.col("n")).alias("rank"), "value")).alias("best"))
    return best.select("feature", F.col("best.value").alias("mode"), (-F.col("best.rank")).alias("n"))


def scale_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation."""
    row = df.agg(*[F.avg(c).alias(f"{c}__mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}__std") for c in columns])
    return one_row_to_long(row, [
        {"feature": F.lit(c), "mean": F.col(f"{c}__mean"), "std": F.col(f"{c}__std")} for c in columns])


def distinct_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return long_texts(df, columns).distinct()
