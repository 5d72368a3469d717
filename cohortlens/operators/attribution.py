"""Feature attribution: linear contributions and permutation importance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions.columns import key_hash, one_row_to_long
from cohortlens.operators.metrics import roc_auc
from cohortlens.operators.ordered import bucket_count


def linear_contributions(df: DataFrame, coefficients: dict[str, float], keep: Sequence[str] = ()) -> DataFrame:
    """coefficient * (value - mean) per feature; the means are one scalar subquery each row shares."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in coefficients])).scalar()
    centred = df.withColumn("__means", means)
    return centred.select(*keep, *[
        (F.lit(b) * (F.col(c) - F.col(f"__means.{c}"))).alias(c) for c, b in coefficients.items()])


def importance(contributions: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    row = contributions.agg(*[F.avg(F.abs(F.col(c))).alias(c) for c in features])
    long = one_row_to_long(row, [{"feature": F.lit(c), "importance": F.col(c)} for c in features])
    return long.orderBy(F.desc("importance"), "feature")


def waterfall(contributions: DataFrame, row: Column, features: Sequence[str]) -> DataFrame:
    """Contributions of the one row that meets the condition, largest effect first."""
    long = contributions.filter(row).unpivot([], list(features), "feature", "contribution")
    return long.orderBy(F.desc(F.abs("contribution")), "feature")


def shuffled(df: DataFrame, columns: Sequence[str], key: str, seed: int = 42) -> DataFrame:
    """Add ``<c>__shuffled``: another random row's value for each column.

    Rows stand in the order of a hash of their key and each takes the next row's values, the
    last one the first's. Hash ranges are ordered one by one; the last row of a range takes
    the values of the next range's first row. The permutation covers the whole table and
    depends neither on the number of ranges nor on how the rows are spread.
    """
    ranges = bucket_count(df)
    width = (1 << 31) // ranges + 1
    placed = df.withColumn("__order", F.coalesce(key_hash(df, key, seed), F.lit(0))).withColumn(
        "__range", F.expr(f"__order div {width}"))
    firsts = placed.groupBy("__range").agg(
        F.min(F.struct("__order", F.col(key).alias("__key"), *columns)).alias("first"))
    # One row per range.
    steps = Window.partitionBy().orderBy("__range")
    following = firsts.select(
        "__range", F.coalesce(F.lead("first").over(steps), F.first("first").over(steps)).alias("__next"))
    window = Window.partitionBy("__range").orderBy("__order", key, *columns)
    joined = placed.join(F.broadcast(following), "__range").withColumn("__last", F.lead("__order").over(window).isNull())
    return joined.withColumns({
        f"{c}__shuffled": F.when(F.col("__last"), F.col(f"__next.{c}")).otherwise(F.lead(c).over(window)) for c in columns
    }).select(*df.columns, *[f"{c}__shuffled" for c in columns])


def permutation_importance(df: DataFrame, features: Sequence[str], scorer: Callable[[DataFrame], DataFrame],
                           label: str, key: str, seed: int = 42) -> DataFrame:
    """Drop in AUC when one feature is shuffled, largest first.

    ``scorer`` turns a table into one with ``feature``, the label and ``probability``. Every
    row is expanded in place to one variant per feature plus the unchanged row, so the
    table is shuffled and scored once.
    """
    mixed = shuffled(df, features, key, seed)
    others = [c for c in df.columns if c not in features]
    variants = [F.struct(
        F.lit(name or "").alias("feature"),
        *[F.col(f"{c}__shuffled" if c == name else c).alias(c) for c in features]) for name in [None, *features]]
    scored = scorer(mixed.select(*others, F.inline(F.array(*variants))))
    # One row per feature.
    areas = roc_auc(scored, ["feature"], label).select("feature", "roc_auc")
    baseline = F.max(F.when(F.col("feature") == "", F.col("roc_auc"))).over(Window.partitionBy())
    drops = areas.select("feature", (baseline - F.col("roc_auc")).alias("importance"))
    return drops.filter("feature != ''").orderBy(F.desc("importance"), "feature")
