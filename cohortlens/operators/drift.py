"""Distribution and performance drift between a reference and a current population.

Both populations live in one table with a ``side`` column holding "reference" or
"current".
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cohortlens.functions.columns import count_where
from cohortlens.functions.distributions import chi_square_p, ks_p
from cohortlens.operators.metrics import binary_metrics, predicted, roc_auc
from cohortlens.operators.ordered import number, with_buckets
from cohortlens.operators.profile import histogram, long_numbers, long_texts
from cohortlens.schema import DRIFT_ALPHA, DRIFT_SHARE, F1_DEGRADATION, KEY, TARGETS
from cohortlens.session import share_package

REF, CUR = "reference", "current"
METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc"]
#: Value ranges of a feature whose counts are compared first.
RANGES = 512


def tag_sides(reference: DataFrame, current: DataFrame) -> DataFrame:
    """One table of the columns both sides have."""
    shared = [c for c in reference.columns if c in current.columns]
    return reference.select(*shared, F.lit(REF).alias("side")).unionByName(
        current.select(*shared, F.lit(CUR).alias("side")))


def feature_kinds(df: DataFrame, exclude: Sequence[str] = (KEY, *TARGETS, "side")) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature columns; keys and targets are not features.

    Dates and timestamps are compared as categories, and nested types cannot be compared.
    """
    fields = [f for f in df.schema.fields if f.name not in exclude]
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    texts = (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    other = [f.name for f in fields if not isinstance(f.dataType, (T.NumericType, *texts))]
    if other:
        raise ValueError(f"no drift test for the types of {', '.join(other)}: leave these columns out")
    return numeric, [f.name for f in fields if isinstance(f.dataType, texts)]


def side_counts(long: DataFrame) -> DataFrame:
    """(feature, value) with how often each side has it."""
    return long.groupBy("feature", "value").agg(
        count_where(F.col("side") == REF).alias("n_ref"), count_where(F.col("side") == CUR).alias("n_cur"))


def ks_from_counts(counts: DataFrame) -> DataFrame:
    """Two-sample KS statistic per feature from counts per (feature, value).

    Inside a value range the gap between the two distribution functions is a constant
    plus a local part, so each range only reports its largest and smallest local gap. A
    feature with an empty side is left out.
    """
    bucketed = with_buckets(counts, "value", ["n_ref", "n_cur"], feature="feature")
    inside = Window.partitionBy("feature", "bucket").orderBy("value")
    share = lambda n, total: F.try_divide(n, F.col(total))
    gap = (share(F.sum("n_ref").over(inside), "total_n_ref") - share(F.sum("n_cur").over(inside), "total_n_cur"))
    ranges = bucketed.withColumn("gap", gap).groupBy("feature", "bucket").agg(
        F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"), F.max("gap").alias("gap_max"),
        F.min("gap").alias("gap_min"), F.max("total_n_ref").alias("size_ref"), F.max("total_n_cur").alias("size_cur"))
    order = Window.partitionBy("feature").orderBy("bucket")
    before = (share(F.sum("n_ref").over(order) - F.col("n_ref"), "size_ref")
              - share(F.sum("n_cur").over(order) - F.col("n_cur"), "size_cur"))
    widest = F.greatest(F.abs(F.col("before") + F.col("gap_max")), F.abs(F.col("before") + F.col("gap_min")))
    out = ranges.withColumn("before", before).groupBy("feature").agg(
        F.max("size_ref").alias("size_ref"), F.max("size_cur").alias("size_cur"), F.max(widest).alias("ks_statistic"))
    return out.filter("size_ref > 0 AND size_cur > 0")


COUNTS = ("feature int, range int, n_ref long, n_cur long, low double, high double, "
          "s1_ref double, s2_ref double, s1_cur double, s2_cur double")
CELLS = "feature int, range int, value double, n_ref long, n_cur long"


def placed_batches(batches: Iterator[pa.RecordBatch], edges: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(column, values, their ranges, whether they are the reference's) of the numbers in each column of each batch; the side comes first."""
    for batch in batches:
        reference, known = (np.array([s == side for s in batch.column(0).to_pylist()], bool) for side in (REF, CUR))
        known |= reference
        for k, limits in enumerate(edges):
            values = batch.column(k + 1).to_numpy(zero_copy_only=False).astype(float)
            use = np.flatnonzero(known & ~np.isnan(values))
            if len(use):
                yield k, values[use], np.searchsorted(limits, values[use], side="left"), reference[use]


def ks_statistics(df: DataFrame, columns: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """Two-sample KS statistic, sizes and moments per feature; a feature with an empty side is left out.

    Ranges are cut at quantiles of a sketch of both sides together. Counts per range make the gap between the two
    distribution functions exact at the ends of each range and bound it inside, where it cannot pass the share of
    either side that lies there. Only ranges whose bound exceeds the widest gap at any end are exchanged by value and
    ordered. Three scans: sketch, counts with moments, open ranges; what comes to the driver are counts per range.
    """
    spark, columns = df.sparkSession, list(columns)
    share_package(spark)
    wide = df.select(F.col("side"), *[number(c).alias(f"c{i}") for i, c in enumerate(columns)])
    probs = [i / ranges for i in range(1, ranges)]
    sketch = wide.agg(*[F.percentile_approx(f"c{i}", probs, 10 * ranges) for i in range(len(columns))]).first()
    edges = [np.unique(np.array(e or [], float)) for e in sketch]
    # Sums are taken from the middle of each column, so that large values of little spread lose no digits.
    middle = [float(e[len(e) // 2]) if len(e) else 0.0 for e in edges]
    sides = ("ref", "cur")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros((2, len(e) + 1), np.int64) for e in edges]
        low, high = ([np.full(len(e) + 1, start) for e in edges] for start in (np.inf, -np.inf))
        sums = np.zeros((len(edges), 2, 2))
        for k, values, place, reference in placed_batches(batches, edges):
            for side, own in enumerate((reference, ~reference)):
                n[k][side] += np.bincount(place[own], minlength=len(edges[k]) + 1)
                off = values[own] - middle[k]
                sums[k, side] += off.sum(), (off * off).sum()
            np.minimum.at(low[k], place, values)
            np.maximum.at(high[k], place, values)
        for k in range(len(edges)):
            seen = np.flatnonzero(n[k].sum(axis=0))
            if len(seen):
                # The sums of the column stand beside its first range.
                beside = [np.where(np.arange(len(seen)) == 0, sums[k, side, power], 0.0) for side in range(2) for power in range(2)]
                columns_ = [np.full(len(seen), k, np.int32), seen.astype(np.int32), n[k][0][seen], n[k][1][seen], low[k][seen], high[k][seen], *beside]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns_], names=[c.split()[0] for c in COUNTS.split(", ")])

    total = wide.mapInArrow(count, COUNTS).groupBy("feature", "range").agg(
        *[F.sum(c).alias(c) for c in ("n_ref", "n_cur")], F.min("low").alias("low"), F.max("high").alias("high"),
        *[F.sum(f"{s}_{t}").alias(f"{s}_{t}") for t in sides for s in ("s1", "s2")]).toPandas()  # ranges rows a feature
    rows, opened = [], {}
    for k, own in total.sort_values("range").groupby("feature"):
        n = {t: own[f"n_{t}"].to_numpy() for t in sides}
        size = {t: int(n[t].sum()) for t in sides}
        if not all(size.values()):
            continue
        after = n["ref"].cumsum() / size["ref"] - n["cur"].cumsum() / size["cur"]
        before = np.concatenate([[0.0], after[:-1]])
        widest = np.abs(after).max()
        bound = np.maximum(before + n["ref"] / size["ref"], n["cur"] / size["cur"] - before)
        inside = (own["low"].to_numpy() < own["high"].to_numpy()) & (bound > widest)
        opened |= {(int(k), int(r)): (float(b), size["ref"], size["cur"]) for r, b in zip(own["range"][inside], before[inside])}
        moments = []
        for t in sides:
            first, second = float(own[f"s1_{t}"].sum()) / size[t], float(own[f"s2_{t}"].sum())
            spread = max(second - size[t] * first * first, 0.0)
            moments.append((middle[int(k)] + first, math.sqrt(spread / (size[t] - 1)) if size[t] > 1 else None))
        rows.append((columns[int(k)], int(k), size["ref"], size["cur"], float(widest), moments[0][0], moments[1][0], moments[0][1], moments[1][1]))
    out = spark.createDataFrame(rows, "feature string, k int, size_ref long, size_cur long, end_gap double, ref_mean double, "
                                      "cur_mean double, ref_std double, cur_std double")
    names = ["ref_mean", "cur_mean", "ref_std", "cur_std"]
    if not opened:
        return out.select("feature", "size_ref", "size_cur", F.col("end_gap").alias("ks_statistic"), *names)
    wanted = [np.isin(np.arange(len(e) + 1), [r for f, r in opened if f == k]) for k, e in enumerate(edges)]

    def open_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, values, place, reference in placed_batches(batches, edges):
            use = wanted[k][place]
            if use.any():
                found, at = np.unique(values[use], return_inverse=True)
                n = [np.bincount(at[own[use]], minlength=len(found)) for own in (reference, ~reference)]
                where = np.searchsorted(edges[k], found, side="left")
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(found), k, np.int32), where.astype(np.int32), found, *n)],
                                                 names=[c.split()[0] for c in CELLS.split(", ")])

    starts = spark.createDataFrame([(f, r, *v) for (f, r), v in opened.items()], "feature int, range int, before double, size_ref long, size_cur long")
    cells = wide.mapInArrow(open_cells, CELLS).groupBy("feature", "range", "value").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    order = Window.partitionBy("feature", "range").orderBy("value")
    # ``starts`` has a row for each open range, and the result one for each feature.
    gap = (F.col("before") + F.sum("n_ref").over(order) / F.col("size_ref") - F.sum("n_cur").over(order) / F.col("size_cur"))
    inner = cells.join(F.broadcast(starts), ["feature", "range"]).select(F.col("feature").alias("k"), F.abs(gap).alias("gap")).groupBy("k").agg(
        F.max("gap").alias("gap"))
    return out.join(F.broadcast(inner), "k", "left").select(
        "feature", "size_ref", "size_cur", F.greatest("end_gap", F.coalesce("gap", F.lit(0.0))).alias("ks_statistic"), *names)


def ks_drift(df: DataFrame, columns: Sequence[str], alpha: float = DRIFT_ALPHA) -> DataFrame:
    """KS statistic, p-value, flag and moments per numeric feature."""
    stats = ks_statistics(df, columns)
    stats = stats.withColumn("p_value", ks_p(F.col("ks_statistic"), F.col("size_ref"), F.col("size_cur")))
    return stats.select("feature", "ks_statistic", "p_value", (F.col("p_value") < alpha).alias("drift_detected"),
                        "ref_mean", "cur_mean", "ref_std", "cur_std")


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, n_ref, n_cur); a value one side lacks counts zero there."""
    return side_counts(long_texts(df, columns, ["side"]))


def align_categories(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same from two separate tables, as a full outer join of their counts."""
    count = lambda df, name: long_texts(df, columns).groupBy("feature", "value").agg(F.count(F.lit(1)).alias(name))
    joined = count(reference, "n_ref").join(count(current, "n_cur"), ["feature", "value"], "full_outer")
    return joined.na.fill(0, ["n_ref", "n_cur"])


def chi_square_from_counts(counts: DataFrame, yates: bool = True) -> DataFrame:
    """Chi-square of the 2 x k table per feature; Yates' correction when k = 2."""
    totals = counts.groupBy("feature").agg(
        F.sum("n_ref").alias("size_ref"), F.sum("n_cur").alias("size_cur"), F.count(F.lit(1)).alias("levels"))
    # One row per feature, a driver-known set.
    sized = counts.join(F.broadcast(totals.filter("size_ref > 0 AND size_cur > 0")), "feature")
    size = F.col("size_ref") + F.col("size_cur")

    def part(observed: Column, side_size: Column) -> Column:
        expected = side_size * ((F.col("n_ref") + F.col("n_cur")) / size)
        off = F.abs(observed - expected)
        if yates:
            off = F.when(F.col("levels") == 2, F.greatest(off - 0.5, F.lit(0.0))).otherwise(off)
        return off * off / expected

    both = part(F.col("n_ref"), F.col("size_ref")) + part(F.col("n_cur"), F.col("size_cur"))
    return sized.groupBy("feature", "size_ref", "size_cur", "levels").agg(F.sum(both).alias("chi2_statistic")).select(
        "feature", "chi2_statistic", (F.col("levels") - 1).alias("dof"), "size_ref", "size_cur")


def chi_square_drift(df: DataFrame, columns: Sequence[str], alpha: float = DRIFT_ALPHA, yates: bool = True) -> DataFrame:
    stats = chi_square_from_counts(category_counts(df, columns), yates=yates)
    stats = stats.withColumn("p_value", chi_square_p("chi2_statistic", "dof"))
    return stats.select("feature", "chi2_statistic", "dof", "p_value", (F.col("p_value") < alpha).alias("drift_detected"))


def drift_table(df: DataFrame, numeric: Sequence[str] | None = None, categorical: Sequence[str] | None = None,
                alpha: float = DRIFT_ALPHA) -> DataFrame:
    """One row per feature, numeric ones by KS and the others by chi-square."""
    if numeric is None or categorical is None:
        numeric, categorical = feature_kinds(df)
    parts = []
    if numeric:
        parts.append(ks_drift(df, numeric, alpha).select(
            "feature", F.lit("numerical").alias("feature_type"), F.col("ks_statistic").alias("statistic"),
            "p_value", "drift_detected", "ref_mean", "cur_mean", "ref_std", "cur_std"))
    if categorical:
        none = F.lit(None).cast("double")
        parts.append(chi_square_drift(df, categorical, alpha).select(
            "feature", F.lit("categorical").alias("feature_type"), F.col("chi2_statistic").alias("statistic"),
            "p_value", "drift_detected", none.alias("ref_mean"), none.alias("cur_mean"),
            none.alias("ref_std"), none.alias("cur_std")))
    if not parts:
        raise ValueError("no features to compare")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def top_drifted(table: DataFrame, n: int = 10) -> DataFrame:
    """Drifted features, smallest p-value first, then largest statistic."""
    return table.filter("drift_detected").orderBy("p_value", F.desc("statistic"), "feature").limit(n)


def performance_drift(scored: DataFrame, label: str = "label", probability: str = "probability") -> DataFrame:
    """Five metrics and size per side, and the drop from reference to current of three.

    A table without labels yields one row holding an error message.
    """
    if label not in scored.columns:
        return scored.limit(1).select(F.lit("No labels available").alias("error"))
    # Undefined ratios score 0. Two rows, one per side.
    rates = binary_metrics(scored, ["side"], label, predicted(probability)).na.fill(0.0, METRICS[:4])
    both = rates.join(F.broadcast(roc_auc(scored, ["side"], label, probability).select("side", "roc_auc")), "side")
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    row = both.agg(*[pick(side, c).alias(f"{side}_{c}") for side in (REF, CUR) for c in ["n", *METRICS]])
    drops = [(F.col(f"{REF}_{m}") - F.col(f"{CUR}_{m}")).alias(f"{m}_degradation") for m in ("accuracy", "f1", "roc_auc")]
    return row.select("*", *drops)


def drift_summary(table: DataFrame, performance: DataFrame | None = None) -> DataFrame:
    """Counts and share of drifted features and the flags that call for attention."""
    row = table.agg(
        F.count(F.lit(1)).alias("total_features"), count_where(F.col("drift_detected")).alias("features_with_drift"))
    drop = F.lit(0.0) if performance is None else F.coalesce(performance.select("f1_degradation").scalar(), F.lit(0.0))
    significant = F.col("features_with_drift") > F.col("total_features") * DRIFT_SHARE
    return row.select(
        "*", F.coalesce(F.try_divide(F.col("features_with_drift") * 100.0, F.col("total_features")), F.lit(0.0))
        .alias("drift_percentage"), drop.alias("f1_degradation"), significant.alias("significant_drift"),
        (drop > F1_DEGRADATION).alias("performance_degradation"),
        (significant | (drop > F1_DEGRADATION)).alias("needs_attention"))


def category_bars(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count and share of each level on both sides; a level that one side lacks has a share of 0 there."""
    side = lambda name, n: F.struct(F.lit(name).alias("side"), F.col(n).alias("n"))
    long = category_counts(df, columns).select("feature", "value", F.inline(F.array(side(REF, "n_ref"), side(CUR, "n_cur"))))
    sizes = long.groupBy("feature", "side").agg(F.sum("n").alias("size"))
    return long.join(sizes, ["feature", "side"]).select(
        "side", "feature", "value", "n", F.coalesce(F.try_divide("n", "size"), F.lit(0.0)).alias("share"))


def drift_visuals(df: DataFrame, table: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Histograms and category bars of the ``n`` most drifted features of a drift table."""
    numeric, texts = feature_kinds(df)
    top = top_drifted(table, n).select("feature")
    return (drift_histograms(df, numeric).join(top, "feature", "left_semi"),
            category_bars(df, texts).join(top, "feature", "left_semi"))


def drift_histograms(df: DataFrame, columns: Sequence[str], shared_range: bool = False) -> DataFrame:
    """Density histograms of each numeric feature on both sides."""
    return histogram(df, columns, ["side"], shared_range=shared_range)
