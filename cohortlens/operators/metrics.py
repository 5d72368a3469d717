"""Binary classifier metrics over a table of (label, probability)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions.columns import count_where, one_row_to_long, to_long
from cohortlens.operators.ordered import distinct_counts, running_totals, with_buckets
from cohortlens.schema import CALIBRATION_BINS, DECISION_THRESHOLD, MIN_GROUP_SIZE, SWEEP_THRESHOLDS


def predicted(probability: str = "probability", threshold: float = DECISION_THRESHOLD) -> Column:
    return (F.col(probability) >= threshold).cast("bigint")


def confusion_counts(df: DataFrame, by: Sequence[str] = (), label: str = "label",
                     prediction: Column | None = None) -> DataFrame:
    pred = predicted() if prediction is None else prediction
    hit = lambda y, p: count_where((F.col(label) == y) & (pred == p))
    return df.groupBy(*by).agg(
        hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp"))


def _rates(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.select(
        *keep, (tp + fp + fn + tn).alias("n"),
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"))


def binary_metrics(df: DataFrame, by: Sequence[str] = (), label: str = "label",
                   prediction: Column | None = None) -> DataFrame:
    """n, accuracy, precision, recall and F1; null where a denominator is zero."""
    return _rates(confusion_counts(df, by, label, prediction), by)


def classification_report(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted averages, for each group.

    Undefined ratios count as zero in the averages.
    """
    counts = confusion_counts(df, by, label)
    per_class = []
    for name, hit, missed, wrong in (("0", "tn", "fp", "fn"), ("1", "tp", "fn", "fp")):
        h, m, w = F.col(hit), F.col(missed), F.col(wrong)
        zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
        per_class.append((name, zero(h, h + w), zero(h, h + m), zero(2 * h, 2 * h + m + w), h + m))
    (_, *first), (_, *second) = per_class
    total = first[3] + second[3]
    macro = [(a + b) / 2 for a, b in zip(first[:3], second[:3])]
    weighted = [F.coalesce(F.try_divide(a * first[3] + b * second[3], total), F.lit(0.0))
                for a, b in zip(first[:3], second[:3])]
    rows = [*per_class, ("macro avg", *macro, total), ("weighted avg", *weighted, total)]
    names = ("class", "precision", "recall", "f1", "support")
    return one_row_to_long(counts, [
        dict(zip(names, (F.lit(name), *cols), strict=True)) for name, *cols in rows], by)


def brier_score(df: DataFrame, by: Sequence[str] = (), label: str = "label",
                probability: str = "probability") -> DataFrame:
    error = F.col(probability) - F.col(label)
    return df.groupBy(*by).agg(F.avg(error * error).alias("brier_score"))


def roc_auc(df: DataFrame, by: Sequence[str] = (), label: str = "label",
            probability: str = "probability") -> DataFrame:
    """Exact ROC-AUC with tied scores counted half; null when a group has one class.

    Rows shrink to one per (group, score). Each value range reports its positives, its
    negatives and the pairs won inside it, and the pairs won across ranges follow from
    the totals per range.
    """
    counts = distinct_counts(
        df, by, probability, pos=F.sum(F.col(label).cast("bigint")), neg=F.sum(1 - F.col(label).cast("bigint")))
    inside = Window.partitionBy(*by, "bucket").orderBy(probability)
    below = F.sum("neg").over(inside) - F.col("neg")
    won = F.col("pos").cast("double") * (below + F.col("neg") / 2.0)
    ranges = (
        with_buckets(counts, probability, ["pos", "neg"]).withColumn("won", won)
        .groupBy(*by, "bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("won").alias("won")))
    # At most one row per group and value range.
    earlier = F.sum("neg").over(Window.partitionBy(*by).orderBy("bucket")) - F.col("neg")
    pairs = ranges.withColumn("won", F.col("won") + F.col("pos").cast("double") * earlier)
    return pairs.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.try_divide(F.sum("won"), F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("roc_auc"))


def roc_points(df: DataFrame, label: str = "label", probability: str = "probability") -> DataFrame:
    """Every ROC point, one per distinct score: threshold, false and true positive rate."""
    run = _descending_counts(df, label, probability)
    return run.select(
        F.col(probability).alias("threshold"),
        F.try_divide("cum_neg", "total_neg").alias("fpr"), F.try_divide("cum_pos", "total_pos").alias("tpr"))


def pr_points(df: DataFrame, label: str = "label", probability: str = "probability") -> DataFrame:
    run = _descending_counts(df, label, probability)
    return run.select(
        F.col(probability).alias("threshold"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        F.try_divide("cum_pos", "total_pos").alias("recall"))


def _descending_counts(df: DataFrame, label: str, probability: str) -> DataFrame:
    y = F.col(label).cast("bigint")
    counts = distinct_counts(df, [], probability, pos=F.sum(y), neg=F.sum(1 - y))
    return running_totals(counts, probability, ["pos", "neg"], descending=True)


def threshold_sweep(df: DataFrame, thresholds: Sequence[float] = tuple(SWEEP_THRESHOLDS), label: str = "label",
                    probability: str = "probability") -> DataFrame:
    """F1 at each threshold: conditional counts in one pass, no join with the thresholds."""
    p, y = F.col(probability), F.col(label) == 1
    row = df.agg(
        count_where(y).alias("pos"),
        *[count_where(p >= t).alias(f"pp{i}") for i, t in enumerate(thresholds)],
        *[count_where(y & (p >= t)).alias(f"tp{i}") for i, t in enumerate(thresholds)])
    return one_row_to_long(row, [
        {"threshold": F.lit(t), "f1": F.try_divide(2 * F.col(f"tp{i}"), F.col(f"pp{i}") + F.col("pos"))}
        for i, t in enumerate(thresholds)])


def calibration_curve(df: DataFrame, bins: int = CALIBRATION_BINS, label: str = "label",
                      probability: str = "probability") -> DataFrame:
    """Observed rate and mean score per equal-width bin (lo, hi]; empty bins are absent.

    Rows without a label or a score are left out.
    """
    df = df.filter(F.col(label).isNotNull() & F.col(probability).isNotNull())
    spot = F.greatest(F.ceil(F.col(probability) * bins) - 1, F.lit(0)).alias("bin")
    return df.groupBy(spot).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("fraction_positive"),
        F.avg(probability).alias("mean_probability"))


def fairness_table(df: DataFrame, dimensions: Sequence[str], label: str = "label", probability: str = "probability",
                   min_size: int = MIN_GROUP_SIZE) -> DataFrame:
    """Size, pass rate, mean score, AUC and Brier score per level of each dimension.

    Null levels, rows without a label or a score, and groups below ``min_size`` are left
    out; a group with one class gets an AUC of 0.
    """
    df = df.filter(F.col(label).isNotNull() & F.col(probability).isNotNull())
    narrow = df.select(F.col(label).cast("bigint").alias("label"), F.col(probability).alias("probability"), *dimensions)
    long = to_long(narrow, dimensions, ["label", "probability"], "string", "dimension", "level")
    by = ["dimension", "level"]
    # Rows with equal dimension, level, score and label fold into one before anything else.
    counts = long.groupBy(*by, "probability").agg(
        F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    error = lambda y: (F.col("probability") - y) * (F.col("probability") - y)
    inside = Window.partitionBy(*by, "bucket").orderBy("probability")
    below = F.sum("neg").over(inside) - F.col("neg")
    rows = F.col("pos") + F.col("neg")
    ranges = (
        with_buckets(counts, "probability", ["pos", "neg"])
        .withColumn("won", F.col("pos").cast("double") * (below + F.col("neg") / 2.0))
        .groupBy(*by, "bucket")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("won").alias("won"),
             F.sum(F.col("probability") * rows).alias("mass"),
             F.sum(error(1.0) * F.col("pos") + error(0.0) * F.col("neg")).alias("squares")))
    earlier = F.sum("neg").over(Window.partitionBy(*by).orderBy("bucket")) - F.col("neg")
    n = F.sum("pos") + F.sum("neg")
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return (
        ranges.withColumn("won", F.col("won") + F.col("pos").cast("double") * earlier)
        .groupBy(*by)
        .agg(n.alias("size"), (F.sum("pos") / n).alias("pass_rate"), (F.sum("mass") / n).alias("mean_probability"),
             F.coalesce(F.try_divide(F.sum("won"), pairs), F.lit(0.0)).alias("roc_auc"),
             (F.sum("squares") / n).alias("brier_score"))
        .filter(F.col("size") >= min_size))


def fold_summary(scores: DataFrame) -> DataFrame:
    """Mean, population standard deviation and the +-2 std half-width per (model, metric)."""
    return scores.groupBy("model", "metric").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"),
        (F.stddev_pop("score") * 2.0).alias("spread"))


def rank_models(summary: DataFrame, metric: str = "f1") -> DataFrame:
    """Models ranked by their mean on one metric; one row per model, so the window is small."""
    chosen = summary.filter(F.col("metric") == metric)
    rank = F.row_number().over(Window.orderBy(F.desc("mean"), "model"))
    return chosen.select(rank.alias("rank"), "model", "mean")


def best_by(df: DataFrame, name: str, score: str) -> DataFrame:
    """The name with the highest score, the first by name on a tie."""
    best = df.agg(F.min(F.struct((-F.col(score)).alias("key"), F.col(name).alias("name"))).alias("best"))
    return best.select(F.col("best.name").alias(name), (-F.col("best.key")).alias(score))
