"""Risk levels, factors, drivers and recommendations; prediction statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.functions.columns import add_all, band, count_where, fixed_text
from cohortlens.schema import (DECISION_THRESHOLD, DRIVER_RULES, FACTOR_RULES, LEVEL_RECOMMENDATIONS,
                               RECENT_PREDICTIONS, RECOMMENDATION_RULES, RETAINED_PREDICTIONS, RISK_FLOOR,
                               RISK_LEVELS, TOP_FACTORS, TOP_RECOMMENDATIONS)


def risk_level(probability: Column) -> Column:
    """Level from the probability of passing: a high probability is a low risk."""
    return band(probability, RISK_LEVELS, RISK_FLOOR)


def confidence(probability: Column) -> Column:
    return F.abs(probability - 0.5) * 2


def with_risk(df: DataFrame, probability: str = "probability", at: Column | None = None) -> DataFrame:
    """Add the prediction record of a scored row; ``at`` is the time to stamp it with."""
    p = F.col(probability)
    columns = {"risk_probability": p, "risk_level": risk_level(p), "prediction": p >= DECISION_THRESHOLD,
               "confidence": confidence(p)}
    if at is not None:
        columns["timestamp"] = at
    return df.withColumns(columns)


def risk_factors(limit: int = TOP_FACTORS) -> Column:
    """Array of (factor, description, severity), high severity first, then rule order."""
    def entries(severity: str) -> list[Column]:
        out = []
        for column, sign, bound, factor, level, before, digits, after in FACTOR_RULES:
            if level != severity:
                continue
            value = F.col(column).cast("double")
            hit = value < bound if sign == "<" else value > bound
            text = F.concat(F.lit(before), fixed_text(value, digits), F.lit(after))
            out.append(F.when(hit, F.struct(
                F.lit(factor).alias("factor"), text.alias("description"), F.lit(level).alias("severity"))))
        return out

    return F.slice(F.array_compact(F.array(*entries("high"), *entries("medium"))), 1, limit)


def recommendations(level: Column, limit: int = TOP_RECOMMENDATIONS) -> Column:
    """First messages in rule order: feature rules, then those of the risk level."""
    entries = [F.when(F.col(c) < bound, F.lit(text)) for c, bound, texts in RECOMMENDATION_RULES for text in texts]
    entries += [F.when(level == name, F.lit(text)) for name, texts in LEVEL_RECOMMENDATIONS.items() for text in texts]
    return F.slice(F.array_compact(F.array(*entries)), 1, limit)


def driver_columns() -> dict[str, Column]:
    out = {}
    for name, columns, target in DRIVER_RULES:
        value = F.col(columns[0]) if len(columns) == 1 else add_all(F.col(c) for c in columns) / len(columns)
        gap = (F.lit(target) - value) / target
        out[name] = F.when(gap.isNotNull(), F.greatest(gap, F.lit(0.0)))
    return out


def risk_drivers() -> Column:
    """Map of driver name to its shortfall in [0, 1]."""
    return F.create_map(*[part for name, col in driver_columns().items() for part in (F.lit(name), col)])


def explain(df: DataFrame, key: str, probability: str = "probability") -> DataFrame:
    """Explanation record per scored row, one projection."""
    return df.select(
        key, F.col(probability).alias("risk_probability"), risk_level(F.col(probability)).alias("risk_level"),
        risk_factors().alias("top_factors"), recommendations(risk_level(F.col(probability))).alias("recommendations"),
        risk_drivers().alias("risk_drivers"))


def batch_summary(df: DataFrame, probability: str = "probability") -> DataFrame:
    """Counts of a scored batch. An empty batch gives zero counts and no average."""
    p = F.col(probability)
    level = risk_level(p)
    return df.agg(
        F.count(F.lit(1)).alias("total_students"), F.avg(p).alias("avg_risk_probability"),
        count_where(level == "High Risk").alias("high_risk_count"),
        count_where(level == "Medium Risk").alias("medium_risk_count"),
        count_where(level == "Low Risk").alias("low_risk_count"),
        count_where(p >= DECISION_THRESHOLD).alias("predicted_pass_count"),
        count_where(~(p >= DECISION_THRESHOLD)).alias("predicted_fail_count"))


def retain_latest(df: DataFrame, time: str, key: str, n: int = RETAINED_PREDICTIONS) -> DataFrame:
    """Newest rows by time (a top-k, so no global sort)."""
    return df.orderBy(F.desc(time), F.desc(key)).limit(n)


def recent_stats(df: DataFrame, time: str, key: str, probability: str = "probability",
                 n: int = RECENT_PREDICTIONS) -> DataFrame:
    """Log size and statistics of the newest predictions; an empty log has only a message."""
    recent = retain_latest(df.select(time, key, probability), time, key, n)
    high = risk_level(F.col(probability)) == RISK_FLOOR
    row = recent.agg(
        F.count(F.lit(1)).alias("recent_predictions"), F.avg(probability).alias("avg_probability"),
        (F.avg(high.cast("double")) * 100.0).alias("high_risk_percentage"))
    empty = F.when(F.col("recent_predictions") == 0, F.lit("No predictions made yet"))
    return row.select(df.agg(F.count(F.lit(1))).scalar().alias("total_predictions"), "*", empty.alias("message"))


def hourly_counts(df: DataFrame, time: str = "ts", probability: str = "probability") -> DataFrame:
    hour = F.window(time, "1 hour")
    return df.groupBy(hour).agg(
        F.count(F.lit(1)).alias("n"), F.avg(probability).alias("avg_probability"),
        count_where(risk_level(F.col(probability)) == RISK_FLOOR).alias("high_risk"),
    ).select(F.col("window.start").alias("hour_start"), "n", "avg_probability", "high_risk")

