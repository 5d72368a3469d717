"""Row-wise projections and the outcome derivation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortlens.functions.columns import add_all, band, clip, lookup
from cohortlens.schema import (CLIP_RANGES, EDU_BOOST, GRADE_BANDS, GRADE_FLOOR, LEAKAGE_WORDS, PASS_MARK,
                               SCHOOL_BOOST, SCORE_TERMS, TARGETS)


def without_targets(df: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    return df.drop(*targets)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def clip_columns(df: DataFrame, ranges: dict[str, tuple[float, float]] = CLIP_RANGES) -> DataFrame:
    """Bound each listed column that the table has."""
    return df.withColumns({c: clip(F.col(c), *r) for c, r in ranges.items() if c in df.columns})


def suspicious_names(columns: Sequence[str]) -> list[str]:
    """Columns whose name hints at the target."""
    return [c for c in columns if any(word in c.lower() for word in LEAKAGE_WORDS)]


def name_flags(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: how many values it holds and whether its name hints at the target."""
    from cohortlens.functions.columns import one_row_to_long

    columns = columns or df.columns
    flagged = set(suspicious_names(columns))
    row = df.agg(*[F.count(c).alias(c) for c in columns])
    return one_row_to_long(row, [
        {"column_name": F.lit(c), "n_values": F.col(c), "suspicious": F.lit(c in flagged)} for c in columns])


def weighted_score() -> Column:
    terms = []
    for name, rescale, weight in SCORE_TERMS:
        value = F.col(name) if rescale is None else F.col(name) * rescale
        terms.append(value * weight)
    return add_all(terms)


def group_adjustment(school: Column, education: Column) -> Column:
    """Additive effect of school type and parent education."""
    return lookup(school, SCHOOL_BOOST) + lookup(education, EDU_BOOST)


def grade_band(score: Column) -> Column:
    return band(score, GRADE_BANDS, GRADE_FLOOR)


def pass_label(score: Column) -> Column:
    """1 at or above the pass mark, else 0 (a missing score does not pass)."""
    return F.coalesce((score >= PASS_MARK).cast("bigint"), F.lit(0).cast("bigint"))


def derive_outcome(df: DataFrame, noise: str | None = None) -> DataFrame:
    """Replace the target columns by the ones that follow from the features."""
    score = weighted_score()
    if noise:
        score = score + F.col(noise)
    score = score + group_adjustment(F.col("school_type"), F.col("parent_edu"))
    out = df.drop(*TARGETS).withColumn("final_score", clip(score, 0.0, 100.0))
    return out.withColumns({
        "final_grade_band": grade_band(F.col("final_score")), "passed": pass_label(F.col("final_score"))})


def padded_key(number: Column) -> Column:
    return F.format_string("STU_%06d", number)
