"""Schema checks, value rules, validation and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortlens.functions.columns import add_all, count_where, one_row_to_long
from cohortlens.sources.files import read_bodies
from cohortlens.schema import (CATEGORICAL_FEATURES, CLIP_RANGES, ENTITY_SCHEMA, KEY, MAX_MISSING_RATE,
                               NON_NEGATIVE_RULES, NUMERIC_FEATURES, RANGE_RULES)

Rule = tuple[str, float | None, float | None, str]


def require_columns(df: DataFrame, schema: T.StructType = ENTITY_SCHEMA) -> DataFrame:
    missing = [c for c in schema.names if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def _converted(field: T.StructField) -> Column:
    return F.col(field.name).try_cast(field.dataType)


def cast_checks(df: DataFrame, schema: T.StructType = ENTITY_SCHEMA) -> list[Column]:
    """Aggregates: non-null values of each column and how many of them do not convert."""
    fields = [f for f in schema.fields if f.name in df.columns]
    return [*[F.count(f.name).alias(f"n_{f.name}") for f in fields],
            *[count_where(F.col(f.name).isNotNull() & _converted(f).isNull()).alias(f"bad_{f.name}") for f in fields]]


def cast_failures(df: DataFrame, schema: T.StructType = ENTITY_SCHEMA) -> DataFrame:
    """Per column: target type, non-null values and how many of them do not convert."""
    fields = [f for f in schema.fields if f.name in df.columns]
    row = df.agg(*cast_checks(df, schema))
    return one_row_to_long(row, [
        {"column_name": F.lit(f.name), "target_type": F.lit(f.dataType.simpleString()),
         "n_values": F.col(f"n_{f.name}"), "n_failed": F.col(f"bad_{f.name}")} for f in fields])


def best_effort_cast(df: DataFrame, schema: T.StructType = ENTITY_SCHEMA) -> tuple[DataFrame, list[str]]:
    """Convert each column that converts as a whole; keep the others and name them."""
    failed = [r.column_name for r in cast_failures(df, schema).filter("n_failed > 0").collect()]
    return cast_all(df, failed, schema), failed


def cast_all(df: DataFrame, kept: Sequence[str], schema: T.StructType = ENTITY_SCHEMA) -> DataFrame:
    """Columns of the schema converted, but for those ``kept`` as they are."""
    wanted = {f.name: f for f in schema.fields if f.name not in kept}
    return df.select(*[_converted(wanted[c]).alias(c) if c in wanted else F.col(c) for c in df.columns])


def duplicate_key_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key; null keys count as equal."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in the stated order.

    An aggregate instead of ``row_number``: each task keeps one candidate per key, so a
    key that holds a large share of the rows is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    ordered = [*order, *[c for c in rest if c not in order]]
    best = df.groupBy(*keys).agg(F.min(F.struct(*ordered)).alias("first"))
    return best.select(*[F.col(c) if c in keys else F.col(f"first.{c}") for c in df.columns])


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of nulls per column, largest first, in one pass."""
    columns = columns or df.columns
    return missing_rates(df.agg(*missing_checks(columns)), columns)


def missing_checks(columns: Sequence[str]) -> list[Column]:
    """Aggregates: the share of nulls of each column."""
    return [F.avg(F.col(c).isNull().cast("double")).alias(f"missing_{c}") for c in columns]


def missing_rates(row: DataFrame, columns: Sequence[str]) -> DataFrame:
    long = one_row_to_long(row, [{"column_name": F.lit(c), "missing_rate": F.col(f"missing_{c}")} for c in columns])
    return long.orderBy(F.desc("missing_rate"), "column_name")


def high_missing(df: DataFrame, columns: Sequence[str] | None = None, limit: float = MAX_MISSING_RATE) -> DataFrame:
    return missing_profile(df, columns).filter(F.col("missing_rate") > limit)


def _breaks(rule: Rule) -> Column:
    column, low, high, _ = rule
    value = F.col(column)
    bad = F.lit(False)
    if low is not None:
        bad = bad | (value < low)
    if high is not None:
        bad = bad | (value > high)
    return bad


def rule_violations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows breaking each rule, all rules in one aggregate."""
    return rule_counts(df.agg(*rule_checks(rules)), rules)


def rule_checks(rules: Sequence[Rule]) -> list[Column]:
    """Aggregates: rows that break each rule."""
    return [count_where(_breaks(r)).alias(f"r{i}") for i, r in enumerate(rules)]


def rule_counts(row: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return one_row_to_long(row, [
        {"column_name": F.lit(r[0]), "issue": F.lit(r[3]), "n_bad": F.col(f"r{i}")} for i, r in enumerate(rules)])


def issue_messages(df: DataFrame, rules: Sequence[Rule] = (*RANGE_RULES, *NON_NEGATIVE_RULES)) -> DataFrame:
    return rule_violations(df, rules).filter("n_bad > 0").select("issue", "n_bad")


def validate_records(df: DataFrame, bounds: dict[str, tuple[float, float]] = CLIP_RANGES,
                     required: Sequence[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """Add ``errors``: one text per missing, non-numeric or out-of-range feature.

    Works on typed columns and on raw text. A feature the table lacks is an error of
    every row.
    """
    checks = []
    for name, (low, high) in bounds.items():
        if name not in df.columns:
            checks.append(F.lit(f"{name}: missing"))
            continue
        number = F.col(name).try_cast("double")
        checks.append(
            F.when(F.col(name).isNull(), f"{name}: missing")
            .when(number.isNull(), f"{name}: not a number")
            .when(~number.between(low, high), f"{name}: outside {low:g}-{high:g}"))
    for name in required:
        if name not in df.columns:
            checks.append(F.lit(f"{name}: missing"))
        else:
            checks.append(F.when(F.col(name).isNull(), f"{name}: missing"))
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def validate_bodies(df: DataFrame, body: str, bounds: dict[str, tuple[float, float]] = CLIP_RANGES,
                    required: Sequence[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """Request bodies as JSON text: their fields and ``errors``, the only one being ``body: not a JSON object`` where it is none.

    Numbers written as text count as numbers if they convert; other text, lists and objects are "not a number".
    """
    fields = [*bounds, *[c for c in required if c not in bounds]]
    checked = validate_records(read_bodies(df, body, fields), bounds, required)
    broken = F.array(F.lit("body: not a JSON object"))
    return checked.withColumn("errors", F.when(F.col("is_json"), F.col("errors")).otherwise(broken)).drop("is_json")


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and quarantined rows (the latter with their errors)."""
    accepted = F.size("errors") == 0
    return checked.filter(accepted).drop("errors"), checked.filter(~accepted)


def quarantine_reasons(checked: DataFrame) -> DataFrame:
    return checked.select(F.explode("errors").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def ingest_summary(df: DataFrame) -> DataFrame:
    """Rows, pass rate, missing cells and one count per grade band, in one pass."""
    return df.agg(*summary_checks(df.columns))


def summary_checks(columns: Sequence[str]) -> list[Column]:
    """The aggregates of ``ingest_summary``."""
    missing = add_all(F.col(c).isNull().cast("bigint") for c in columns)
    bands = ["A", "B", "C", "D", "F"]
    return [
        F.count(F.lit(1)).alias("total_students"), F.avg(F.col("passed").cast("double")).alias("pass_rate"),
        *[count_where(F.col("final_grade_band") == b).alias(f"grade_{b.lower()}") for b in bands],
        F.coalesce(F.sum(missing), F.lit(0)).alias("missing_values")]


def vector_sanity(df: DataFrame, vector: str = "features") -> DataFrame:
    """Shape of a feature vector column and whether it holds NaN or infinite values."""
    from pyspark.ml.functions import vector_to_array

    values = vector_to_array(F.col(vector))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.size(values)).alias("n_features"),
        count_where(F.exists(values, F.isnan)).alias("rows_with_nan"),
        count_where(F.exists(values, lambda x: F.abs(x) == float("inf"))).alias("rows_with_inf"))


def clean(df: DataFrame, key: str = KEY, order: Sequence[str] = NUMERIC_FEATURES) -> DataFrame:
    """Schema check and keep-first de-duplication, ready to store."""
    return keep_first(require_columns(df), [key], order)
