"""Table sources and sinks: CSV, Parquet, JSON lines, JSON batches and JSON reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cohortlens.schema import ENTITY_SCHEMA, REQUEST_SCHEMA

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType = ENTITY_SCHEMA,
             keep_corrupt: bool = False) -> DataFrame:
    """Headed CSV with an explicit schema; rows that do not parse can be kept as text.

    A missing path raises ``AnalysisException`` (PATH_NOT_FOUND) to the caller.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("nanValue", "")
    if keep_corrupt:
        schema = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_json_records(spark: SparkSession, path: str, schema: T.StructType = REQUEST_SCHEMA) -> DataFrame:
    """Newline-delimited JSON records."""
    return spark.read.schema(schema).json(path)


def read_bodies(df: DataFrame, body: str, fields: list[str]) -> DataFrame:
    """Request bodies held as JSON text: their fields as text, and whether the body is a JSON object at all.

    A field that a body lacks, or holds as null, is null; a body that is null, cut off or no object has ``is_json`` false.
    """
    parsed = F.from_json(F.col(body), "map<string,string>")
    keep = [c for c in df.columns if c != body]
    opened = df.select(*keep, parsed.alias("parsed"), F.trim(F.col(body)).startswith("{").alias("object"))
    good = F.coalesce(F.col("object") & F.col("parsed").isNotNull(), F.lit(False))
    return opened.select(*keep, good.alias("is_json"), *[F.try_element_at("parsed", F.lit(f)).alias(f) for f in fields])


def explode_batches(df: DataFrame, body: str, schema: T.StructType = REQUEST_SCHEMA) -> DataFrame:
    """Requests ``{"students": [...]}`` held as text: one row per student, numbered from 1."""
    request = T.StructType([T.StructField("students", T.ArrayType(schema))])
    keep = [c for c in df.columns if c != body]
    parsed = df.select(*keep, F.from_json(body, request)["students"].alias("students"))
    rows = parsed.select(*keep, F.posexplode("students").alias("position", "student"))
    name = F.format_string("student_%d", F.col("position") + 1).alias("student_id")
    return rows.select(*keep, name, "student.*")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN becomes null, so that one notion of "missing" is left."""
    def fix(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(field.name), F.col(field.name)).alias(field.name)
        return F.col(field.name)

    return df.select(*[fix(f) for f in df.schema.fields])


def preview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """First rows in a stated order (a table has none of its own)."""
    return df.orderBy(*order).limit(n)


def column_types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def report_json(df: DataFrame, name: str = "report") -> DataFrame:
    """One JSON document per row of a long-format result table."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines; long-format results stay distributed on the way out."""
    df.write.mode("overwrite").json(path)


def write_params(spark: SparkSession, params: dict, path: str) -> None:
    """Small settings document (model parameters) next to a saved model."""
    row = spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "params string")
    row.coalesce(1).write.mode("overwrite").text(path)


def read_params(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
