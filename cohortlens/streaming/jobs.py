"""Structured Streaming jobs over file sources.

Every job runs to the end of the available input and keeps its progress in a
checkpoint, so a restart goes on where it stopped. Tables written per micro-batch go
to a folder named after the batch, which a repeated batch overwrites.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from cohortlens.functions.distributions import chi_square_p, ks_p
from cohortlens.operators import drift, quality, risk
from cohortlens.operators.profile import long_numbers, long_texts
from cohortlens.schema import DRIFT_ALPHA
from cohortlens.session import shared_dir
from cohortlens.streaming import state
from cohortlens.streaming.state import Reference

#: Files that the hours of a batch are written to.
HOUR_FILES = 8


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
                  prepare: Callable[[DataFrame], DataFrame] | None = None,
                  partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Store each micro-batch under ``path/batch_id=n``, after an optional batch computation."""
    def store(batch: DataFrame, batch_id: int) -> None:
        out = prepare(batch) if prepare else batch
        writer = out.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{path}/batch_id={batch_id}")

    return (stream.writeStream.outputMode(mode).foreachBatch(store)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(path)


def with_event_time(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """Watermark on the time column, which must be an instant (wall-clock times are read in the session zone)."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def hourly_stats(stream: DataFrame, time: str = "ts", probability: str = "probability", delay: str = "1 hour") -> DataFrame:
    """Hourly counts of a prediction stream; rows later than the delay are left out."""
    return risk.hourly_counts(with_event_time(stream, time, delay), time, probability)


def run_hourly_stats(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run the statistics in update mode and return the last state of each hour."""
    return run_hourly_counted(stream, path, checkpoint)[0]


def run_hourly_counted(stream: DataFrame, path: str, checkpoint: str) -> tuple[DataFrame, int]:
    """The last state of each hour, and how many rows of this run came too late to be counted.

    A batch's folder holds all hours so far, a row each: the changed ones and those of the batch before. So only
    the last folder is read, and a repeated batch gives the same one. Hours are dealt into ``HOUR_FILES`` files by a
    shuffle of their own, so that each partition of the state stays in a task of its own.
    """
    spark, hours = stream.sparkSession, hourly_stats(stream)
    values = [c for c in hours.columns if c != "hour_start"]

    def fold(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("fresh", F.lit(1))
        if batch_id > 0:
            before = spark.read.schema(hours.schema).parquet(f"{path}/batch_id={batch_id - 1}")
            rows = rows.unionByName(before.withColumn("fresh", F.lit(0)))
        newest = rows.repartition(HOUR_FILES, "hour_start").groupBy("hour_start").agg(F.max(F.struct("fresh", *values)).alias("last"))
        newest.select("hour_start", *[F.col(f"last.{c}") for c in values]).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = (hours.writeStream.outputMode("update").foreachBatch(fold)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    late = sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])
    last = read_batches(spark, path, hours.schema)
    newest = last.agg(F.max("batch_id")).scalar()
    return last.filter(F.col("batch_id") == newest).drop("batch_id"), late


def run_validation(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Validate records and store accepted and quarantined rows apart, in one pass per batch."""
    checked = quality.validate_records(stream)
    marked = checked.withColumn("accepted", F.size("errors") == 0)
    write_batches(marked, path, checkpoint, partition_by=["accepted"]).awaitTermination()
    return read_batches(stream.sparkSession, path, marked.schema)


def reference_counts(reference: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                     path: str) -> tuple[str, str]:
    """Store a reference by value range for ``run_drift``; returns the folders of its numbers and its texts."""
    stored = Reference.store(reference, numeric, categorical, path)
    return stored.numbers, stored.texts


def batch_drift(batch: DataFrame, numbers: DataFrame, texts: DataFrame, numeric: Sequence[str],
                categorical: Sequence[str], alpha: float = DRIFT_ALPHA) -> DataFrame:
    """Drift of a table against whole tables of reference counts; ``run_drift`` reads less of them."""
    def both(reference: DataFrame, long: DataFrame) -> DataFrame:
        current = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n_cur"))
        rows = reference.select("feature", "value", "n_ref", F.lit(0).cast("bigint").alias("n_cur")).unionByName(
            current.select("feature", "value", F.lit(0).cast("bigint").alias("n_ref"), "n_cur"))
        return rows.groupBy("feature", "value").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))

    ks = drift.ks_from_counts(both(numbers, long_numbers(batch, numeric)))
    chi = drift.chi_square_from_counts(both(texts, long_texts(batch, categorical)))
    ks = ks.select("feature", F.lit("numerical").alias("feature_type"), F.col("ks_statistic").alias("statistic"),
                   ks_p(F.col("ks_statistic"), F.col("size_ref"), F.col("size_cur")).alias("p_value"), "size_cur")
    chi = chi.select("feature", F.lit("categorical").alias("feature_type"), F.col("chi2_statistic").alias("statistic"),
                     chi_square_p("chi2_statistic", "dof").alias("p_value"), "size_cur")
    return ks.unionByName(chi).withColumn("drift_detected", F.col("p_value") < alpha)


DRIFT_SCHEMA = T.StructType([
    T.StructField("feature", T.StringType()), T.StructField("feature_type", T.StringType()),
    T.StructField("statistic", T.DoubleType()), T.StructField("p_value", T.DoubleType()),
    T.StructField("size_cur", T.LongType()), T.StructField("drift_detected", T.BooleanType()),
])


def run_drift(stream: DataFrame, folders: tuple[str, str], numeric: Sequence[str], categorical: Sequence[str],
              path: str, checkpoint: str) -> DataFrame:
    """Check every micro-batch against the stored reference; one row per batch and feature.

    A batch shuffles its counts by range, and the values of the few ranges that can hold the largest gap.
    """
    reference = Reference.load(stream.sparkSession, folders[0].removesuffix("/numbers"))
    write_batches(stream, path, checkpoint, prepare=lambda batch: state.batch_drift(
        batch, reference, numeric, categorical)).awaitTermination()
    return read_batches(stream.sparkSession, path, DRIFT_SCHEMA)


def run_scored_log(stream: DataFrame, path: str, checkpoint: str, key: str = "event_id", time: str = "ts",
                   delay: str = "1 hour") -> DataFrame:
    """Prediction log without repeated records; the file sink commits each batch once."""
    unique = with_event_time(stream, time, delay).dropDuplicatesWithinWatermark([key])
    scored = risk.with_risk(unique)
    query = (scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(scored.schema).parquet(path)


def new_run(spark: SparkSession, purpose: str) -> tuple[str, str]:
    """Output and checkpoint folders of a fresh run."""
    base = shared_dir(spark, purpose)
    return f"{base}/out", f"{base}/checkpoint"
