"""Streaming queries: each runs over all available input and returns what it stored."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.plans.catalog import EVENTS, LEARNERS, SIDES, query, round_columns, sql_r6
from cohortlens.plans.drift_queries import CATEGORIES, NUMBERS, TABLE
from cohortlens.plans.quality_queries import ERROR_ROWS
from cohortlens.plans.risk_queries import HOURLY
from cohortlens.schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from cohortlens.session import shared_dir
from cohortlens.sources.bindings import drift_sides, learners, scored_events
from cohortlens.streaming import jobs
from cohortlens.streaming.state import NewestLog


def as_stream(spark: SparkSession, df: DataFrame, purpose: str, files: int | None = None) -> DataFrame:
    """A table stored as files, read back as a stream; with ``files``, in as many batches."""
    path = shared_dir(spark, purpose)
    (df if files is None else df.repartition(files)).write.parquet(path)
    return jobs.file_stream(spark, path, df.schema, 1 if files else None)


@query("stream_hourly_stats", HOURLY)
def q_hourly(spark: SparkSession, sf: str) -> DataFrame:
    stream = as_stream(spark, scored_events(spark, sf), "events")
    out = jobs.run_hourly_stats(stream, *jobs.new_run(spark, "hourly"))
    return round_columns(out.withColumn("hour_start", F.col("hour_start").cast("timestamp_ntz")), "avg_probability")


@query("stream_validate", LEARNERS + f""", errors AS ({ERROR_ROWS})
SELECT learners.k AS k, count(reason) AS n_errors, count(reason) = 0 AS accepted
FROM learners LEFT JOIN errors ON errors.k = learners.k GROUP BY learners.k""")
def q_validate(spark: SparkSession, sf: str) -> DataFrame:
    stream = as_stream(spark, learners(spark, sf).select("k", *NUMERIC_FEATURES, *CATEGORICAL_FEATURES), "requests")
    out = jobs.run_validation(stream, *jobs.new_run(spark, "validate"))
    return out.select("k", F.size("errors").cast("bigint").alias("n_errors"), "accepted")


@query("stream_drift", SIDES + TABLE + f""" SELECT feature, feature_type, {sql_r6('statistic')} AS statistic,
  {sql_r6('p_value')} AS p_value, drift_detected FROM drift""")
def q_drift(spark: SparkSession, sf: str) -> DataFrame:
    """All current line items arrive as one micro-batch."""
    sides = drift_sides(spark, sf)
    features = [*NUMBERS, *CATEGORIES]
    folders = jobs.reference_counts(sides.filter("side = 'reference'"), NUMBERS, CATEGORIES, shared_dir(spark, "reference"))
    stream = as_stream(spark, sides.filter("side = 'current'").select(*features), "current")
    out = jobs.run_drift(stream, folders, NUMBERS, CATEGORIES, *jobs.new_run(spark, "drift"))
    return round_columns(out.select("feature", "feature_type", "statistic", "p_value", "drift_detected"), "statistic", "p_value")


@query("stream_scored_log", EVENTS + f"""SELECT event_id, {sql_r6('probability')} AS risk_probability,
  CASE WHEN probability >= 0.8 THEN 'Low Risk' WHEN probability >= 0.6 THEN 'Medium Risk' ELSE 'High Risk' END AS risk_level,
  probability >= 0.5 AS prediction FROM scored""")
def q_log(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth event arrives twice and is logged once."""
    events = scored_events(spark, sf)
    stream = as_stream(spark, events.unionByName(events.filter("event_id % 10 = 0")), "predictions")
    out = jobs.run_scored_log(stream, *jobs.new_run(spark, "log"))
    return round_columns(out.select("event_id", "risk_probability", "risk_level", "prediction"), "risk_probability")


def newest_log(spark: SparkSession, sf: str) -> NewestLog:
    """Scored events, folded in by four batches."""
    events = scored_events(spark, sf)
    stream = as_stream(spark, events, "predictions", files=4)
    path, checkpoint = jobs.new_run(spark, "newest")
    log = NewestLog(path, "ts", "event_id")
    log.run(stream, checkpoint)
    return log


@query("stream_retained", EVENTS + "SELECT event_id, user_id, event_type FROM scored ORDER BY ts DESC, event_id DESC LIMIT 1000")
def q_retained(spark: SparkSession, sf: str) -> DataFrame:
    """The newest records that a stream keeps, whatever order its batches come in."""
    return newest_log(spark, sf).retained(spark).select("event_id", "user_id", "event_type")


@query("stream_recent_stats", EVENTS + f"""SELECT (SELECT count(*) FROM scored) AS total_predictions, count(*) AS recent_predictions,
  {sql_r6('avg(probability)')} AS avg_probability, {sql_r6('avg(CASE WHEN probability >= 0.6 THEN 0e0 ELSE 1e0 END) * 100.0')} AS high_risk_percentage,
  CAST(NULL AS VARCHAR) AS message FROM (SELECT * FROM scored ORDER BY ts DESC, event_id DESC LIMIT 100)""")
def q_recent(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(newest_log(spark, sf).recent_stats(spark), "avg_probability", "high_risk_percentage")
