"""Inputs built from the driver tables: a student-shaped view and scored views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.functions.columns import band
from cohortlens.schema import ENTITY_SCHEMA, GRADE_BANDS, GRADE_FLOOR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def learners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One student-shaped row per customer, from three tables.

    Lines shrink to one row per order before the join, and orders to one row per
    customer before the next, so no raw line is shuffled twice.
    """
    customer = table(spark, sf_dir, "customer")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.count(F.lit(1)).alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    per_customer = (
        orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("n_orders"),
             share(F.col("o_orderstatus") == "F").alias("f_share"),
             share(F.col("o_orderstatus") != "P").alias("np_share"),
             F.avg("o_totalprice").alias("avg_price"), F.max("o_totalprice").alias("max_price"),
             F.avg("q").alias("q"), F.avg("d").alias("d"), F.sum("n").alias("n_lines"))
    )
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    level = F.col("c_nationkey") % 5
    base = customer.join(per_customer, customer.c_custkey == per_customer.o_custkey, "left").select(
        key.alias("k"),
        F.when(key % 20 == 0, None).when(key % 2 == 0, "F").otherwise("M").alias("gender"),
        F.when(segment.isin("BUILDING", "FURNITURE", "HOUSEHOLD"), "Public")
        .when(segment == "MACHINERY", "Private").otherwise("Charter").alias("school_type"),
        F.when(level == 0, "High School").when(level == 1, "Some College").when(level == 2, "Bachelor")
        .when(level == 3, "Master").otherwise("PhD").alias("parent_edu"),
        F.when(key % 10 == 0, None).otherwise((F.col("c_acctbal") + 1000.0) / 2750.0).alias("prior_gpa"),
        F.when(key % 15 == 0, None).otherwise(F.lit(100.0) * F.col("np_share")).alias("attendance_pct"),
        F.col("q").alias("study_hours_wk"),
        (F.col("avg_price") / 2000.0).alias("commute_min"),
        (F.lit(2.0) * F.col("q") + 20.0).alias("quiz_avg"),
        (F.lit(100.0) - F.lit(500.0) * F.col("d")).alias("assign_avg"),
        (F.col("max_price") / 5000.0).alias("midterm"),
        (F.lit(100.0) * F.col("f_share")).alias("on_time_submit_pct"),
        F.col("n_orders").cast("double").alias("lms_logins_wk"),
        (F.col("n_lines").cast("double") / 10.0).alias("forum_posts"),
    )
    raw = (
        F.col("prior_gpa") * 25 * 0.25 + F.col("attendance_pct") * 0.15
        + F.col("study_hours_wk") * 2.5 * 0.10 + F.col("quiz_avg") * 0.15
        + F.col("assign_avg") * 0.15 + F.col("midterm") * 0.20
    )
    score = F.coalesce(raw, F.lit(50.0) + F.col("k") % 40)
    return base.withColumn("final_score", score).withColumn("passed", (F.col("final_score") >= 60).cast("bigint"))


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 17-column entity table, from ``learners``."""
    df = learners(spark, sf_dir).withColumns({
        "student_id": F.format_string("STU_%06d", "k"),
        "final_grade_band": band(F.col("final_score"), GRADE_BANDS, GRADE_FLOOR),
    })
    return df.select(*ENTITY_SCHEMA.names)


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        "doc_id", F.col("quality").cast("bigint").alias("label"),
        (F.least(F.col("n_chars"), F.lit(4000)) / 4000.0).alias("probability"),
        "lang", "source", F.col("toxic").cast("bigint").alias("toxic"))


def scored_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "*", (F.col("l_returnflag") == "R").cast("bigint").alias("label"),
        (F.col("l_quantity") / 50.0).alias("probability"))


def drift_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items tagged by side: shipped before 1998 is the reference population."""
    current = F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", "l_extendedprice",
        (F.col("l_discount") + 0.0).alias("l_discount"), (F.col("l_tax") + 0.0).alias("l_tax"),
        "l_returnflag", "l_linestatus", "l_shipdate",
        F.when(current, "current").otherwise("reference").alias("side"))


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type",
        (F.least(F.col("value"), F.lit(100.0)) / 100.0).alias("probability"))
