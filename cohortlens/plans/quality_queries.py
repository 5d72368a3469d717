"""Queries for sources, sinks, quality checks and projections."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cohortlens.operators import project, quality
from cohortlens.plans.catalog import LEARNERS, query, r6, round_columns, sql_r6
from cohortlens.schema import (CATEGORICAL_FEATURES, CLIP_RANGES, EDU_BOOST, ENTITY_SCHEMA, KEY, NON_NEGATIVE_RULES,
                               NUMERIC_FEATURES, RANGE_RULES, REQUEST_SCHEMA, SCHOOL_BOOST)
from cohortlens.session import shared_dir
from cohortlens.sources import files
from cohortlens.sources.bindings import learners, students, table

STUDENT_COLUMNS = ", ".join(ENTITY_SCHEMA.names)


@query("students", LEARNERS + f"SELECT {STUDENT_COLUMNS} FROM students")
def q_students(spark: SparkSession, sf: str) -> DataFrame:
    return students(spark, sf)


@query("csv_roundtrip", LEARNERS + f"SELECT {STUDENT_COLUMNS} FROM students")
def q_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "csv")
    files.write_csv(students(spark, sf), path)
    return files.read_csv(spark, path)


@query("parquet_roundtrip", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def q_parquet(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "parquet")
    lines = table(spark, sf, "lineitem")
    files.write_parquet(lines.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), path)
    return files.read_parquet(spark, path)


@query("json_batch_explode", LEARNERS + """,
pairs AS (
  SELECT k, 'student_1' AS student_id, prior_gpa, midterm, gender, parent_edu FROM learners
  UNION ALL
  SELECT k, 'student_2', CASE WHEN prior_gpa IS NOT NULL THEN 4.0 END, least(midterm, 100.0), gender, parent_edu
  FROM learners)
SELECT k, student_id, prior_gpa, midterm, gender, parent_edu FROM pairs""")
def q_json(spark: SparkSession, sf: str) -> DataFrame:
    """Each request holds a student as recorded and a what-if copy with better marks."""
    df = learners(spark, sf)
    names = REQUEST_SCHEMA.names
    better = {"prior_gpa": F.when(F.col("prior_gpa").isNotNull(), 4.0), "midterm": F.least("midterm", F.lit(100.0))}
    request = F.struct(F.array(
        F.struct(*names), F.struct(*[better.get(c, F.col(c)).alias(c) for c in names])).alias("students"))
    bodies = df.select("k", F.to_json(request).alias("body"))
    rows = files.explode_batches(bodies, "body")
    return rows.select("k", "student_id", "prior_gpa", "midterm", "gender", "parent_edu")


@query("json_records", LEARNERS + "SELECT k, prior_gpa, midterm, gender, parent_edu FROM learners")
def q_json_records(spark: SparkSession, sf: str) -> DataFrame:
    """Students written as newline-delimited JSON and read back."""
    path = shared_dir(spark, "records")
    files.write_report(learners(spark, sf).select("k", *REQUEST_SCHEMA.names), path)
    rows = files.read_json_records(spark, path, T.StructType([T.StructField("k", T.LongType()), *REQUEST_SCHEMA.fields]))
    return rows.select("k", "prior_gpa", "midterm", "gender", "parent_edu")


@query("preview","SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def q_preview(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("negated", -F.col("o_totalprice"))
    return files.preview(orders, ["negated", "o_orderkey"]).drop("negated")


RAW_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("event_type", T.DoubleType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.LongType()),
])


@query("cast_failures", """
SELECT 'event_id' AS column_name, 'bigint' AS target_type, count(event_id) AS n_values,
       count(*) FILTER (TRY_CAST(CAST(event_id AS VARCHAR) AS BIGINT) IS NULL) AS n_failed FROM events
UNION ALL SELECT 'event_type', 'double', count(event_type), count(*) FILTER (TRY_CAST(event_type AS DOUBLE) IS NULL)
FROM events
UNION ALL SELECT 'value', 'double', count("value"), count(*) FILTER (TRY_CAST(CAST("value" AS VARCHAR) AS DOUBLE) IS NULL)
FROM events
UNION ALL SELECT 'props', 'bigint', count(props), count(*) FILTER (
  TRY_CAST(CASE WHEN event_id % 3 = 0 THEN regexp_extract(props, '[0-9]+') ELSE props END AS BIGINT) IS NULL) FROM events
""")
def q_cast(spark: SparkSession, sf: str) -> DataFrame:
    """Events as text; every third row holds a plain number where the others hold JSON."""
    number = F.regexp_extract("props", "([0-9]+)", 1)
    raw = table(spark, sf, "events").select(
        F.col("event_id").cast("string"), "event_type", F.col("value").cast("string"),
        F.when(F.col("event_id") % 3 == 0, number).otherwise(F.col("props")).alias("props"))
    return quality.cast_failures(raw, RAW_SCHEMA)


@query("dup_key_count", """
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS BIGINT)
  AS n_duplicates FROM lineitem""")
def q_dup(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_key_count(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_missing = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {sql_r6(f'avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END)')} AS missing_rate FROM students"
    for c in ENTITY_SCHEMA.names)


@query("missing_profile", LEARNERS + _missing)
def q_missing(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(quality.missing_profile(students(spark, sf)), "missing_rate")


@query("high_missing", LEARNERS + f"SELECT * FROM ({_missing}) WHERE missing_rate > 0.09")
def q_high_missing(spark: SparkSession, sf: str) -> DataFrame:
    """A limit below the default, which no column here exceeds."""
    return round_columns(quality.high_missing(students(spark, sf), limit=0.09), "missing_rate")


_line_order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
               "l_returnflag", "l_linestatus"]


@query("dedup_keep_first", f"""
SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_quantity, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_line_order)}) AS rn
  FROM lineitem) WHERE rn = 1""")
def q_dedup(spark: SparkSession, sf: str) -> DataFrame:
    first = quality.keep_first(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], _line_order)
    return first.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_quantity", "l_extendedprice")


def _rule_sql(rules, source: str) -> str:
    parts = []
    for column, low, high, issue in rules:
        bad = " OR ".join([f"{column} < {low}"] * (low is not None) + [f"{column} > {high}"] * (high is not None))
        parts.append(f"SELECT '{column}' AS column_name, '{issue}' AS issue, count(*) FILTER ({bad}) AS n_bad FROM {source}")
    return " UNION ALL ".join(parts)


LINE_RULES = [
    ("l_quantity", 5.0, 45.0, "l_quantity outside 5-45 range"),
    ("l_extendedprice", None, 90000.0, "l_extendedprice above 90000"),
    ("l_discount", 0.0, 0.09, "l_discount outside 0-0.09 range"),
    ("l_tax", 0.01, None, "l_tax below 0.01"),
]


@query("range_violations", LEARNERS + _rule_sql(RANGE_RULES, "learners"))
def q_range(spark: SparkSession, sf: str) -> DataFrame:
    return quality.rule_violations(learners(spark, sf), RANGE_RULES)


@query("range_violations_lineitem", _rule_sql(LINE_RULES, "lineitem"))
def q_range_lines(spark: SparkSession, sf: str) -> DataFrame:
    return quality.rule_violations(table(spark, sf, "lineitem"), LINE_RULES)


@query("nonneg_violations", LEARNERS + ", shifted AS (SELECT * REPLACE (study_hours_wk - 20.0 AS study_hours_wk) FROM learners) "
       + _rule_sql(NON_NEGATIVE_RULES, "shifted"))
def q_nonneg(spark: SparkSession, sf: str) -> DataFrame:
    """Study hours are shifted down by 20 so that one rule has something to find."""
    shifted = learners(spark, sf).withColumn("study_hours_wk", F.col("study_hours_wk") - 20.0)
    return quality.rule_violations(shifted, NON_NEGATIVE_RULES)


@query("dq_issue_messages", LEARNERS + f"""
SELECT issue, n_bad FROM ({_rule_sql([*RANGE_RULES, *NON_NEGATIVE_RULES], 'learners')}) WHERE n_bad > 0""")
def q_issues(spark: SparkSession, sf: str) -> DataFrame:
    return quality.issue_messages(learners(spark, sf))


ERROR_ROWS = " UNION ALL ".join(
    [f"SELECT k, '{c}: missing' AS reason FROM learners WHERE {c} IS NULL" for c in NUMERIC_FEATURES + CATEGORICAL_FEATURES]
    + [f"SELECT k, '{c}: outside {lo:g}-{hi:g}' FROM learners WHERE {c} < {lo} OR {c} > {hi}" for c, (lo, hi) in CLIP_RANGES.items()])


@query("strict_validate", LEARNERS + f""", errors AS ({ERROR_ROWS})
SELECT learners.k AS k, count(reason) AS n_errors, count(reason) = 0 AS accepted
FROM learners LEFT JOIN errors ON errors.k = learners.k GROUP BY learners.k""")
def q_strict(spark: SparkSession, sf: str) -> DataFrame:
    checked = quality.validate_records(learners(spark, sf))
    return checked.select("k", F.size("errors").cast("bigint").alias("n_errors"), (F.size("errors") == 0).alias("accepted"))


@query("quarantine_reasons", LEARNERS + f""", errors AS ({ERROR_ROWS})
SELECT reason, count(*) AS n FROM errors GROUP BY reason""")
def q_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quarantine_reasons(quality.validate_records(learners(spark, sf)))


# Every eleventh body is cut off, every seventh of the others has a word for a number.
@query("request_errors", LEARNERS + f""", errors AS ({ERROR_ROWS}),
mended AS (
  SELECT k, reason FROM errors WHERE k % 11 <> 0 AND NOT (k % 7 = 0 AND starts_with(reason, 'prior_gpa:'))
  UNION ALL SELECT k, 'prior_gpa: not a number' FROM learners WHERE k % 11 <> 0 AND k % 7 = 0
  UNION ALL SELECT k, 'body: not a JSON object' FROM learners WHERE k % 11 = 0)
SELECT learners.k AS k, count(reason) AS n_errors, min(reason) AS first_reason
FROM learners LEFT JOIN mended ON mended.k = learners.k GROUP BY learners.k""")
def q_bodies(spark: SparkSession, sf: str) -> DataFrame:
    rows = learners(spark, sf)
    fields = [*NUMERIC_FEATURES, *CATEGORICAL_FEATURES]
    typed = F.to_json(F.struct(*fields))
    worded = F.to_json(F.struct(F.lit("high").alias("prior_gpa"), *[c for c in fields if c != "prior_gpa"]))
    body = F.when(F.col("k") % 11 == 0, F.substring(typed, 1, 30)).when(F.col("k") % 7 == 0, worded).otherwise(typed)
    checked = quality.validate_bodies(rows.select("k", body.alias("body")), "body")
    return checked.select("k", F.size("errors").cast("bigint").alias("n_errors"), F.array_min("errors").alias("first_reason"))


_null_sum = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in ENTITY_SCHEMA.names)


@query("ingest_summary", LEARNERS + f"""
SELECT count(*) AS total_students, {sql_r6('avg(CAST(passed AS DOUBLE))')} AS pass_rate,
  {', '.join(f"count(*) FILTER (final_grade_band = '{b}') AS grade_{b.lower()}" for b in 'ABCDF')},
  CAST(sum({_null_sum}) AS BIGINT) AS missing_values FROM students""")
def q_ingest(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(quality.ingest_summary(students(spark, sf)), "pass_rate")


@query("select_columns", "SELECT l_orderkey, l_extendedprice, l_discount + 0.0 AS l_discount FROM lineitem")
def q_select(spark: SparkSession, sf: str) -> DataFrame:
    from cohortlens.operators.features import FeatureSelector

    chosen = FeatureSelector(columns=["l_orderkey", "l_extendedprice", "l_discount"]).transform(table(spark, sf, "lineitem"))
    return chosen.withColumn("l_discount", F.col("l_discount") + 0.0)


@query("exclude_targets", LEARNERS + "SELECT * EXCLUDE (final_score, final_grade_band, passed) FROM students")
def q_exclude(spark: SparkSession, sf: str) -> DataFrame:
    return project.without_targets(students(spark, sf))


@query("clip_ranges", LEARNERS + "SELECT k, " + ", ".join(
    f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, {lo}), {hi}) END AS {c}" for c, (lo, hi) in CLIP_RANGES.items())
    + " FROM learners")
def q_clip(spark: SparkSession, sf: str) -> DataFrame:
    return project.clip_columns(learners(spark, sf)).select("k", *CLIP_RANGES)


@query("score_adjust", LEARNERS + f"""
SELECT k, {sql_r6("final_score + CASE school_type WHEN 'Private' THEN 3.0 WHEN 'Charter' THEN 1.0 ELSE 0.0 END")} AS adjusted
FROM learners""")
def q_adjust(spark: SparkSession, sf: str) -> DataFrame:
    from cohortlens.functions.columns import lookup

    return learners(spark, sf).select("k", r6(F.col("final_score") + lookup(F.col("school_type"), SCHOOL_BOOST)).alias("adjusted"))


@query("filter_by_label", LEARNERS + "SELECT k, quiz_avg FROM learners WHERE passed = 1")
def q_filter(spark: SparkSession, sf: str) -> DataFrame:
    return learners(spark, sf).filter("passed = 1").select("k", "quiz_avg")


@query("leakage_name_flags", LEARNERS + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n_values, '{c}' LIKE '%final%' OR '{c}' LIKE '%grade%' AS suspicious FROM students"
    for c in ENTITY_SCHEMA.names))
def q_names(spark: SparkSession, sf: str) -> DataFrame:
    return project.name_flags(students(spark, sf))


_weighted = ("prior_gpa * 25.0 * 0.25 + attendance_pct * 0.15 + study_hours_wk * 2.5 * 0.10 + quiz_avg * 0.15 "
             "+ assign_avg * 0.15 + midterm * 0.20")


@query("weighted_score", LEARNERS + f"SELECT k, {sql_r6(_weighted)} AS score FROM learners")
def q_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return learners(spark, sf).select("k", r6(project.weighted_score()).alias("score"))


_edu = " ".join(f"WHEN '{k}' THEN {v}" for k, v in EDU_BOOST.items())
_boost = f"CASE school_type WHEN 'Private' THEN 3.0 WHEN 'Charter' THEN 1.0 ELSE 0.0 END + CASE parent_edu {_edu} ELSE 0.0 END"


@query("level_boost", LEARNERS + f"SELECT k, CAST({_boost} AS DOUBLE) AS boost FROM learners")
def q_boost(spark: SparkSession, sf: str) -> DataFrame:
    return learners(spark, sf).select("k", project.group_adjustment(F.col("school_type"), F.col("parent_edu")).alias("boost"))


@query("level_boost_join", LEARNERS + f""",
boosts AS (SELECT DISTINCT parent_edu, CAST(CASE parent_edu {_edu} END AS DOUBLE) AS boost FROM learners)
SELECT k, learners.parent_edu AS parent_edu, coalesce(boost, 0.0) AS boost
FROM learners LEFT JOIN boosts ON boosts.parent_edu = learners.parent_edu""")
def q_boost_join(spark: SparkSession, sf: str) -> DataFrame:
    """The lookup as a join with a five-row table."""
    boosts = spark.createDataFrame(list(EDU_BOOST.items()), "parent_edu string, boost double")
    joined = learners(spark, sf).join(F.broadcast(boosts), "parent_edu", "left")
    return joined.select("k", "parent_edu", F.coalesce("boost", F.lit(0.0)).alias("boost"))


@query("grade_band", LEARNERS + "SELECT student_id, final_grade_band FROM students")
def q_band(spark: SparkSession, sf: str) -> DataFrame:
    return learners(spark, sf).select(
        project.padded_key(F.col("k")).alias("student_id"), project.grade_band(F.col("final_score")).alias("final_grade_band"))


@query("pass_label", LEARNERS + "SELECT k, passed FROM learners")
def q_pass(spark: SparkSession, sf: str) -> DataFrame:
    return learners(spark, sf).select("k", project.pass_label(F.col("final_score")).alias("passed"))


@query("derive_outcome", LEARNERS + f""",
scores AS (SELECT k, {_weighted} + ({_boost}) AS raw FROM learners),
bounded AS (SELECT k, CASE WHEN raw IS NULL THEN NULL ELSE least(greatest(raw, 0.0), 100.0) END AS score FROM scores)
SELECT k, {sql_r6('score')} AS final_score,
  CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END
  AS final_grade_band, CASE WHEN score >= 60 THEN 1 ELSE 0 END AS passed FROM bounded""")
def q_outcome(spark: SparkSession, sf: str) -> DataFrame:
    out = project.derive_outcome(learners(spark, sf))
    return round_columns(out.select("k", "final_score", "final_grade_band", "passed"), "final_score")


@query("padded_key", "SELECT printf('STU_%06d', c_custkey) AS student_id FROM customer")
def q_padded(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(project.padded_key(F.col("c_custkey")).alias(KEY))
