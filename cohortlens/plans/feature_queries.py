"""Queries for feature preparation, splitting and sampling."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.operators import features, quality, split
from cohortlens.plans.catalog import LEARNERS, LINES, query, r6, round_columns, sql_r6
from cohortlens.plans.metric_queries import hash_sql
from cohortlens.schema import CATEGORICAL_FEATURES, CLIP_RANGES, NUMERIC_FEATURES
from cohortlens.session import materialize
from cohortlens.sources.bindings import learners, scored_lineitem, table

LEVELS = {
    "gender": ["F", "M"],
    "school_type": ["Charter", "Private", "Public"],
    "parent_edu": ["Bachelor", "High School", "Master", "PhD", "Some College"],
}
# Same names in both engines: feature names with blanks replaced.
FLAGS = [(c, level, f"{c}_{level}".replace(" ", "_")) for c, levels in LEVELS.items() for level in levels]

# CTEs: clipped numbers, then imputed and standardized ones, and imputed categories.
FIT = ", clipped AS (SELECT k, gender, school_type, parent_edu, " + ", ".join(
    f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, {lo}), {hi}) END AS {c}" for c, (lo, hi) in CLIP_RANGES.items()
) + """ FROM learners), med AS (SELECT """ + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in NUMERIC_FEATURES) + """ FROM clipped),
modes AS (SELECT """ + ", ".join(
    f"(SELECT {c} FROM learners WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}" for c in CATEGORICAL_FEATURES
) + """), filled AS (SELECT k, """ + ", ".join(f"coalesce(clipped.{c}, med.{c}) AS {c}" for c in NUMERIC_FEATURES) + ", " + ", ".join(
    f"coalesce(clipped.{c}, modes.{c}) AS {c}" for c in CATEGORICAL_FEATURES) + """ FROM clipped, med, modes),
stats AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC_FEATURES) + " FROM filled)\n"
_scaled = ", ".join(f"{sql_r6(f'({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END')} AS {c}" for c in NUMERIC_FEATURES)
_flags = ", ".join(f"CASE WHEN {c} = '{level}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {name}" for c, level, name in FLAGS)


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    """Learners as a stored table, since fitting reads it several times."""
    return materialize(learners(spark, sf), "learners")


def fitted(spark: SparkSession, sf: str) -> tuple[DataFrame, features.PreprocessorModel]:
    df = prepared(spark, sf)
    return df, features.Preprocessor().fit(df)


def plain_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(" ", "_") for c in df.columns])


@query("impute_median", LEARNERS + FIT + "SELECT k, " + ", ".join(f"{sql_r6(c)} AS {c}" for c in NUMERIC_FEATURES) + " FROM filled")
def q_impute(spark: SparkSession, sf: str) -> DataFrame:
    df, model = fitted(spark, sf)
    filled = model.imputed()
    return df.select("k", *[r6(filled[c]).alias(c) for c in NUMERIC_FEATURES])


@query("impute_mode", LEARNERS + FIT + f"SELECT k, {', '.join(CATEGORICAL_FEATURES)} FROM filled")
def q_mode(spark: SparkSession, sf: str) -> DataFrame:
    df, model = fitted(spark, sf)
    filled = model.imputed()
    return df.select("k", *[filled[c].alias(c) for c in CATEGORICAL_FEATURES])


@query("standardize", LEARNERS + FIT + f"SELECT k, {_scaled} FROM filled, stats")
def q_scale(spark: SparkSession, sf: str) -> DataFrame:
    df = prepared(spark, sf)
    model = features.Preprocessor(categorical=[]).fit(df)
    return round_columns(model.flat(df, ["k"]), *NUMERIC_FEATURES)


@query("one_hot", LEARNERS + FIT + f"SELECT k, {_flags} FROM filled")
def q_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    df = learners(spark, sf)
    return plain_names(features.Preprocessor(numeric=[]).fit(df).flat(df, ["k"]))


@query("preprocess_full", LEARNERS + FIT + f"SELECT k, {_scaled}, {_flags} FROM filled, stats")
def q_preprocess(spark: SparkSession, sf: str) -> DataFrame:
    df, model = fitted(spark, sf)
    return round_columns(plain_names(model.flat(df, ["k"])), *NUMERIC_FEATURES)


@query("feature_sanity", LEARNERS + f"""SELECT count(*) AS n_rows, CAST({len(NUMERIC_FEATURES)} + count(DISTINCT gender)
  + count(DISTINCT school_type) + count(DISTINCT parent_edu) AS INTEGER) AS n_features, 0 AS rows_with_nan, 0 AS rows_with_inf FROM learners""")
def q_sanity(spark: SparkSession, sf: str) -> DataFrame:
    df, model = fitted(spark, sf)
    return quality.vector_sanity(model.transform(df))


_interaction = "attendance_pct * study_hours_wk / 100"
_mean3 = "((quiz_avg + assign_avg + midterm) / 3)"
_consistency = (f"sqrt((({'quiz_avg'} - {_mean3}) * (quiz_avg - {_mean3}) + (assign_avg - {_mean3}) * (assign_avg - {_mean3}) "
                f"+ (midterm - {_mean3}) * (midterm - {_mean3})) / 2)")
_engagement = ("(CASE WHEN lms_logins_wk IS NOT NULL THEN least(greatest(lms_logins_wk / 50, 0), 1) END "
               "+ CASE WHEN forum_posts IS NOT NULL THEN least(greatest(forum_posts / 20, 0), 1) END + on_time_submit_pct / 100) / 3")


@query("fe_interaction", LEARNERS + f"SELECT k, {sql_r6(_interaction)} AS attendance_study_interaction FROM learners")
def q_interaction(spark: SparkSession, sf: str) -> DataFrame:
    return learners(spark, sf).select("k", r6(features.interaction()).alias("attendance_study_interaction"))


_marks = """, marks AS (SELECT k, passed, prior_gpa, unnest([quiz_avg, CASE WHEN k % 7 = 0 THEN NULL ELSE assign_avg END,
  CASE WHEN k % 14 = 0 THEN NULL ELSE midterm END]) AS mark FROM learners)
"""


@query("fe_consistency", LEARNERS + _marks + f"SELECT k, {sql_r6('stddev_samp(mark)')} AS performance_consistency FROM marks GROUP BY k")
def q_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Some marks are blanked, so that rows with three, two and one mark occur."""
    df = learners(spark, sf).withColumns({
        "assign_avg": F.when(F.col("k") % 7 != 0, F.col("assign_avg")),
        "midterm": F.when(F.col("k") % 14 != 0, F.col("midterm"))})
    return df.select("k", r6(features.consistency()).alias("performance_consistency"))


@query("fe_engagement", LEARNERS + f"SELECT k, {sql_r6(_engagement)} AS engagement_score FROM learners")
def q_engagement(spark: SparkSession, sf: str) -> DataFrame:
    df = learners(spark, sf)
    return df.select("k", r6(features.engagement(df.columns)).alias("engagement_score"))


_new = [("attendance_study_interaction", _interaction), ("performance_consistency", _consistency), ("engagement_score", _engagement)]


@query("fe_all", LEARNERS + ", made AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _new) + " FROM learners), med AS (SELECT "
       + ", ".join(f"quantile_cont({n}, 0.5) AS m_{n}" for n, _ in _new) + " FROM made), filled AS (SELECT k, "
       + ", ".join(f"coalesce({n}, m_{n}) AS {n}" for n, _ in _new) + " FROM made, med) SELECT k, "
       + ", ".join(sql_r6(f"({n} - avg({n}) OVER ()) / stddev_pop({n}) OVER ()") + f" AS {n}" for n, _ in _new) + " FROM filled")
def q_all(spark: SparkSession, sf: str) -> DataFrame:
    """Engineered columns joined to the numeric features, then preprocessed."""
    df = features.FeatureEngineer().transform(prepared(spark, sf))
    model = features.Preprocessor(numeric=[*NUMERIC_FEATURES, *features.ENGINEERED]).fit(df)
    return round_columns(model.flat(df, ["k"]).select("k", *features.ENGINEERED), *features.ENGINEERED)


def ranked_sql(source: str) -> str:
    """Rows of ``source`` with their rank by key hash within their class, and the size of the class."""
    return f"""SELECT *, row_number() OVER (PARTITION BY passed ORDER BY h, k) AS rk, count(*) OVER (PARTITION BY passed) AS n
FROM {hash_sql(source, 'k', 42)}"""


_ranked = ranked_sql("learners")


@query("stratified_split", LEARNERS + f"SELECT k, passed, rk <= floor(0.2 * n + 0.5) AS is_test FROM ({_ranked})")
def q_split(spark: SparkSession, sf: str) -> DataFrame:
    return split.with_holdout(learners(spark, sf).select("k", "passed"), "passed", "k")


@query("stratified_folds", LEARNERS + f"SELECT k, passed, (rk - 1) * 5 // n AS fold FROM ({_ranked})")
def q_folds(spark: SparkSession, sf: str) -> DataFrame:
    out = split.with_folds(learners(spark, sf).select("k", "passed"), "passed", "k")
    return out.withColumn("fold", F.col("fold").cast("bigint"))


@query("stratified_split_events", f"""SELECT event_id, event_type, rk <= floor(0.2 * n + 0.5) AS is_test FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h, event_id) AS rk, count(*) OVER (PARTITION BY event_type) AS n
  FROM {hash_sql('events', 'event_id', 42)})""")
def q_split_events(spark: SparkSession, sf: str) -> DataFrame:
    return split.with_holdout(table(spark, sf, "events").select("event_id", "event_type"), "event_type", "event_id")


@query("sample_n", f"SELECT o_orderkey, o_totalprice FROM {hash_sql('orders', 'o_orderkey', 42)} ORDER BY h, o_orderkey LIMIT 100")
def q_sample(spark: SparkSession, sf: str) -> DataFrame:
    return split.sample_n(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("class_weights", LINES + f"""SELECT label, count(*) AS n,
  {sql_r6('CAST((SELECT count(*) FROM scored) AS DOUBLE) / ((SELECT count(DISTINCT label) FROM scored) * count(*))')} AS weight
FROM scored GROUP BY label""")
def q_weights(spark: SparkSession, sf: str) -> DataFrame:
    from cohortlens.operators.models import class_weights

    return round_columns(class_weights(scored_lineitem(spark, sf), "label"), "weight")
