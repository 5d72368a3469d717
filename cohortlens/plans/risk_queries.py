"""Queries for risk scoring, explanation and prediction statistics."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.operators import risk
from cohortlens.plans.catalog import EVENTS, LEARNERS, query, r6, round_columns, sql_r6
from cohortlens.schema import (FACTOR_RULES, LEVEL_RECOMMENDATIONS, RECOMMENDATION_RULES)
from cohortlens.sources.bindings import learners, scored_events

# The pass probability of a learner is given: the final score on a 0-1 scale.
SCORED = LEARNERS + """, scored AS (SELECT *, least(greatest(final_score / 100.0, 0.0), 1.0) AS probability FROM learners),
levels AS (SELECT *, CASE WHEN probability >= 0.8 THEN 'Low Risk' WHEN probability >= 0.6 THEN 'Medium Risk' ELSE 'High Risk' END
  AS risk_level FROM scored)
"""


def scored_learners(spark: SparkSession, sf: str) -> DataFrame:
    p = F.least(F.greatest(F.col("final_score") / 100.0, F.lit(0.0)), F.lit(1.0))
    return learners(spark, sf).withColumn("probability", p)


@query("risk_level", SCORED + f"""SELECT k, risk_level, probability >= 0.5 AS prediction,
  {sql_r6('abs(probability - 0.5) * 2')} AS confidence FROM levels""")
def q_level(spark: SparkSession, sf: str) -> DataFrame:
    out = risk.with_risk(scored_learners(spark, sf)).select("k", "risk_level", "prediction", "confidence")
    return round_columns(out, "confidence")


def _factor_rows() -> str:
    ordered = [r for r in FACTOR_RULES if r[4] == "high"] + [r for r in FACTOR_RULES if r[4] != "high"]
    return " UNION ALL ".join(
        f"SELECT k, {i} AS ord, '{factor}' AS factor, concat('{before}', printf('%.{digits}f', {c}), '{after}') AS description, "
        f"'{sev}' AS severity FROM learners WHERE {c} {sign} {bound}"
        for i, (c, sign, bound, factor, sev, before, digits, after) in enumerate(ordered))


_factors = f""", hits AS ({_factor_rows()}),
factors AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS position FROM hits) WHERE position <= 5)
"""


@query("risk_factors", LEARNERS + _factors + "SELECT k, position, factor, description, severity FROM factors")
def q_factors(spark: SparkSession, sf: str) -> DataFrame:
    rows = learners(spark, sf).select("k", F.posexplode(risk.risk_factors()).alias("position", "entry"))
    return rows.select("k", (F.col("position") + 1).cast("bigint").alias("position"), "entry.*")


def _recommendation_rows() -> str:
    parts, i = [], 0
    for column, bound, texts in RECOMMENDATION_RULES:
        for text in texts:
            parts.append(f"SELECT k, {i} AS ord, '{text}' AS recommendation FROM levels WHERE {column} < {bound}")
            i += 1
    for level, texts in LEVEL_RECOMMENDATIONS.items():
        for text in texts:
            parts.append(f"SELECT k, {i}, '{text}' FROM levels WHERE risk_level = '{level}'")
            i += 1
    return " UNION ALL ".join(parts)


_advice = f""", advice_hits AS ({_recommendation_rows()}),
advice AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS position FROM advice_hits) WHERE position <= 5)
"""


@query("recommendations", SCORED + _advice + "SELECT k, position, recommendation FROM advice")
def q_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    texts = risk.recommendations(risk.risk_level(F.col("probability")))
    rows = scored_learners(spark, sf).select("k", F.posexplode(texts).alias("position", "recommendation"))
    return rows.withColumn("position", (F.col("position") + 1).cast("bigint"))


_drivers = {
    "attendance": "(80.0 - attendance_pct) / 80.0",
    "study_time": "(10.0 - study_hours_wk) / 10.0",
    "performance": "(70.0 - (quiz_avg + assign_avg + midterm) / 3) / 70.0",
    "engagement": "(3.0 - lms_logins_wk) / 3.0",
    "submission": "(80.0 - on_time_submit_pct) / 80.0",
}
_driver_sql = ", ".join(f"CASE WHEN {e} IS NOT NULL THEN {sql_r6(f'greatest({e}, 0.0)')} END AS {n}" for n, e in _drivers.items())


@query("risk_drivers", LEARNERS + f"SELECT k, {_driver_sql} FROM learners")
def q_drivers(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(learners(spark, sf).select("k", *[c.alias(n) for n, c in risk.driver_columns().items()]), *_drivers)


@query("explain_table", SCORED + _factors + _advice + f""",
f AS (SELECT k, count(*) AS n_factors, string_agg(description, '; ' ORDER BY position) AS factors FROM factors GROUP BY k),
a AS (SELECT k, count(*) AS n_recommendations, string_agg(recommendation, '; ' ORDER BY position) AS recommendations FROM advice GROUP BY k)
SELECT levels.k AS k, {sql_r6('probability')} AS risk_probability, risk_level, coalesce(n_factors, 0) AS n_factors,
  coalesce(factors, '') AS factors, coalesce(n_recommendations, 0) AS n_recommendations, coalesce(recommendations, '') AS recommendations,
  {_driver_sql} FROM levels LEFT JOIN f ON f.k = levels.k LEFT JOIN a ON a.k = levels.k""")
def q_explain(spark: SparkSession, sf: str) -> DataFrame:
    out = risk.explain(scored_learners(spark, sf), "k")
    drivers = [r6(F.element_at("risk_drivers", n)).alias(n) for n in _drivers]
    return out.select(
        "k", r6("risk_probability").alias("risk_probability"), "risk_level",
        F.size("top_factors").cast("bigint").alias("n_factors"),
        F.array_join(F.transform("top_factors", lambda f: f["description"]), "; ").alias("factors"),
        F.size("recommendations").cast("bigint").alias("n_recommendations"),
        F.array_join("recommendations", "; ").alias("recommendations"), *drivers)


def _batch_sql(where: str) -> str:
    level = "CASE WHEN probability >= 0.8 THEN 'Low Risk' WHEN probability >= 0.6 THEN 'Medium Risk' ELSE 'High Risk' END"
    return EVENTS + f"""SELECT count(*) AS total_students, {sql_r6('avg(probability)')} AS avg_risk_probability,
  count(*) FILTER ({level} = 'High Risk') AS high_risk_count, count(*) FILTER ({level} = 'Medium Risk') AS medium_risk_count,
  count(*) FILTER ({level} = 'Low Risk') AS low_risk_count, count(*) FILTER (probability >= 0.5) AS predicted_pass_count,
  count(*) FILTER (NOT probability >= 0.5) AS predicted_fail_count FROM scored {where}"""


@query("batch_summary", _batch_sql(""))
def q_batch(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(risk.batch_summary(scored_events(spark, sf)), "avg_risk_probability")


@query("batch_summary_empty", _batch_sql("WHERE probability < 0"))
def q_batch_empty(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(risk.batch_summary(scored_events(spark, sf).filter("probability < 0")), "avg_risk_probability")


@query("recent_prediction_stats", EVENTS + f"""SELECT (SELECT count(*) FROM scored) AS total_predictions, count(*) AS recent_predictions,
  {sql_r6('avg(probability)')} AS avg_probability, {sql_r6('avg(CASE WHEN probability >= 0.6 THEN 0e0 ELSE 1e0 END) * 100.0')} AS high_risk_percentage,
  CAST(NULL AS VARCHAR) AS message FROM (SELECT * FROM scored ORDER BY ts DESC, event_id DESC LIMIT 100)""")
def q_recent(spark: SparkSession, sf: str) -> DataFrame:
    out = risk.recent_stats(scored_events(spark, sf), "ts", "event_id")
    return round_columns(out, "avg_probability", "high_risk_percentage")


@query("retain_latest", EVENTS + "SELECT event_id, user_id, event_type FROM scored ORDER BY ts DESC, event_id DESC LIMIT 1000")
def q_retain(spark: SparkSession, sf: str) -> DataFrame:
    return risk.retain_latest(scored_events(spark, sf), "ts", "event_id").select("event_id", "user_id", "event_type")


HOURLY = EVENTS + f"""SELECT date_trunc('hour', ts) AS hour_start, count(*) AS n, {sql_r6('avg(probability)')} AS avg_probability,
  count(*) FILTER (probability < 0.6) AS high_risk FROM scored GROUP BY 1"""


@query("predictions_by_hour", HOURLY)
def q_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(risk.hourly_counts(scored_events(spark, sf)), "avg_probability")
