import pytest
from pyspark.sql import functions as F

from cohortlens.operators import risk
from test_quality import frame

AT_RISK = dict(prior_gpa=1.5, attendance_pct=45.0, study_hours_wk=2.0, commute_min=90.0, quiz_avg=35.0, assign_avg=40.0,
               midterm=30.0, on_time_submit_pct=30.0, lms_logins_wk=1.0, forum_posts=0.0)


def test_levels_at_the_bounds(spark):
    df = spark.createDataFrame([(0.8,), (0.79,), (0.6,), (0.59,), (0.5,)], "probability double")
    rows = risk.with_risk(df).collect()
    assert [r.risk_level for r in rows] == ["Low Risk", "Medium Risk", "Medium Risk", "High Risk", "High Risk"]
    assert [r.prediction for r in rows] == [True] * 5
    assert rows[0].confidence == pytest.approx(0.6)


def test_factors_of_a_student_at_risk(spark):
    row = frame(spark, AT_RISK).select(risk.risk_factors().alias("f")).first()
    assert [e.factor for e in row.f] == ["attendance", "study_hours", "quiz_performance", "assignment_performance", "midterm_performance"]
    assert row.f[0].description == "Low attendance (45.0%)"
    assert [e.severity for e in row.f] == ["high", "high", "medium", "medium", "medium"]


def test_good_student_has_no_factors(spark):
    row = frame(spark, {}).select(risk.risk_factors().alias("f"), risk.recommendations(F.lit("Low Risk")).alias("r")).first()
    assert row.f == []
    assert row.r == ["Maintain current excellent performance", "Consider peer tutoring opportunities", "Prepare for advanced coursework"]


def test_recommendations_are_the_first_five(spark):
    row = frame(spark, AT_RISK).select(risk.recommendations(F.lit("High Risk")).alias("r")).first()
    assert len(row.r) == 5
    assert row.r[0].startswith("Improve attendance") and row.r[4].startswith("Focus on quiz")


def test_missing_values_fire_no_rule(spark):
    row = frame(spark, {"attendance_pct": None}).select(risk.risk_factors().alias("f"), risk.risk_drivers().alias("d")).first()
    assert row.f == [] and row.d["attendance"] is None and row.d["study_time"] == 0.0


def test_drivers(spark):
    d = frame(spark, AT_RISK).select(risk.risk_drivers().alias("d")).first().d
    assert d["attendance"] == pytest.approx(35 / 80)
    assert d["performance"] == pytest.approx((70 - 35) / 70)


def test_batch_summary(spark):
    df = spark.createDataFrame([(0.9,), (0.7,), (0.3,)], "probability double")
    row = risk.batch_summary(df).first()
    assert (row.total_students, row.high_risk_count, row.medium_risk_count, row.low_risk_count) == (3, 1, 1, 1)
    assert (row.predicted_pass_count, row.predicted_fail_count) == (2, 1)
    empty = risk.batch_summary(df.filter("probability > 2")).first()
    assert empty.total_students == 0 and empty.avg_risk_probability is None and empty.low_risk_count == 0


def test_recent_stats_of_an_empty_log(spark):
    df = spark.createDataFrame([], "ts timestamp, event_id bigint, probability double")
    row = risk.recent_stats(df, "ts", "event_id").first()
    assert row.total_predictions == 0 and row.message == "No predictions made yet"
