"""Entity schema, column roles, value rules and wording.

Everything in this file is a fixed value: names, bounds, thresholds and messages
that results must reproduce exactly.
"""

from pyspark.sql import types as T

KEY = "student_id"
NUMERIC_FEATURES = [
    "prior_gpa", "attendance_pct", "quiz_avg", "assign_avg", "midterm",
    "study_hours_wk", "on_time_submit_pct", "lms_logins_wk", "forum_posts", "commute_min",
]
CATEGORICAL_FEATURES = ["gender", "school_type", "parent_edu"]
TARGETS = ["final_score", "final_grade_band", "passed"]
LABEL = "passed"

# Columns in storage order with their types.
ENTITY_SCHEMA = T.StructType([
    T.StructField("student_id", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("school_type", T.StringType()),
    T.StructField("parent_edu", T.StringType()),
    T.StructField("prior_gpa", T.DoubleType()),
    T.StructField("attendance_pct", T.DoubleType()),
    T.StructField("study_hours_wk", T.DoubleType()),
    T.StructField("commute_min", T.DoubleType()),
    T.StructField("quiz_avg", T.DoubleType()),
    T.StructField("assign_avg", T.DoubleType()),
    T.StructField("midterm", T.DoubleType()),
    T.StructField("on_time_submit_pct", T.DoubleType()),
    T.StructField("lms_logins_wk", T.DoubleType()),
    T.StructField("forum_posts", T.DoubleType()),
    T.StructField("final_score", T.DoubleType()),
    T.StructField("final_grade_band", T.StringType()),
    T.StructField("passed", T.LongType()),
])

# One scoring request: the ten numeric and three categorical features.
REQUEST_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in NUMERIC_FEATURES]
    + [T.StructField(c, T.StringType()) for c in CATEGORICAL_FEATURES]
)

# Bounds used when clipping features and when validating a request.
CLIP_RANGES = {
    "prior_gpa": (0.0, 4.0),
    "attendance_pct": (0.0, 100.0),
    "quiz_avg": (0.0, 100.0),
    "assign_avg": (0.0, 100.0),
    "midterm": (0.0, 100.0),
    "study_hours_wk": (0.0, 50.0),
    "on_time_submit_pct": (0.0, 100.0),
    "lms_logins_wk": (0.0, 50.0),
    "forum_posts": (0.0, 100.0),
    "commute_min": (0.0, 180.0),
}

# Ingest rules: column, lower bound, upper bound (None = open), message.
RANGE_RULES = [
    ("prior_gpa", 0.0, 4.0, "prior_gpa outside 0-4 range"),
    ("attendance_pct", 0.0, 100.0, "attendance_pct outside 0-100 range"),
    ("quiz_avg", 0.0, 100.0, "quiz_avg outside 0-100 range"),
    ("assign_avg", 0.0, 100.0, "assign_avg outside 0-100 range"),
    ("midterm", 0.0, 100.0, "midterm outside 0-100 range"),
    ("on_time_submit_pct", 0.0, 100.0, "on_time_submit_pct outside 0-100 range"),
]
NON_NEGATIVE_RULES = [
    ("study_hours_wk", 0.0, None, "study_hours_wk has negative values"),
    ("commute_min", 0.0, None, "commute_min has negative values"),
    ("lms_logins_wk", 0.0, None, "lms_logins_wk has negative values"),
    ("forum_posts", 0.0, None, "forum_posts has negative values"),
]
MAX_MISSING_RATE = 0.1

# Outcome derivation: (column, rescale, weight) terms, adjustments and bands.
SCORE_TERMS = [
    ("prior_gpa", 25.0, 0.25),
    ("attendance_pct", None, 0.15),
    ("study_hours_wk", 2.5, 0.10),
    ("quiz_avg", None, 0.15),
    ("assign_avg", None, 0.15),
    ("midterm", None, 0.20),
]
SCHOOL_BOOST = {"Private": 3.0, "Charter": 1.0}
EDU_BOOST = {"High School": -2.0, "Some College": 0.0, "Bachelor": 2.0, "Master": 4.0, "PhD": 5.0}
GRADE_BANDS = [(90.0, "A"), (80.0, "B"), (70.0, "C"), (60.0, "D")]
GRADE_FLOOR = "F"
PASS_MARK = 60.0

# Profiling and leakage.
LEAKAGE_CORRELATION = 0.9
LEAKAGE_WORDS = ["final", "grade"]
HIGH_CORRELATION = 0.7
HISTOGRAM_BINS = 30
BOX_FEATURES = ["prior_gpa", "attendance_pct", "quiz_avg", "assign_avg", "midterm", "study_hours_wk"]

# Engineered features: cap used to scale each activity count.
ENGAGEMENT_CAPS = {"lms_logins_wk": 50.0, "forum_posts": 20.0}
ENGAGEMENT_PCT = "on_time_submit_pct"
CONSISTENCY_COLUMNS = ["quiz_avg", "assign_avg", "midterm"]

# Evaluation and drift.
DECISION_THRESHOLD = 0.5
SWEEP_THRESHOLDS = [i / 20.0 for i in range(2, 18)]
MIN_GROUP_SIZE = 10
CALIBRATION_BINS = 10
DRIFT_ALPHA = 0.05
DRIFT_SHARE = 0.2
F1_DEGRADATION = 0.05

# Risk levels, first match wins.
RISK_LEVELS = [(0.8, "Low Risk"), (0.6, "Medium Risk")]
RISK_FLOOR = "High Risk"
TOP_FACTORS = 5
TOP_RECOMMENDATIONS = 5
RECENT_PREDICTIONS = 100
RETAINED_PREDICTIONS = 1000

# Recommendation rules: column, "below" threshold, messages.
RECOMMENDATION_RULES = [
    ("attendance_pct", 80.0, [
        "Improve attendance - aim for >80% class participation",
        "Set up study buddy system for missed classes",
    ]),
    ("study_hours_wk", 10.0, [
        "Increase study hours to at least 10 hours per week",
        "Create structured study schedule with breaks",
    ]),
    ("quiz_avg", 70.0, [
        "Focus on quiz preparation - use practice questions",
        "Schedule regular review sessions for quizzes",
    ]),
    ("assign_avg", 70.0, [
        "Improve assignment quality - seek feedback before submission",
        "Break down large assignments into smaller tasks",
    ]),
    ("midterm", 70.0, [
        "Address midterm performance gaps with tutoring",
        "Review midterm topics for final exam preparation",
    ]),
    ("lms_logins_wk", 3.0, [
        "Increase LMS engagement - check platform daily",
        "Participate in online discussions and activities",
    ]),
    ("forum_posts", 2.0, [
        "Engage more in class forums - ask questions and help others",
    ]),
]
LEVEL_RECOMMENDATIONS = {
    "High Risk": [
        "URGENT: Schedule meeting with academic advisor",
        "Consider intensive tutoring support",
        "Implement daily progress tracking",
    ],
    "Medium Risk": [
        "Schedule regular check-ins with faculty",
        "Join study groups for peer support",
    ],
    "Low Risk": [
        "Maintain current excellent performance",
        "Consider peer tutoring opportunities",
        "Prepare for advanced coursework",
    ],
}

# Risk factors: column, comparison, threshold, factor, severity, text before the
# value, digits shown, text after the value.
FACTOR_RULES = [
    ("attendance_pct", "<", 80.0, "attendance", "high", "Low attendance (", 1, "%)"),
    ("study_hours_wk", "<", 10.0, "study_hours", "high", "Insufficient study time (", 1, " hrs/wk)"),
    ("quiz_avg", "<", 70.0, "quiz_performance", "medium", "Poor quiz scores (", 1, "%)"),
    ("assign_avg", "<", 70.0, "assignment_performance", "medium", "Low assignment scores (", 1, "%)"),
    ("midterm", "<", 70.0, "midterm_performance", "medium", "Weak midterm performance (", 1, "%)"),
    ("on_time_submit_pct", "<", 80.0, "submission_behavior", "medium", "Late submissions (", 1, "% on-time)"),
    ("lms_logins_wk", "<", 3.0, "engagement", "medium", "Low platform engagement (", 1, " logins/wk)"),
    ("forum_posts", "<", 2.0, "participation", "medium", "Minimal forum participation (", 0, " posts)"),
    ("commute_min", ">", 60.0, "commute", "medium", "Long commute time (", 0, " min)"),
]

# Risk drivers: name, averaged columns, target. Score = max(0, (target - x) / target).
DRIVER_RULES = [
    ("attendance", ["attendance_pct"], 80.0),
    ("study_time", ["study_hours_wk"], 10.0),
    ("performance", ["quiz_avg", "assign_avg", "midterm"], 70.0),
    ("engagement", ["lms_logins_wk"], 3.0),
    ("submission", ["on_time_submit_pct"], 80.0),
]
