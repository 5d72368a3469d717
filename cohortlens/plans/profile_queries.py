"""Queries for profiles, correlations, histograms and fitted constants."""

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.operators import profile
from cohortlens.plans.catalog import LEARNERS, LINES, query, round_columns, sql_r6
from cohortlens.schema import BOX_FEATURES, CATEGORICAL_FEATURES, ENTITY_SCHEMA, NUMERIC_FEATURES
from cohortlens.sources.bindings import learners, scored_lineitem, students, table

LINE_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SCORED_NUMBERS = [*NUMERIC_FEATURES, "final_score"]


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with negative zeros normalised."""
    plus = {c: F.col(c) + 0.0 for c in ("l_discount", "l_tax")}
    return table(spark, sf, "lineitem").withColumns(plus)


def _long(columns, source: str, keep: str = "", text: bool = False) -> str:
    kind = "VARCHAR" if text else "DOUBLE"
    zero = "" if text else " + 0.0"
    return " UNION ALL ".join(
        f"SELECT {keep}'{c}' AS feature, CAST({c} AS {kind}){zero} AS value FROM {source} WHERE {c} IS NOT NULL"
        for c in columns)


_nulls = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in ENTITY_SCHEMA.names)


@query("eda_overview", LEARNERS + f"""
SELECT count(*) AS n_rows, 17 AS n_columns, CAST(sum({_nulls}) AS BIGINT) AS missing_values,
  {sql_r6('avg(CAST(passed AS DOUBLE))')} AS pass_rate, {sql_r6('avg(final_score)')} AS score_mean,
  {sql_r6('stddev_samp(final_score)')} AS score_std FROM students""")
def q_overview(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(profile.overview(students(spark, sf)), "pass_rate", "score_mean", "score_std")


def _summary_sql(columns, source: str) -> str:
    return (f"SELECT feature, {sql_r6('avg(value)')} AS mean, {sql_r6('stddev_samp(value)')} AS std, "
            f"{sql_r6('min(value)')} AS min, {sql_r6('max(value)')} AS max "
            f"FROM ({_long(columns, source)}) GROUP BY feature")


@query("numeric_summary", LEARNERS + _summary_sql(SCORED_NUMBERS, "learners"))
def q_summary(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(profile.numeric_summary(learners(spark, sf), SCORED_NUMBERS), "mean", "std", "min", "max")


@query("numeric_summary_lineitem", _summary_sql(LINE_MEASURES, "lineitem"))
def q_summary_lines(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(profile.numeric_summary(lines(spark, sf), LINE_MEASURES), "mean", "std", "min", "max")


@query("value_counts", LEARNERS + "SELECT final_grade_band, count(*) AS n FROM students GROUP BY final_grade_band")
def q_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.value_counts(students(spark, sf), "final_grade_band")


@query("class_balance", LINES + f"""
SELECT label, count(*) AS n, {sql_r6('CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM scored)')} AS share
FROM scored GROUP BY label""")
def q_balance(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(profile.class_balance(scored_lineitem(spark, sf), "label"), "share")


@query("categorical_distributions", LEARNERS + f"""
SELECT feature, value, count(*) AS n FROM ({_long(CATEGORICAL_FEATURES, 'learners', text=True)}) GROUP BY feature, value""")
def q_categories(spark: SparkSession, sf: str) -> DataFrame:
    return profile.categorical_distributions(learners(spark, sf), CATEGORICAL_FEATURES)


def _target_sql(columns, source: str, target: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {sql_r6(f'abs(corr({c}, {target}))')} AS abs_corr FROM {source}" for c in columns)


@query("target_correlation", LEARNERS + _target_sql(NUMERIC_FEATURES, "learners", "final_score"))
def q_target(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(profile.target_correlation(learners(spark, sf), NUMERIC_FEATURES, "final_score"), "abs_corr")


@query("target_correlation_lineitem",
       _target_sql(["l_quantity", "l_discount", "l_tax", "l_linenumber"], "lineitem", "l_extendedprice"))
def q_target_lines(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    return round_columns(profile.target_correlation(lines(spark, sf), columns, "l_extendedprice"), "abs_corr")


@query("leakage_corr_flags", LEARNERS + f"""
SELECT * FROM ({_target_sql([*NUMERIC_FEATURES, 'raw_copy'], '(SELECT *, final_score * 2.0 + prior_gpa AS raw_copy FROM learners)', 'final_score')})
WHERE abs_corr > 0.9""")
def q_leak(spark: SparkSession, sf: str) -> DataFrame:
    """One column is made from the target, so that the rule has something to find."""
    df = learners(spark, sf).withColumn("raw_copy", F.col("final_score") * 2.0 + F.col("prior_gpa"))
    return round_columns(profile.leakage_flags(df, [*NUMERIC_FEATURES, "raw_copy"], "final_score"), "abs_corr")


def _matrix_sql(columns, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {sql_r6(f'corr({a}, {b})')} AS corr FROM {source}"
        for a, b in combinations(columns, 2))


@query("correlation_matrix", LEARNERS + _matrix_sql(NUMERIC_FEATURES, "learners"))
def q_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(profile.correlation_matrix(learners(spark, sf), NUMERIC_FEATURES), "corr")


@query("correlation_matrix_lineitem", _matrix_sql(LINE_MEASURES, "lineitem"))
def q_matrix_lines(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(profile.correlation_matrix(lines(spark, sf), LINE_MEASURES), "corr")


@query("high_corr_pairs", LEARNERS + f"SELECT * FROM ({_matrix_sql(NUMERIC_FEATURES, 'learners')}) WHERE abs(corr) > 0.7")
def q_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(profile.high_correlation_pairs(learners(spark, sf), NUMERIC_FEATURES), "corr")


def histogram_sql(long: str, by: str = "", shared: bool = False, bins: int = 30) -> str:
    """CTE text after a WITH list: bins of a (by, feature, value) table."""
    over = "feature" if shared else f"{by}feature"
    return f""",
long AS ({long}),
ends AS (SELECT {over}, min(value) AS low, max(value) AS high FROM long GROUP BY {over}),
placed AS (
  SELECT long.*, low, high, least(CAST(floor((value - low) / (high - low) * {bins}) AS BIGINT), {bins - 1}) AS bin
  FROM long JOIN ends USING ({over})),
counts AS (SELECT {by}feature, low, high, bin, count(*) AS n FROM placed GROUP BY {by}feature, low, high, bin),
sizes AS (SELECT {by}feature, count(*) AS size FROM long GROUP BY {by}feature)
SELECT {by}feature, bin, {sql_r6(f'low + (high - low) / {bins} * bin')} AS bin_start,
  {sql_r6(f'low + (high - low) / {bins} * (bin + 1)')} AS bin_end, n,
  {sql_r6(f'n / (size * ((high - low) / {bins}))')} AS density
FROM counts JOIN sizes USING ({by}feature)"""


@query("feature_histogram", LINES + histogram_sql(_long(LINE_MEASURES, "scored")))
def q_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(profile.histogram(lines(spark, sf), LINE_MEASURES), "bin_start", "bin_end", "density")


@query("feature_histogram_learners", LEARNERS + histogram_sql(_long(NUMERIC_FEATURES, "learners")))
def q_histogram_learners(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(
        profile.histogram(learners(spark, sf), NUMERIC_FEATURES), "bin_start", "bin_end", "density")


@query("score_density_by_class", LINES + histogram_sql(_long(["probability"], "scored", "label, "), "label, "))
def q_density(spark: SparkSession, sf: str) -> DataFrame:
    out = profile.histogram(scored_lineitem(spark, sf), ["probability"], ["label"])
    return round_columns(out, "bin_start", "bin_end", "density")


def _box_sql(long: str, label: str) -> str:
    return f""",
long AS ({long}),
quart AS (SELECT feature, {label}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3 FROM long GROUP BY feature, {label}),
marked AS (SELECT long.*, q1, median, q3, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM long JOIN quart USING (feature, {label}))
SELECT feature, {label}, count(*) AS n, {sql_r6('max(q1)')} AS q1, {sql_r6('max(median)')} AS median,
  {sql_r6('max(q3)')} AS q3, {sql_r6('min(value) FILTER (inside)')} AS whisker_low,
  {sql_r6('max(value) FILTER (inside)')} AS whisker_high, count(*) FILTER (NOT inside) AS n_outliers
FROM marked GROUP BY feature, {label}"""


BOX = ("q1", "median", "q3", "whisker_low", "whisker_high")


@query("box_stats_by_label", LEARNERS + _box_sql(_long(BOX_FEATURES, "learners", "passed, "), "passed"))
def q_box(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(profile.box_stats(learners(spark, sf)), *BOX)


@query("box_stats_lineitem", LINES + _box_sql(_long(["l_quantity", "l_extendedprice"], "scored", "label, "), "label"))
def q_box_lines(spark: SparkSession, sf: str) -> DataFrame:
    out = profile.box_stats(scored_lineitem(spark, sf), ["l_quantity", "l_extendedprice"], "label")
    return round_columns(out, *BOX)


def _median_sql(columns, source: str) -> str:
    return (f"SELECT feature, {sql_r6('quantile_cont(value, 0.5)')} AS median "
            f"FROM ({_long(columns, source)}) GROUP BY feature")


@query("median_fit", LEARNERS + _median_sql(NUMERIC_FEATURES, "learners"))
def q_median(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(profile.medians(learners(spark, sf), NUMERIC_FEATURES), "median")


@query("median_fit_lineitem", _median_sql(LINE_MEASURES, "lineitem"))
def q_median_lines(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(profile.medians(lines(spark, sf), LINE_MEASURES), "median")


def _mode_sql(columns, source: str) -> str:
    return f"""SELECT feature, value AS mode, n FROM (
  SELECT feature, value, n, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS rn FROM (
    SELECT feature, value, count(*) AS n FROM ({_long(columns, source, text=True)}) GROUP BY feature, value))
WHERE rn = 1"""


@query("mode_fit", LEARNERS + _mode_sql(CATEGORICAL_FEATURES, "learners"))
def q_mode(spark: SparkSession, sf: str) -> DataFrame:
    return profile.modes(learners(spark, sf), CATEGORICAL_FEATURES)


@query("mode_fit_lineitem", _mode_sql(["l_returnflag", "l_linestatus", "l_partkey"], "lineitem"))
def q_mode_lines(spark: SparkSession, sf: str) -> DataFrame:
    return profile.modes(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_partkey"])


@query("scaler_fit", LEARNERS + f"""SELECT feature, {sql_r6('avg(value)')} AS mean, {sql_r6('stddev_pop(value)')} AS std
FROM ({_long(NUMERIC_FEATURES, 'learners')}) GROUP BY feature""")
def q_scale(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(profile.scale_stats(learners(spark, sf), NUMERIC_FEATURES), "mean", "std")


@query("distinct_levels", f"SELECT DISTINCT feature, value FROM ({_long(['l_returnflag', 'l_linestatus', 'l_linenumber'], 'lineitem', text=True)})")
def q_levels(spark: SparkSession, sf: str) -> DataFrame:
    return profile.distinct_levels(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])
