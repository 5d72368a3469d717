"""Queries for distribution and performance drift."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.functions.distributions import ks_asymptotic, ks_p
from cohortlens.operators import drift
from cohortlens.plans.catalog import SIDES, query, r6, round_columns, sql_r6
from cohortlens.plans.metric_queries import auc_sql
from cohortlens.plans.profile_queries import histogram_sql
from cohortlens.session import shared_dir
from cohortlens.sources import files
from cohortlens.sources.bindings import drift_sides

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORIES = ["l_returnflag", "l_linestatus"]
MOMENTS = ("ref_mean", "cur_mean", "ref_std", "cur_std")


def number_rows(columns, source: str = "sides", keep: str = "side, ") -> str:
    return " UNION ALL ".join(f"SELECT {keep}'{c}' AS feature, {c} AS value FROM {source} WHERE {c} IS NOT NULL" for c in columns)


KS = f""",
long AS ({number_rows(NUMBERS)}),
sizes AS (SELECT feature, count(*) FILTER (side = 'reference') AS nr, count(*) FILTER (side = 'current') AS nc FROM long GROUP BY feature),
counts AS (SELECT feature, value, count(*) FILTER (side = 'reference') AS r, count(*) FILTER (side = 'current') AS c
  FROM long GROUP BY feature, value),
gaps AS (SELECT counts.feature AS feature, nr, nc,
  abs(CAST(sum(r) OVER w AS DOUBLE) / nr - CAST(sum(c) OVER w AS DOUBLE) / nc) AS gap
  FROM counts JOIN sizes ON sizes.feature = counts.feature
  WINDOW w AS (PARTITION BY counts.feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
ks AS (SELECT feature, nr, nc, max(gap) AS d FROM gaps GROUP BY feature, nr, nc),
sized AS (SELECT *, round(CAST(nr AS DOUBLE) * nc / (nr + nc)) AS en FROM ks),
shifted AS (SELECT *, sqrt(en) * (d + 1.0 / (en * 6.0) + (d - 1.0) / (en * 4.0)) AS x FROM sized),
ksp AS (SELECT feature, nr, nc, d, CASE WHEN x < 0.2 THEN 1.0 ELSE least(greatest(2.0 * (
  SELECT sum(pow(-1.0, i - 1) * exp(-2.0 * i * i * x * x)) FROM range(1, 101) t(i)), 0.0), 1.0) END AS p FROM shifted),
moments AS (SELECT feature, avg(value) FILTER (side = 'reference') AS ref_mean, avg(value) FILTER (side = 'current') AS cur_mean,
  stddev_samp(value) FILTER (side = 'reference') AS ref_std, stddev_samp(value) FILTER (side = 'current') AS cur_std
  FROM long GROUP BY feature)"""

# Two levels: p = erfc(sqrt(x / 2)) by its power series; three levels: p = exp(-x / 2).
CHI = f""",
texts AS ({number_rows(CATEGORIES)}),
cells AS (SELECT feature, value, CAST(count(*) FILTER (side = 'reference') AS DOUBLE) AS r,
  CAST(count(*) FILTER (side = 'current') AS DOUBLE) AS c FROM texts GROUP BY feature, value),
margins AS (SELECT feature, sum(r) AS nr, sum(c) AS nc, count(*) AS k FROM cells GROUP BY feature),
parts AS (SELECT cells.feature AS feature, k, r, c, nr * (r + c) / (nr + nc) AS er, nc * (r + c) / (nr + nc) AS ec
  FROM cells JOIN margins ON margins.feature = cells.feature),
plain AS (SELECT feature, k, sum((r - er) * (r - er) / er + (c - ec) * (c - ec) / ec) AS x FROM parts GROUP BY feature, k),
chi AS (SELECT feature, k, sum(CASE WHEN k = 2
    THEN pow(greatest(abs(r - er) - 0.5, 0), 2) / er + pow(greatest(abs(c - ec) - 0.5, 0), 2) / ec
    ELSE pow(r - er, 2) / er + pow(c - ec, 2) / ec END) AS x FROM parts GROUP BY feature, k),
chip AS (SELECT feature, k, x, CASE k WHEN 3 THEN exp(-x / 2.0) WHEN 2 THEN greatest(0.0, 1.0 - 2.0 / sqrt(pi()) * (
  SELECT sum(term) FROM (SELECT pow(-1.0, i) * exp((2 * i + 1) * ln(sqrt(greatest(x, 1e-300) / 2.0)) - lgamma(i + 1.0)) / (2 * i + 1) AS term
  FROM range(0, 120) t(i)))) END AS p FROM chi)"""


@query("category_union", SIDES + f"SELECT DISTINCT feature, value FROM ({number_rows(CATEGORIES)})")
def q_union(spark: SparkSession, sf: str) -> DataFrame:
    return drift.category_counts(drift_sides(spark, sf), CATEGORIES).select("feature", "value")


_counts = "SELECT feature, value, count(*) FILTER (side = 'reference') AS n_ref, count(*) FILTER (side = 'current') AS n_cur FROM"


@query("category_align_full_outer", SIDES + f"""{_counts} (
  {number_rows(CATEGORIES)} UNION ALL SELECT side, 'month', CAST(date_trunc('month', l_shipdate) AS DATE)::VARCHAR FROM sides)
GROUP BY feature, value""")
def q_align(spark: SparkSession, sf: str) -> DataFrame:
    """Shipping months never occur on both sides, so the outer join has unmatched rows both ways."""
    sides = drift_sides(spark, sf).withColumn("month", F.date_format("l_shipdate", "yyyy-MM-01"))
    only = lambda side: sides.filter(F.col("side") == side)
    return drift.align_categories(only("reference"), only("current"), [*CATEGORIES, "month"])


@query("drift_ks", SIDES + KS + f""" SELECT ksp.feature AS feature, {sql_r6('d')} AS ks_statistic, {sql_r6('p')} AS p_value,
  p < 0.05 AS drift_detected, {', '.join(f'{sql_r6(m)} AS {m}' for m in MOMENTS)} FROM ksp JOIN moments ON moments.feature = ksp.feature""")
def q_ks(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(drift.ks_drift(drift_sides(spark, sf), NUMBERS), "ks_statistic", "p_value", *MOMENTS)


@query("drift_ks_pvalue", SIDES + KS + f" SELECT feature, nr AS size_ref, nc AS size_cur, {sql_r6('p')} AS p_value FROM ksp")
def q_ks_p(spark: SparkSession, sf: str) -> DataFrame:
    stats = drift.ks_statistics(drift_sides(spark, sf), NUMBERS)
    p = ks_asymptotic(F.col("ks_statistic"), F.col("size_ref"), F.col("size_cur"))
    return stats.select("feature", "size_ref", "size_cur", r6(p).alias("p_value"))


@query("drift_ks_auto", SIDES + KS + f" SELECT feature, nr AS size_ref, nc AS size_cur, {sql_r6('d')} AS ks_statistic, {sql_r6('p')} AS p_value FROM ksp")
def q_ks_auto(spark: SparkSession, sf: str) -> DataFrame:
    """The default method: asymptotic at every size."""
    stats = drift.ks_statistics(drift_sides(spark, sf), NUMBERS)
    p = ks_p(F.col("ks_statistic"), F.col("size_ref"), F.col("size_cur"))
    return stats.select("feature", "size_ref", "size_cur", r6("ks_statistic").alias("ks_statistic"), r6(p).alias("p_value"))


@query("drift_chi2", SIDES + CHI + f" SELECT feature, {sql_r6('x')} AS chi2_statistic, k - 1 AS dof FROM plain")
def q_chi2(spark: SparkSession, sf: str) -> DataFrame:
    counts = drift.category_counts(drift_sides(spark, sf), CATEGORIES)
    return round_columns(drift.chi_square_from_counts(counts, yates=False).select("feature", "chi2_statistic", "dof"), "chi2_statistic")


@query("drift_chi2_yates", SIDES + CHI + f" SELECT feature, {sql_r6('x')} AS chi2_statistic, k - 1 AS dof FROM chi")
def q_yates(spark: SparkSession, sf: str) -> DataFrame:
    counts = drift.category_counts(drift_sides(spark, sf), CATEGORIES)
    return round_columns(drift.chi_square_from_counts(counts).select("feature", "chi2_statistic", "dof"), "chi2_statistic")


TABLE = KS + CHI + """,
drift AS (
  SELECT ksp.feature AS feature, 'numerical' AS feature_type, d AS statistic, p AS p_value, p < 0.05 AS drift_detected,
    ref_mean, cur_mean, ref_std, cur_std FROM ksp JOIN moments ON moments.feature = ksp.feature
  UNION ALL
  SELECT feature, 'categorical', x, p, p < 0.05, NULL, NULL, NULL, NULL FROM chip)"""


@query("drift_table", SIDES + TABLE + f""" SELECT feature, feature_type, drift_detected,
  {', '.join(f'{sql_r6(m)} AS {m}' for m in ('statistic', 'p_value', *MOMENTS))} FROM drift""")
def q_table(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(drift.drift_table(drift_sides(spark, sf), NUMBERS, CATEGORIES), "statistic", "p_value", *MOMENTS)


@query("top_drifted", SIDES + TABLE + f""" SELECT feature, feature_type, {sql_r6('statistic')} AS statistic, {sql_r6('p_value')} AS p_value
FROM drift WHERE p_value < 0.9 ORDER BY p_value, statistic DESC, feature LIMIT 10""")
def q_top(spark: SparkSession, sf: str) -> DataFrame:
    """A wide significance level, since these populations hardly differ."""
    top = drift.top_drifted(drift.drift_table(drift_sides(spark, sf), NUMBERS, CATEGORIES, alpha=0.9))
    return round_columns(top.select("feature", "feature_type", "statistic", "p_value"), "statistic", "p_value")


_scored = """, scored AS (SELECT side, CAST(l_returnflag = 'R' AS BIGINT) AS label, l_quantity / 50.0 AS probability FROM sides),
rates AS (SELECT m.*, roc_auc FROM (SELECT side, tn + fp + fn + tp AS n, (tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE) AS accuracy,
    coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS precision, coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS recall,
    coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0) AS f1 FROM (
      SELECT side, count(*) FILTER (label = 0 AND probability < 0.5) AS tn, count(*) FILTER (label = 0 AND probability >= 0.5) AS fp,
        count(*) FILTER (label = 1 AND probability < 0.5) AS fn, count(*) FILTER (label = 1 AND probability >= 0.5) AS tp
      FROM scored GROUP BY side)) m JOIN (""" + auc_sql("scored", "side, ") + """) a ON a.side = m.side)"""
_sides = [(s, m) for s in ("reference", "current") for m in drift.METRICS]
_pick = ", ".join(f"max(CASE WHEN side = '{s}' THEN {m} END) AS {s}_{m}" for s, m in [*_sides, ("reference", "n"), ("current", "n")])


def sides_scored(spark: SparkSession, sf: str) -> DataFrame:
    return drift_sides(spark, sf).select(
        "side", (F.col("l_returnflag") == "R").cast("bigint").alias("label"), (F.col("l_quantity") / 50.0).alias("probability"))


DROPS = ("accuracy", "f1", "roc_auc")


@query("perf_degradation", SIDES + _scored + f""", wide AS (SELECT {_pick} FROM rates)
SELECT reference_n, current_n, {', '.join(f'{sql_r6(f"{s}_{m}")} AS {s}_{m}' for s, m in _sides)},
  {', '.join(f'{sql_r6(f"reference_{m} - current_{m}")} AS {m}_degradation' for m in DROPS)} FROM wide""")
def q_performance(spark: SparkSession, sf: str) -> DataFrame:
    out = drift.performance_drift(sides_scored(spark, sf))
    return round_columns(out, *[f"{s}_{m}" for s, m in _sides], *[f"{m}_degradation" for m in DROPS])


@query("drift_summary", SIDES + TABLE + _scored + f""", wide AS (SELECT {_pick} FROM rates),
totals AS (SELECT count(*) AS total_features, count(*) FILTER (drift_detected) AS features_with_drift,
  (SELECT reference_f1 - current_f1 FROM wide) AS f1_drop FROM drift)
SELECT total_features, features_with_drift, {sql_r6('features_with_drift * 100.0 / total_features')} AS drift_percentage,
  {sql_r6('f1_drop')} AS f1_degradation, features_with_drift > total_features * 0.2 AS significant_drift,
  f1_drop > 0.05 AS performance_degradation, features_with_drift > total_features * 0.2 OR f1_drop > 0.05 AS needs_attention FROM totals""")
def q_summary(spark: SparkSession, sf: str) -> DataFrame:
    sides = drift_sides(spark, sf)
    out = drift.drift_summary(drift.drift_table(sides, NUMBERS, CATEGORIES), drift.performance_drift(sides_scored(spark, sf)))
    return round_columns(out, "drift_percentage", "f1_degradation")


@query("drift_histograms", SIDES + histogram_sql(number_rows(NUMBERS), "side, "))
def q_histograms(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(drift.drift_histograms(drift_sides(spark, sf), NUMBERS), "bin_start", "bin_end", "density")


_bars = f"""
texts AS ({number_rows(CATEGORIES)}),
levels AS (SELECT DISTINCT feature, value FROM texts),
sizes AS (SELECT feature, side, count(*) AS size FROM texts GROUP BY feature, side),
found AS (SELECT feature, side, value, count(*) AS n FROM texts GROUP BY feature, side, value)
SELECT s.side AS side, l.feature AS feature, l.value AS value, coalesce(n, 0) AS n, {sql_r6('coalesce(n, 0) / CAST(size AS DOUBLE)')} AS share
FROM levels l JOIN sizes s ON s.feature = l.feature
LEFT JOIN found f ON f.feature = l.feature AND f.value = l.value AND f.side = s.side"""


@query("drift_visuals", SIDES + TABLE + f""",
top AS (SELECT feature FROM drift WHERE p_value < 0.9 ORDER BY p_value, statistic DESC, feature LIMIT 10),
shapes AS (WITH one AS (SELECT 1) {histogram_sql(number_rows(NUMBERS), 'side, ')}),
bars AS (WITH {_bars})
SELECT side, feature, CAST(bin AS VARCHAR) AS slot, n, density AS height FROM shapes WHERE feature IN (SELECT feature FROM top)
UNION ALL SELECT side, feature, value, n, share FROM bars WHERE feature IN (SELECT feature FROM top)""")
def q_visuals(spark: SparkSession, sf: str) -> DataFrame:
    """What a plot of the ten most drifted features shows; a wide significance level, since these populations hardly differ."""
    sides = drift_sides(spark, sf).select("side", *NUMBERS, *CATEGORIES)
    shapes, bars = drift.drift_visuals(sides, drift.drift_table(sides, NUMBERS, CATEGORIES, alpha=0.9))
    shapes = shapes.select("side", "feature", F.col("bin").cast("string").alias("slot"), "n", F.col("density").alias("height"))
    bars = bars.select("side", "feature", F.col("value").alias("slot"), "n", F.col("share").alias("height"))
    return round_columns(shapes.unionByName(bars), "height")


@query("drift_category_bars", SIDES + ", " + _bars)
def q_bars(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(drift.category_bars(drift_sides(spark, sf), CATEGORIES), "share")


@query("report_to_json", SIDES + TABLE + f""" SELECT feature, feature_type, drift_detected,
  {', '.join(f'{sql_r6(m)} AS {m}' for m in ('statistic', 'p_value', *MOMENTS))} FROM drift""")
def q_json(spark: SparkSession, sf: str) -> DataFrame:
    """The drift table written as JSON documents and read back."""
    path = shared_dir(spark, "report")
    table = drift.drift_table(drift_sides(spark, sf), NUMBERS, CATEGORIES)
    files.write_report(table, path)
    return round_columns(spark.read.schema(table.schema).json(path), "statistic", "p_value", *MOMENTS)
